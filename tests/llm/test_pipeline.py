import corpus_pipeline
from tests.llm.test_bpe import WORD, by_library
from tests.llm.test_near_dup import brute as near_brute
from tests.llm.test_secrets import MODEL

from textquarry.llm import decontaminate, quality, secrets
from textquarry.llm.common import table

SF = "/root/testdata/sf0.001"


def test_run_equals_stages_by_brute_force(spark):
    """Quality and contamination verdicts come from their operators (held against SQL or brute force elsewhere); the rest is redone plainly."""
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    verdict = {r.doc_id for r in quality.quality(table(spark, SF, "documents"), table(spark, SF, "labels")).where("kept").collect()}
    left = {d: t for d, t in docs.items() if d in verdict}
    groups = near_brute(sorted(left.items()))
    left = {d: t for d, t in left.items() if groups[d][1] == d}
    frame = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    dirty = {r.doc_id for r in decontaminate.contaminated(frame, table(spark, SF, "benchmark")).collect()}
    assert dirty and len(verdict) < len(docs)
    want = {d: secrets.redacted(t, secrets.find(t, MODEL)[1]) for d, t in left.items() if d not in dirty}
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert found.keys() == want.keys()
    for d, text in want.items():
        assert found[d] == by_library(WORD, text)


def test_stages_keep_columns_and_stand_empty_tables(spark):
    columns = table(spark, SF, "documents").columns
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and docs.count() == 0
