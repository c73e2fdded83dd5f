"""A corpus pipeline of five stages; each works on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet and reads again for the next. All but the last return the columns of documents.

Cases: a null or empty text fails the quality rules and goes; rows without doc_id are never near-duplicates nor contaminated
and stay if their text does; of rows with one doc_id each is judged by its own text in the first stage, and all of them stay
or go together in the second and third; extra columns pass through to the last stage, which returns doc_id, ids and decoded;
an empty table gives an empty result. Tables that a stage writes for itself are deleted when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import bpe, decontaminate, near_dup, quality, secrets
from textquarry.llm.common import forget, scratch, table, written

STAGES = [
    ("quality rules", quality.stage),
    ("near-duplicates", near_dup.stage),
    ("decontamination", decontaminate.stage),
    ("secret scan", secrets.stage),
    ("tokens", bpe.stage),
]
#: Tokenization can't be expressed in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = scratch()
        after = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(spark, [p for p in scratch() if p not in before and p != after.scratch_path] + [getattr(docs, "scratch_path", None)])
        docs = after
    return docs
