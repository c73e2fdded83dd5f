import re

import duckdb
import pandas as pd
import pytest

from textquarry import queries as Q
from textquarry.operators.findings import MARKDOWN
from textquarry.plans.testbed import submissions


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(Q.SQL[name]).fetchall()
    found = [tuple(r) for r in Q.QUERIES[name](spark, folder).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    return found


def test_sections_of_all_documents(spark, tmp_path):
    answer = "an answer that is long enough to be a section of its own here"
    own = "\n".join(f"Task {k}: Explain\n{answer}" for k in (1, 2))
    listed = "\n".join(f"{k}. First\n{answer}" for k in (1, 2, 3))
    rows = [(k, t, "de", "a", len(t)) for k, t in ((0, answer), (1, answer), (2, own), (4, own), (5, listed), (8, answer), (9, listed))]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    found = same_as_sql(spark, "document_sections", str(tmp_path))
    kinds = {r[0]: r[1] for r in found}
    assert kinds == {0: "labelled", 1: "numbered", 2: "labelled", 4: "labelled", 5: "numbered", 8: "whole", 9: "labelled"}
    assert {r[3] for r in found if r[0] == 2} == {"Task 1", "Task 2"}


def test_sections_equal_sql_on_the_test_bed(spark):
    found = same_as_sql(spark, "document_sections", "/root/testdata/sf0.001")
    assert {r[0] % 3 for r in found} == {0, 1, 2}


def test_all_kinds_of_markdown_against_brute_force(spark):
    texts = {r.id: r.text or "" for r in submissions(spark, "/root/testdata/sf0.001").collect()}
    want = {(d, label, n) for d, t in texts.items() for label, p in MARKDOWN if (n := len(re.findall(p, t)))}
    found = [tuple(r) for r in Q.QUERIES["markdown_findings"](spark, "/root/testdata/sf0.001").collect()]
    assert set(found) == want and len(found) == len(want)
    assert any(label == "markdown italic" for _, label, _ in found)


@pytest.mark.parametrize("name", ["section_rows", "analysed_submissions", "findings_sorted", "findings_tally", "longest_sentence", "verification_questions", "privacy_export", "markdown_findings"])
def test_query_equals_sql(spark, name):
    assert same_as_sql(spark, name, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["legislation_findings", "findings_tally", "findings_sorted", "verification_questions", "assistant_findings", "analysed_submissions"])
def test_word_edges_and_white_space_equal_sql(spark, tmp_path, name):
    body = "We wrote what was seen of the old harbour and the boats that lay there for a long while, and told no one about me² at all. "
    texts = ["É", "ÉEUX", "mÉThe Imaginary Things Act 2001é and ñas an AI modelé", "²I hope this helps²", "x" * 299 + "É", "é" * 300]
    rows = [(17 * k + 1, body + t, "de", "a", len(body + t)) for k, t in enumerate(texts)] + [(17 * k + 18, t, "de", "a", len(t)) for k, t in enumerate(texts, 20)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    assert same_as_sql(spark, name, str(tmp_path))


@pytest.mark.parametrize("name", ["token_bigrams", "bigram_document_frequency"])
def test_texts_cut_behind_a_space_equal_sql(spark, tmp_path, name):
    words = " ".join(f"word{k:05d}" for k in range(9000))
    # Of a text with one more letter at its start, the cut falls one place earlier in a word.
    rows = [(17 * k + 4, f"{'x' * k} {words}", "de", "a", len(words) + k + 1) for k in range(1, 12)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    assert same_as_sql(spark, name, str(tmp_path))


def test_analysis_reads_each_text_once_and_shuffles_none(spark):
    plan = Q.QUERIES["analysed_submissions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
