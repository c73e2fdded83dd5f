"""Submissions built from the ``documents`` table, so that every text rule has something to find.

Cohort = source, user = doc_id % 997, content hash = SHA-1 of the text. Fixed lines are put around each text by
doc_id, so markers, quotations, references, phrases, citations and other scripts occur. The text is one SQL expression
that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time at which the test bed's lifecycle runs.
NOW = 1_700_000_000
_LONG = "we walked along the river for an hour and then sat down under the old bridge to watch the boats come slowly home again"
_TYPO = "nobody in the harbour office could say when the last ferry would leave that night because the timetable had been lost in the flood"
TEXT = f"""concat(
  'Assessment cover sheet for the unit of study. Write your name and number below and read every instruction before you begin this task.', chr(10),
  CASE WHEN doc_id % 3 = 0 THEN concat('Question 1: Describe the duty of care you met at work', chr(10)) WHEN doc_id % 3 = 1 THEN concat('1. First part of what was asked of me', chr(10)) ELSE concat('Section 28 of the book was of help here', chr(10)) END,
  CASE WHEN doc_id % 29 = 0 THEN replace(coalesce(text, ''), chr(10), concat(chr(13), chr(10))) ELSE coalesce(text, '') END, chr(10),
  CASE WHEN doc_id % 3 = 0 THEN concat('  Q. 2 Explain the risk assessment that you made last week for the team', chr(10)) WHEN doc_id % 3 = 1 THEN concat('  2) Second part of what was asked, with reasons given', chr(10)) ELSE 'Only an ending here.' END,
  substr(coalesce(text, ''), 1, 300), chr(10),
  CASE WHEN doc_id % 5 = 0 THEN '"{_LONG}" as was said. ' WHEN doc_id % 5 = 1 THEN 'A "short quote" only, and one mark " more. ' WHEN doc_id % 5 = 2 THEN '“{_TYPO}” again. ' ELSE '' END,
  CASE WHEN doc_id % 11 = 0 THEN concat(chr(10), 'As an AI language model I do not have personal opinions. I hope this helps!', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 13 = 0 THEN concat(chr(10), '## A heading', chr(10), '* one **bold** bullet', chr(10), '---', chr(10), 'with *slanted* words and `code` and > no quote', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 17 = 0 THEN ' I read under the Privacy Act 1988 that my team and I have to keep what we are told about other people safe at all times. ' WHEN doc_id % 17 = 1 THEN ' See the Privacy Act 1989 (about) and the Imaginary Things Act 2001 too. ' WHEN doc_id % 17 = 2 THEN ' as in the Work Health and Safety Act (Cth) 2011 and Food Act 1985, Food  Act 1985. ' ELSE '' END,
  CASE WHEN doc_id % 31 = 0 THEN repeat(' Это длинный текст на другом языке, который нужен для проверки.', 60) ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN concat(chr(10), 'Smith, J. (2019). A title of some kind.', chr(10), 'References', chr(10), 'Jones, A. B. (2020). Another title.', chr(10)) ELSE '' END)"""
STATUS = "CASE WHEN doc_id % 19 = 3 THEN 'pending' WHEN doc_id % 19 = 7 THEN 'error' WHEN doc_id % 23 = 5 THEN 'unsupported' ELSE 'analysed' END"
_COLUMNS = f"""doc_id AS id, doc_id % 997 AS userid, source AS cohort, {TEXT} AS text, {STATUS} AS status,
  {NOW} - (doc_id * 7919) % 20000000 AS timecreated, {NOW} - (doc_id * 104729) % 5000000 AS timemodified,
  CASE WHEN doc_id % 4 = 0 THEN '{{"score_model":2}}' WHEN doc_id % 4 = 1 THEN '{{"score_model":3}}' WHEN doc_id % 4 = 2 THEN '{{}}' END AS analysisjson,
  CAST((doc_id * 37) % 10000 AS DOUBLE) / 100 AS score,
  CASE WHEN doc_id % 19 = 7 THEN concat('could not read file ', CAST(doc_id AS STRING), repeat('.', 200)) END AS errormsg"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*[c for c in ("doc_id", "source", "text")])
    docs = docs.withColumn("contenthash", F.sha1(F.coalesce("text", F.lit(""))))
    made = docs.selectExpr(*_split(_COLUMNS), "contenthash")
    return made.withColumn("level", F.expr("CASE WHEN score >= 65 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END"))


def _split(columns: str) -> list[str]:
    """The expressions of a SELECT list (commas inside brackets and quotes do not part them)."""
    out, depth, quoted, held = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        if not quoted:
            depth += {"(": 1, ")": -1}.get(c, 0)
            if c == "," and depth == 0:
                out.append(held.strip())
                held = ""
                continue
        held += c
    return [*out, held.strip()]


#: The same as a common table expression for DuckDB.
SUBS_SQL = f"""subs AS (SELECT *, CASE WHEN score >= 65 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS level
  FROM (SELECT {_COLUMNS.replace('AS STRING', 'AS VARCHAR')}, sha1(coalesce(text, '')) AS contenthash FROM documents))"""
