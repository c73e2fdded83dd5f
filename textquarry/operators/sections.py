"""Splitting a document into its question sections.

A line that starts with a marker opens a section, which runs to the next marker; text before the first marker belongs
to none. Labelled markers ("Question 2", "Task 1:") are tried first, then numbered lines ("1." or "1)"); with fewer
than two sections of enough length the document is one section, number 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.config import DEFAULT, Thresholds
from textquarry.functions.text import text_or_empty, trimmed, word_count

#: The words of labelled markers, as a pattern. Possessive, so that "Section 28 of" is not cut to "Section 2".
#: A marker lies within its line, so white space in it is any but a line feed.
_GAP = r"[ \t\x0B\f\r]"
_WORD = rf"(?:(?:Question|Activity|Task|Section|Part|Answer|Response){_GAP}++|Q\.?{_GAP}*+)"
LABELLED = rf"^[ \t\f]*+(?i:{_WORD})\d++[:.\-) \t\x0B\f\r]*+(?![a-z])"
_LABEL_PARTS = r"^[ \t\f]*+(?i:(Question|Activity|Task|Section|Part|Answer|Response|Q\.?))\s*+(\d++)"
NUMBERED = rf"^[ \t]*(\d{{1,2}})[.)]{_GAP}"
_SECTIONS = "array<struct<num:int,label:string,text:string>>"


def _whole_lines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text_or_empty(text))


def _grouped(text: Column, marker: str, head) -> Column:
    """Sections from marked lines: the text is cut before each marked line, and what stands before the first one goes."""
    # The line feed in front of a marked line belongs to no section.
    pieces = F.split(text, f"(?md)\\n(?={marker})", -1)
    return F.transform(F.filter(pieces, lambda x: x.rlike(marker)), lambda x: F.struct(*head(x), x.alias("text")))


def _labelled_head(line: Column) -> list[Column]:
    number = F.regexp_extract(line, _LABEL_PARTS, 2)
    return [number.cast("int").alias("num"), F.concat(F.regexp_extract(line, _LABEL_PARTS, 1), F.lit(" "), number.cast("int").cast("string")).alias("label")]


def _numbered_head(line: Column) -> list[Column]:
    number = F.regexp_extract(line, NUMBERED, 1).cast("int")
    return [number.alias("num"), F.concat(F.lit("Question "), number.cast("string")).alias("label")]


def marked(text: Column, kind: str) -> Column:
    """All sections by one kind of marker ("labelled" or "numbered"), short ones included."""
    pattern, head = (LABELLED, _labelled_head) if kind == "labelled" else (NUMBERED, _numbered_head)
    found = _grouped(_whole_lines(text), pattern, head)
    return F.when(_whole_lines(text).rlike(f"(?md){pattern}"), found).otherwise(F.array().cast(_SECTIONS))


def split_sections(docs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Adds ``sections`` to ``docs`` (with ``text``)."""
    long_enough = lambda s: F.octet_length(trimmed(s["text"])) >= t.section_bytes
    staged = docs.withColumn("_labelled", F.filter(marked(F.col("text"), "labelled"), long_enough)).withColumn("_numbered", F.when(F.size("_labelled") >= 2, F.array().cast(_SECTIONS)).otherwise(F.filter(marked(F.col("text"), "numbered"), long_enough)))
    whole = F.array(F.struct(F.lit(0).alias("num"), F.lit("Full Document").alias("label"), _whole_lines(F.col("text")).alias("text"))).cast(_SECTIONS)
    none = F.array().cast(_SECTIONS)
    chosen = F.when(F.size("_labelled") >= 2, F.col("_labelled")).when(F.size("_numbered") >= 2, F.col("_numbered")).when(trimmed(text_or_empty(F.col("text"))) == "", none).otherwise(whole)
    return staged.withColumn("sections", chosen).drop("_labelled", "_numbered")


def section_rows(docs: DataFrame, key: str, t: Thresholds = DEFAULT) -> DataFrame:
    """One row a section: key, section_num (its place), label, num (as printed), text, wordcount and note."""
    rows = split_sections(docs.select(key, "text"), t).select(key, F.posexplode("sections").alias("place", "s"))
    counted = rows.select(key, (F.col("place") + 1).alias("section_num"), F.substring("s.label", 1, 128).alias("label"), F.col("s.num").alias("num"), F.col("s.text").alias("text"), word_count(F.col("s.text")).alias("wordcount"))
    return counted.withColumn("note", F.when(F.col("wordcount") < t.prose_words, "insufficient_text"))
