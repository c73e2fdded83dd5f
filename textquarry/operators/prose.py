"""Reducing a text to its author's own prose: reference lists and quotations go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.config import DEFAULT, Thresholds
from textquarry.functions.text import holds_any, matches_at, normalise, text_or_empty, word_count

#: A heading of references on its own line, with all that follows; and a line shaped like a citation.
_HEADING = r"(?imsdU)^[ \t]*(?:references|reference list|bibliography|works cited|citations)[ \t:]*$.*"
#: A text with such a heading holds one of these words in lower case, or a letter that other ones are the same as but for case.
HEADING_WORDS, HEADING_LETTERS = ("reference", "bibliography", "works cited", "citations"), ("ſ", "ı", "İ")
_CITATION = r"^\s*[A-Z][\p{L}'-]+,\s*[A-Z]\.(?:\s*[A-Z]\.)*.*\(\d{4}[a-z]?\)"

#: So many characters of a text hold more words than little prose, in most cases.
_HEAD = 1000


def strip_references(text: Column, headed: Column | None = None) -> Column:
    """``headed``: whether a heading may be there, where that is known."""
    text = text_or_empty(text)
    headed = holds_any(F.lower(text), *HEADING_WORDS) | holds_any(text, *HEADING_LETTERS) if headed is None else headed
    cut = F.when(headed, F.regexp_replace(text, _HEADING, "")).otherwise(text)
    return F.when(F.contains(cut, F.lit("(")) & cut.rlike(rf"(?md){_CITATION}"), F.array_join(F.filter(F.split(cut, "\n", -1), lambda line: ~line.rlike(_CITATION)), "\n")).otherwise(cut)


def strip_straight_quotes(text: Column, least: int = DEFAULT.quote_words) -> Column:
    """Marks pair by position; a span of enough words becomes a space between its marks. An unpaired last mark opens nothing."""
    pieces = F.split(text, '"', -1)
    # The last piece has no mark behind it, so it is never inside.
    kept = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x, i: F.when((i % 2 == 1) & (word_count(x) >= least), " ").otherwise(x))
    return F.when(F.contains(text, F.lit('"')), F.array_join(F.concat(kept, F.slice(pieces, -1, 1)), '"')).otherwise(text)


def strip_spans(text: Column, opening: str, closing: str, least: int) -> Column:
    """A span from an opening mark to the next closing mark becomes a space if it has enough words."""
    pattern = f"{opening}[^{closing}]*{closing}"
    found = matches_at(text, pattern)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, m: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, m["start"] - acc["at"])
        inner = F.substr(m["text"], F.lit(2), F.length(m["text"]) - 2)
        put = F.when(word_count(inner) >= least, " ").otherwise(m["text"])
        return F.struct((m["start"] + F.length(m["text"])).alias("at"), F.concat(acc["out"], gap, put).alias("out"))

    done = F.aggregate(found, start, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.contains(text, F.lit(opening)) & F.contains(text, F.lit(closing)) & text.rlike(pattern), done).otherwise(text)


def own_prose(docs: DataFrame, t: Thresholds = DEFAULT, headed: Column | None = None) -> DataFrame:
    """Adds ``prose``, ``excluded_words`` and ``excluded_reason`` to ``docs`` (with ``text``).

    A text of which little is left (fewer than 40 words and less than half) keeps no prose at all.
    """
    step = docs.withColumn("_refs", strip_references(F.col("text"), headed)).withColumn("_straight", strip_straight_quotes(F.col("_refs"), t.quote_words))
    step = step.withColumn("_double", strip_spans(F.col("_straight"), "“", "”", t.quote_words)).withColumn("_left", strip_spans(F.col("_double"), "‘", "’", t.single_quote_words))
    text, left = text_or_empty(F.col("text")), F.col("_left")
    changed = left != text
    # The words of a short part settle most texts; its last one may be cut, so it must have one more.
    few = (word_count(F.substring(left, 1, _HEAD)) <= t.little_prose) & (word_count(left) < t.little_prose) & (word_count(left) * 2 < word_count(text))
    step = step.withColumn("_little", changed & few)
    reasons = F.concat_ws(" and ", F.when(F.col("_refs") != text, "reference list"), F.when(left != F.col("_refs"), "quoted material"))
    excluded = F.when(changed, F.greatest(F.lit(0), word_count(text) - word_count(left))).otherwise(0)
    out = step.withColumn("excluded_reason", F.when(F.col("_little"), "mostly not own prose").otherwise(reasons)).withColumn("excluded_words", excluded)
    return out.withColumn("prose", F.when(F.col("_little"), "").otherwise(left)).drop("_refs", "_straight", "_double", "_left", "_little")


def normal_text(docs: DataFrame, t: Thresholds = DEFAULT, headed: Column | None = None) -> DataFrame:
    """Adds ``normtext``: the own prose, normalised, at most 65,000 characters."""
    return own_prose(docs, t, headed).withColumn("normtext", F.substring(normalise(F.col("prose")), 1, t.text_chars))
