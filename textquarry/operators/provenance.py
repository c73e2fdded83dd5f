"""Observations about a file's own metadata: context only, never a judgement.

``fields`` is a map of names to values, as the readers in ``textquarry.sources`` give it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.config import DEFAULT, Thresholds


def labels(fields: Column, words: Column, t: Thresholds = DEFAULT) -> Column:
    """Labels of the observations that hold, in a fixed order. Length counts from 200 words; names and producer at any length."""
    get = lambda name: F.try_element_at(fields, F.lit(name))
    whole = lambda name: F.coalesce(F.regexp_extract(get(name), r"^\s*(-?\d+)", 1).try_cast("int"), F.lit(0))
    long_enough = words >= t.provenance_words
    minutes = whole("editing_minutes")
    seconds = F.unix_timestamp(F.try_to_timestamp(get("modified"))) - F.unix_timestamp(F.try_to_timestamp(get("created")))
    rules = [
        ("short editing time", get("editing_minutes").isNotNull() & long_enough & (minutes >= 0) & (minutes < words / t.words_per_minute)),
        ("single save", get("revision").isNotNull() & (whole("revision") == 1) & long_enough),
        ("lifespan under two minutes", long_enough & seconds.between(0, 119)),
        ("different names", get("creator") != get("last_modified_by")),
        ("produced by a browser engine", F.lower(get("producer")).rlike(r"\bskia\b")),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules]), lambda x: x.isNotNull())


def cut_fields(fields: Column, t: Thresholds = DEFAULT) -> Column:
    """Values for storage: at most 256 characters and an ellipsis, without control characters. Labels are found before."""
    def cut(_: Column, v: Column) -> Column:
        short = F.when(F.length(v) > t.field_chars, F.concat(F.substring(v, 1, t.field_chars), F.lit("…"))).otherwise(v)
        return F.regexp_replace(short, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")

    return F.transform_values(fields, cut)
