"""Reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.config import DEFAULT, Thresholds
from textquarry.functions.text import band


def stat_cards(subs: DataFrame) -> DataFrame:
    """Counts of an activity: by status, and by level among analysed rows."""
    status = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    level = lambda x: F.count_if((F.col("status") == "analysed") & (F.col("level") == x)).alias(f"n_{x}")
    return subs.groupBy("cohort").agg(F.count("*").alias("n"), *map(status, ("analysed", "pending", "error", "unsupported")), *map(level, ("low", "medium", "high")))


def named(rows: DataFrame, users: DataFrame, key: str, unknown: str | Column = "Unknown") -> DataFrame:
    """Adds ``name`` from users (userid, name); a missing user gets a stand-in."""
    lookup = users.select(F.col("userid").alias(key), "name")
    return rows.join(lookup, key, "left").withColumn("name", F.coalesce("name", F.lit(unknown) if isinstance(unknown, str) else unknown))


def named_matches(best: DataFrame, subs: DataFrame, users: DataFrame) -> DataFrame:
    """Matches (cohort, id, other, similarity, rank) with the other author's user name, full name and level."""
    others = subs.select(F.col("id").alias("other"), "userid", F.col("level").alias("other_level"))
    found = best.join(others, "other").join(users.select("userid", "username", "name"), "userid", "left")
    return found.select("cohort", "id", "other", "similarity", "rank", F.coalesce("username", F.lit("?")).alias("username"), F.coalesce("name", F.lit("Unknown")).alias("fullname"), "other_level")


def named_pairs(found: DataFrame, subs: DataFrame, users: DataFrame) -> DataFrame:
    """Pairs with both authors' names."""
    names = named(subs.select("id", "userid"), users, "userid", "unknownuser")
    side = lambda k: names.select(F.col("id").alias(k), F.col("name").alias(f"name_{k}"))
    return found.join(side("a"), "a").join(side("b"), "b").select("cohort", "a", "b", "similarity", "name_a", "name_b")


def class_report(subs: DataFrame, users: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Rows of the class list, newest first: name, status, whole percentage and level."""
    rows = named(subs.where("status <> 'unsupported'"), users, "userid", F.concat(F.lit("#"), F.col("userid").cast("string")))
    return rows.select("cohort", "id", "name", "status", F.floor("score").cast("int").alias("percent"), band(F.col("score"), t).alias("level"), "timemodified").orderBy(F.desc("timemodified"), F.desc("id"))


def pair_report(found: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Pairs with rounded percentage and band, best first."""
    percent = F.round(F.col("similarity") * 100, 0).cast("int")
    return found.select("cohort", "a", "b", "similarity", percent.alias("percent"), band(F.col("similarity") * 100, t).alias("band")).orderBy(F.desc("similarity"), "a", "b")


def display_text(html: Column, limit: int = 600) -> Column:
    """Markup and the commonest references go, white space becomes one space, and a preview of some length stays."""
    bare = F.regexp_replace(html, "(?s)<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.substring(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), 1, limit)
