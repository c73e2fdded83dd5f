"""Overlap of documents within a cohort: shared template, pairs, matches and scores.

Rows are submissions: cohort, id, normtext. All analysed rows of a cohort count towards its size and its template; the
bigrams of the template are taken from every document before any comparison.

Bigrams are 64-bit hashes, made inside one array a document; a vocabulary of v distinct bigrams in a cohort meets a
collision with probability v**2 / 2**65. The template is one array a cohort: a bigram of it stands in a third of at most 60
sampled documents, so it holds at most three times the bigrams of an average one. It is sent to every executor if the
templates have at most ``SENT_TEMPLATE`` bigrams together, else joined by cohort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from textquarry.config import DEFAULT, Thresholds
from textquarry.functions.text import band, submission_score, template_threshold
from textquarry.operators import bigrams as B
from textquarry.plans.tables import forget, written


SENT_TEMPLATE = 2_000_000
#: Rows of ids up to which they are sent to every executor, so that texts and sets are filtered where they lie.
SENT_IDS = 1_000_000
#: Bigrams that are counted together.
COUNTED = 4_000_000
#: Bigrams of sets, and candidates, that are compared in one part.
GROUPED, TRIED = 2_000_000, 200_000


def comparable(subs: DataFrame, strict: bool = False, t: Thresholds = DEFAULT) -> DataFrame:
    """Analysed rows long enough to compare; ``strict`` asks for more than the least length, as the class report does."""
    size = F.octet_length("normtext")
    return subs.where((F.col("status") == "analysed") & (size > t.compare_bytes if strict else size >= t.compare_bytes))


def bigram_sets(subs: DataFrame, common: dict | None = None) -> DataFrame:
    """(cohort, id, hs): the hashes of each document's distinct bigrams, without those that ``common`` has of its cohort."""
    rows = subs.where("normtext IS NOT NULL").select("cohort", "id", "normtext")
    schema = StructType([*rows.select("cohort", "id").schema, StructField("hs", ArrayType(LongType(), False))])
    return rows.mapInArrow(B.of_texts(["cohort", "id"], common), schema)


def hashed_bigrams(subs: DataFrame) -> DataFrame:
    """(cohort, id, h): the distinct bigrams of each document, hashed. The exploded array is distinct already."""
    return bigram_sets(subs).select("cohort", "id", F.explode("hs").alias("h"))


def stride_sample(subs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """At most 60 rows of each cohort, evenly spaced by id. Up to 60 rows all are taken; the spacing is rounded down.

    The order is by id for every comparison, so similarity is symmetric.
    """
    by_id = Window.partitionBy("cohort").orderBy("id")
    # Only ids are ranked: texts stay out of the window's sort.
    ids = subs.select("cohort", "id").withColumn("i", F.row_number().over(by_id) - 1).withColumn("n", F.count("*").over(Window.partitionBy("cohort")))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / t.template_sample))
    picked = ids.where((F.col("n") <= t.template_sample) | ((F.col("i") % stride == 0) & (F.col("i") / stride < t.template_sample)))
    return picked.select("cohort", "id", F.least("n", F.lit(t.template_sample)).alias("sampled"))


def _of_ids(rows: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The rows that ``ids`` (a written table) names."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, on, "left_semi")


def document_frequency(subs: DataFrame) -> DataFrame:
    return hashed_bigrams(subs).groupBy("cohort", "h").agg(F.count("*").alias("df"))


def template(subs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(cohort, h): bigrams in at least a third (and three) of the cohort's sample; cohorts under three have none."""
    return _template(subs, _sample(subs, t), t)


def _sample(subs: DataFrame, t: Thresholds) -> DataFrame:
    return written(stride_sample(subs.where("normtext IS NOT NULL"), t), "sample")


def _template(subs: DataFrame, sample: DataFrame, t: Thresholds) -> DataFrame:
    sizes = sample.groupBy("cohort").agg(F.count("*").alias("n")).where(F.col("n") >= t.cohort_minimum)
    counts = hashed_bigrams(_of_ids(subs, sample.select("cohort", "id"), ["cohort", "id"])).groupBy("cohort", "h").agg(F.count("*").alias("df"))
    return counts.join(sizes, "cohort").where(F.col("df") >= template_threshold(F.col("n"), t)).select("cohort", "h")


def own_sets(subs: DataFrame, t: Thresholds = DEFAULT, strict: bool = False) -> DataFrame:
    """(cohort, id, hs): what a document says beyond the template, in cohorts of three and more; documents with nothing left are out."""
    return _own(subs, _common_of(subs, t), t, strict)


def _common_of(subs: DataFrame, t: Thresholds) -> tuple[DataFrame, DataFrame, dict | None]:
    """The cohorts that are compared, their templates, and these again by cohort if they are few."""
    sizes = subs.where("normtext IS NOT NULL").groupBy("cohort").agg(F.count("*").alias("n")).where(F.col("n") >= t.cohort_minimum)
    sample = _sample(subs, t)
    cohorts, common = written(sizes.select("cohort"), "cohorts"), written(_template(subs, sample, t), "template")
    forget(sample)
    if common.count() > SENT_TEMPLATE:
        return cohorts, common, None
    rows = common.orderBy("cohort").toArrow()
    names, h = rows.column("cohort").to_pylist(), rows.column("h").to_numpy()
    starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
    return cohorts, common, {names[x]: np.unique(h[x:y]) for x, y in zip(starts, [*starts[1:], len(names)][: len(starts)], strict=True)}


def _own(subs: DataFrame, templates: tuple, t: Thresholds, strict: bool) -> DataFrame:
    cohorts, common, sent = templates
    rows = comparable(subs, strict, t).join(cohorts if sent is None else F.broadcast(cohorts), "cohort", "left_semi")
    if sent is not None:
        return bigram_sets(rows, sent).where("size(hs) > 0")
    left = F.when(F.col("common").isNull(), F.col("hs")).otherwise(F.array_except("hs", "common"))
    held = common.groupBy("cohort").agg(F.collect_list("h").alias("common"))
    return bigram_sets(rows).join(held, "cohort", "left").select("cohort", "id", left.alias("hs")).where("size(hs) > 0")


def _parts(rows: DataFrame, each: int) -> int:
    """Parts of about ``each`` bigrams, of which one takes six bytes of text or more."""
    return 1 + (rows.agg(F.sum(F.octet_length("normtext"))).first()[0] or 0) // (6 * each)


def _shared(sets: DataFrame, n: int) -> DataFrame:
    """``SHARED`` of ``sets`` (cohort, id, size, hs, fresh): the bigrams that several documents have.

    Each is shuffled once, in four bytes, to one of n parts of the hashes' range. Two of a part meet in one key with
    probability 1e-3 at most, whatever the number of parts; they then count as shared, which only makes more candidates.
    """
    made = sets.select(F.xxhash64("cohort").alias("c"), F.col("id").cast("long").alias("id"), "size", "fresh", "hs").mapInArrow(B.dealt(n), B.DEALT)
    return made.groupBy("part").applyInArrow(B.counted, B.SHARED)


def shared_bigrams(sets: DataFrame) -> DataFrame:
    """(c, id, size, df): a row for each bigram of ``sets`` (cohort, id, size, hs) that several documents have; from 128 on df is a class."""
    n = min(1 << 15, 1 + (sets.agg(F.sum("size")).first()[0] or 0) // COUNTED)
    packed = _shared(sets.withColumn("fresh", F.lit(True)), n)
    byte = lambda i: F.conv(F.hex(F.substring("f", i, F.lit(1))), 16, 10).cast("int")
    return packed.select("c", "id", "size", F.explode(F.transform(F.sequence(F.lit(1), F.length("f")), byte)).alias("df"))


_COMMON = "cohort string, a long, b long, size_a int, size_b int, n int"


def _common(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """How many bigrams the two sets of each pair have in common."""
    hs = sets.column("hs").combine_chunks()
    values, offsets = hs.flatten().to_numpy(), np.append(0, np.cumsum(sets.column("size").to_numpy(), dtype=np.int64))
    held: dict[int, list[tuple[str, np.ndarray]]] = {}
    for k, (cohort, x) in enumerate(zip(sets.column("cohort").to_pylist(), sets.column("id").to_pylist(), strict=True)):
        held.setdefault(x, []).append((cohort, np.sort(values[offsets[k] : offsets[k + 1]])))
    out = []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        for (cohort, x), (other, y) in ((x, y) for x in held.get(a, ()) for y in held.get(b, ())):
            if cohort == other:
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                out.append((cohort, a, b, len(x), len(y), int((large[at] == small).sum())))
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _COMMON.split(", ")])


def _dealt_candidates(candidates: DataFrame, n: int) -> DataFrame:
    """Candidates (a, b) dealt out by the smallest id that a meets, so that those of one group of like documents lie
    together, and a set is sent once to a part rather than once a candidate. Groups of very many are dealt out by a too.
    """
    least = candidates.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("least"))
    named = candidates.join(least, "a", "left").select("a", "b", F.coalesce("least", "a").alias("least"))
    many = named.groupBy("least").agg(F.floor(F.count("*") / TRIED).alias("more")).where("more > 0")
    salt = F.coalesce(F.pmod(F.xxhash64("a"), F.col("more") + 1), F.lit(0))
    return named.join(F.broadcast(many), "least", "left").select("a", "b", F.pmod(F.xxhash64("least", salt), F.lit(n)).alias("part"))


def _candidates(subs: DataFrame, templates: tuple, t: Thresholds, strict: bool, new: DataFrame | None) -> DataFrame:
    bound = t.similarity - 0.00005
    n = min(1 << 15, _parts(comparable(subs, strict, t), COUNTED))
    sets = _own(subs, templates, t, strict).withColumn("size", F.size("hs"))
    if new is None:
        sets = sets.withColumn("fresh", F.lit(False))
    else:
        sets = sets.join(new.select("id").distinct().withColumn("fresh", F.lit(True)), "id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    shared = written(_shared(sets, n), "shared")
    # A document's bigrams that only it has can't be shared, but hold their places in its order.
    rare = shared.withColumn("bucket", F.pmod(F.xxhash64("c", "id"), F.lit(n))).groupBy("bucket").applyInArrow(B.rarest(bound), B.RARE)
    rare = written(rare, "rarest")
    forget(shared)
    candidates = written(rare.repartition(n, "part").mapInArrow(B.met(bound, new is not None), B.CANDIDATES).distinct(), "candidates")
    forget(rare)
    return candidates


def pairs(subs: DataFrame, t: Thresholds = DEFAULT, strict: bool = False, new: DataFrame | None = None) -> DataFrame:
    """(cohort, a, b, similarity) of all pairs a < b with similarity of at least 0.35 after rounding to four places.

    Prefix filtering: of two sets this similar, at least one bigram is shared among the rarest
    |A| - ceil(bound * |A|) + 1 of either, so candidates meet on these alone, and the most frequent bigrams never
    meet. Where the first one in common stands, enough must stand behind it in both. Candidates are then confirmed on the
    whole sets. With ``new`` (id), only pairs with one of these ids are made.

    Sets are made from the texts each time they are read, as they take more disk than these. A table is deleted when
    the next one is written.
    """
    templates = _common_of(subs, t)
    candidates = _candidates(subs, templates, t, strict, new)
    ids = written(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    few = _of_ids(subs, ids, ["id"])
    n = max(_parts(few, GROUPED), 1 + candidates.count() // TRIED)
    dealt = written(_dealt_candidates(candidates, n), "dealt-candidates")
    forget(candidates)
    asked = written(dealt.select(F.explode(F.array("a", "b")).alias("id"), "part").groupBy("id").agg(F.collect_set("part").alias("parts")), "asked")
    sets = _own(few, templates, t, strict).select("cohort", F.col("id").cast("long").alias("id"), F.size("hs").alias("size"), "hs")
    sent = sets.join(F.broadcast(asked) if asked.count() <= SENT_IDS else asked, "id").select("cohort", "id", "size", "hs", F.explode("parts").alias("p"))
    found = sent.groupBy("p").cogroup(dealt.groupBy("part")).applyInArrow(_common, _COMMON)
    scored = found.select("cohort", "a", "b", F.round(F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n")), 4).alias("similarity"))
    scored = written(scored.where(F.col("similarity") >= t.similarity), "pairs")
    forget(*templates[:2], ids, dealt, asked)
    return scored


def both_ways(found: DataFrame) -> DataFrame:
    """(cohort, id, other, similarity) from pairs."""
    return found.select("cohort", F.col("a").alias("id"), F.col("b").alias("other"), "similarity").union(found.select("cohort", "b", "a", "similarity"))


def matches(found: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The ten best matches of each document, ties by id, with their rank."""
    best = Window.partitionBy("cohort", "id").orderBy(F.desc("similarity"), "other")
    return both_ways(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= t.matches)


def scores(subs: DataFrame, found: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """(cohort, id, score, level): the best match of each analysed row as a percentage, 0 without one."""
    best = both_ways(found).groupBy("cohort", "id").agg(F.max("similarity").alias("best"))
    rows = subs.where("status = 'analysed'").select("cohort", "id").join(best, ["cohort", "id"], "left")
    scored = rows.select("cohort", "id", submission_score(F.coalesce("best", F.lit(0.0))).alias("score"))
    return scored.withColumn("level", band(F.col("score"), t))


def raise_only(stored: DataFrame, evidence: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Merge of copy evidence into stored scores (id, score).

    ``evidence`` has (id, other, similarity) of newly analysed ids: such an id's own score becomes that of its best
    match, also a lower one (a match with itself counts here); a matched row's score is only ever raised.
    """
    own = evidence.groupBy("id").agg(submission_score(F.max("similarity")).alias("own"))
    raised = evidence.where("other <> id AND other > 0").groupBy(F.col("other").alias("id")).agg(submission_score(F.max("similarity")).alias("raised"))
    merged = stored.join(own, "id", "left").join(raised, "id", "left")
    score: Column = F.greatest(F.coalesce("own", "score"), F.coalesce("raised", F.lit(0.0)))
    return merged.select("id", score.alias("score"), band(score, t).alias("level"))
