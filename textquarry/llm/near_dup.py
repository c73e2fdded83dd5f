"""MinHash near-duplicates (operator 6) with b-bit signatures.

Texts are sets of 5-word shingles (a text of fewer words: its whole word sequence). Two texts are linked if their
Jaccard similarity is at least 0.85, and the result is the connected components of these links.

1. One pass makes the set's size, a 128-bit digest, 32 band keys of 4 minima each, and the low 4 bits of 128 minima
   packed into eight 64-bit words. Texts with the same set form a class; its smallest doc_id goes on alone.
2. In each band bucket every member is compared with the smallest one. The collision-corrected similarity is read from
   the packed bits by counting; a pair six standard deviations below the threshold goes, every other one is confirmed
   on the full sets. The links give components.
3. Buckets whose members lie in one component are done. Those of others are dealt out in block pairs of bounded size.
   Members of different components are compared by their bits, a pair only in the first band that it shares. Members
   with a possible partner then meet again with their full sets, and pairs are confirmed within the block, best first,
   until they are in one component. So every pair that shares a band is in one component at the end or was compared,
   no bucket is capped, and only links leave a block, never its pairs.

A pair at the threshold shares no band with probability 6e-11.

A shingle is a pair of 64-bit hashes of two independent families, in digests and where links are confirmed.

Cases: a text that is null, empty or without words has an empty set and is linked with nothing; a row without doc_id
has no component (null) and is kept; repeated rows have the same class; rows with one doc_id and different texts are one
document, which is linked with whatever one of them is linked with. A text of any length is one row of work; blocks of
full sets are bounded by rows and, on average, by bytes. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import arrays as A
from textquarry.llm.common import discard, parts, table, tidy, written
from textquarry.llm.components import components

SHINGLE = 5
#: A link: PERCENT_I * intersection >= PERCENT_U * union.
PERCENT_I, PERCENT_U = 100, 85
MINIMA, ROWS, BITS = 128, 4, 4
BANDS = MINIMA // ROWS
LANES = MINIMA * BITS // 64
#: Fewest equal b-bit values of a pair that may be a link: at similarity s, s + (1 - s) / 2**b are expected.
_EXPECTED = PERCENT_U / PERCENT_I + (1 - PERCENT_U / PERCENT_I) / (1 << BITS)
LEAST_EQUAL = int(MINIMA * _EXPECTED - 6 * (MINIMA * _EXPECTED * (1 - _EXPECTED)) ** 0.5)
#: Rows, and bytes of full sets on average, of a block.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Bytes of text whose shingles are held at a time.
SLICE_BYTES = 1 << 20
#: Ids up to which a list of wanted documents is sent to every executor; beyond, texts are shuffled to meet it.
SENT_IDS = 500_000
#: The lowest bit of each b-bit value in a word.
_ONES = int("1" * (64 // BITS), 1 << BITS)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_SCALE = _rng.integers(0, 1 << 32, MINIMA, np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, MINIMA, np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after the other, with the offsets of texts.

    A shingle is a pair of 64-bit hashes of two independent families: the first two arrays.
    """
    data, offsets = A.texts(column)
    data = A.LOWER[data]
    starts, ends, word_offsets = A.words(data, offsets)
    hashes = [A.segment_hashes(data, starts, ends, seed) for seed in A.SEEDS]
    rolled = [A.shingle_hashes(h, width) for h in hashes]
    counts = np.diff(word_offsets)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for first, count in zip(word_offsets.tolist(), counts.tolist()):
        if count >= width:
            x, y = (r[first : first + count - width + 1] for r in rolled)
            order = np.argsort(x)
            x, y = x[order], y[order]
            new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            out.append((x[new], y[new]))
        else:
            # The whole sequence is one shingle; its width tells it from others.
            out.append(tuple(A.shingle_hashes(h[first : first + count], count) + np.uint64(count) for h in hashes) if count else (rolled[0][:0],) * 2)
    one, two = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.uint64) for k in (0, 1))
    return one, two, np.concatenate([[0], np.cumsum([len(x) for x, _ in out])]).astype(np.int64)


def minima_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of MINIMA minima for each text with a set; texts without one are left out."""
    filled = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(filled), MINIMA), np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    work = np.empty_like(short)
    for k in range(MINIMA if len(filled) else 0):
        np.multiply(short, _SCALE[k], out=work)
        np.add(work, _SHIFT[k], out=work)
        out[:, k] = np.minimum.reduceat(work, filled)
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of each (mixed) minimum, 64 / BITS of them to a word."""
    low = A.mix(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shifts = (np.arange(per) * BITS).astype(np.uint64)
    return np.bitwise_or.reduce(low.reshape(len(minima), LANES, per) << shifts, axis=2)


def band_keys(minima: np.ndarray) -> np.ndarray:
    grouped = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minima), BANDS)) * _GOLD
    for k in range(ROWS):
        key = A.mix(key + grouped[:, :, k] * _GOLD)
    return key


@tidy
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text", SLICE_BYTES):
        values, second, offsets = shingle_sets(batch.column("text"))
        sizes = np.diff(offsets)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(A.mix(x + np.uint64(1)), dtype=np.uint64)]) for x in (values, second)]
        digest = [s[offsets[1:]] - s[offsets[:-1]] for s in sums]
        minima = minima_of(values, offsets)
        keys, bits = band_keys(minima).view(np.int64), packed(minima).view(np.int64)
        row = np.cumsum(sizes > 0)
        lists = lambda m, width: pa.ListArray.from_arrays(pa.array(np.append(0, row * width), pa.int32()), pa.array(m.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists(keys, BANDS), lists(bits, LANES)],
            names=["doc_id", "n_shingles", "d0", "d1", "bands", "bits"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_signatures, "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>, bits array<long>")


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text", SLICE_BYTES):
        *pair, offsets = shingle_sets(batch.column("text"))
        both = np.column_stack(pair)
        blobs = [both[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "shingles"])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the wanted documents (doc_id)."""
    few = wanted.count() <= SENT_IDS
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    return rows.mapInArrow(_sets, "doc_id long, shingles binary").dropDuplicates()


def equal_bits(left: str, right: str):
    """How many b-bit values of two packed signatures are equal."""
    unequal = F.lit(0)
    for k in range(LANES):
        x = F.col(left)[k].bitwiseXOR(F.col(right)[k])
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(_ONES)))
    return F.lit(MINIMA) - unequal


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (rows of two hashes, distinct) are similar enough."""
    if PERCENT_I * min(len(x), len(y)) < PERCENT_U * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    shared = int((both[1:] == both[:-1]).all(1).sum())
    return PERCENT_I * shared >= PERCENT_U * (len(x) + len(y) - shared)


def _set(blob: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.uint64).reshape(-1, 2)


@tidy
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
        keep = [linked(_set(x), _set(y)) for x, y in sets]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs`` (a, b), on full sets."""
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
    return two.select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long").distinct()


def _block_pairs(block: pa.Table) -> np.ndarray:
    """Rows (equal values, row, row) of pairs that may be links across components; each pair in its first shared band only."""
    comps, sides = block.column("component").to_numpy(), block.column("side").to_numpy()
    band = block.column("band")[0].as_py()
    matrix = lambda name, width: block.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    bits, bands = matrix("bits", LANES).view(np.uint64), matrix("bands", BANDS)
    out = [np.zeros((0, 3), np.int32)]
    for k in range(len(comps) - 1):
        x = bits[k + 1 :] ^ bits[k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        equal = MINIMA - np.bitwise_count(x & np.uint64(_ONES)).sum(1, dtype=np.int64)
        wanted = (equal >= LEAST_EQUAL) & (comps[k + 1 :] != comps[k]) & ((sides[k + 1 :] != sides[k]) | (sides[k] < 0))
        j = np.flatnonzero(wanted)
        j = j[(bands[k + 1 + j] == bands[k]).argmax(1) == band] if len(j) else j
        out.append(np.column_stack([equal[j], np.full(len(j), k), k + 1 + j]).astype(np.int32))
    return np.concatenate(out)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``g``; rows come sorted by it, and a block is of bounded size."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and groups[a] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = groups[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


@tidy
def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _by_block(batches):
        rows = np.unique(_block_pairs(block)[:, 1:])
        if len(rows):
            yield from block.take(pa.array(rows)).combine_chunks().to_batches()


@tidy
def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _by_block(batches):
        comps, ids = block.column("component").to_pylist(), block.column("id").to_pylist()
        sets = [_set(x) for x in block.column("shingles")]
        parent = {c: c for c in comps}

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        found = []
        pairs = _block_pairs(block)
        for a, b in pairs[np.argsort(-pairs[:, 0], kind="stable"), 1:].tolist() if len(pairs) else ():
            x, y = top(comps[a]), top(comps[b])
            if x != y and linked(sets[a], sets[b]):
                parent[max(x, y)] = min(x, y)
                found.append((ids[a], ids[b]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


_ROW = "g long, side long, band int, id long, component long, bits array<long>, bands array<long>"


def mixed_members(keys: DataFrame, reps: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of band buckets with several components that have a possible partner in another one, by block."""
    placed = keys.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") * 16 / BLOCK_BYTES)).cast("int")
    mixed = placed.groupBy("key").agg(blocks.alias("blocks"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "blocks")
    mixed = written(mixed, "mixed-keys")
    rows = placed.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"),
        # Within one block all pairs count; between two only those across.
        F.when(F.col("own") == F.col("other"), -1).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1)).cast("long").alias("side"),
        "band", "id", "component",
    )
    full = dealt.join(reps, "id").select("g", "side", "band", "id", "component", "bits", "bands")
    return full.repartition("g").sortWithinPartitions("g").mapInArrow(_needed, _ROW)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    signed = written(signatures(docs), "signatures")
    named = signed.where("doc_id IS NOT NULL")
    digest = ["n_shingles", "d0", "d1"]
    # Only sets of several rows need a common id. Written, so that the join sees plain tables and may deal out a frequent set anew.
    classes = written(named.where("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).where("n > 1").drop("n"), "classes")
    members = written(named.select("doc_id", *digest).join(classes, digest, "left").select("doc_id", *digest, F.coalesce("id", "doc_id").alias("id")), "members")
    own = members.where("doc_id = id AND n_shingles > 0").select("id", *digest).distinct().alias("own")
    same = [F.col("own.id") == F.col("row.doc_id"), *[F.col(f"own.{c}") == F.col(f"row.{c}") for c in digest]]
    # One row a set; a doc_id with several texts has several, and its ids are linked below.
    reps = written(named.alias("row").join(own, same).select("id", *[F.col(f"row.{c}") for c in digest], "bits", "bands").dropDuplicates(["id", *digest]).drop("d0", "d1"), "representatives")
    spread = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("hi")).where("a <> hi").select("doc_id", "a")
    same_doc = written(members.join(spread, "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct(), "same-document")

    every = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = written(every.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("centre")).where("n > 1").drop("n"), "shared-keys")
    keys = written(every.join(shared, "key"), "band-keys")
    stars = keys.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    bits = lambda name: reps.select(F.col("id").alias(name), F.col("bits").alias(f"bits_{name}"))
    likely = written(stars.join(bits("a"), "a").join(bits("b"), "b").where(equal_bits("bits_a", "bits_b") >= LEAST_EQUAL).select("a", "b").distinct(), "star-pairs")

    # Sets are needed of those only that some partner resembles.
    known = written(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    sets = written(sets_of(docs, known), "sets")
    links = written(confirmed(likely, sets).union(same_doc), "star-links")
    comp = written(components(links), "components")
    met = written(mixed_members(keys.select("key", "band", "id", "n_shingles"), reps, comp), "mixed-members")
    discard(shared, keys, likely)
    lacking = written(met.select(F.col("id").alias("doc_id")).distinct().join(sets.select("doc_id"), "doc_id", "left_anti"), "wanted")
    full = met.join(sets.union(sets_of(docs, lacking)).withColumnRenamed("doc_id", "id"), "id").select("g", "side", "band", "id", "component", "bits", "bands", "shingles")
    found = written(full.repartition("g").sortWithinPartitions("g").mapInArrow(_block_links, "a long, b long"), "mixed-links")
    if not found.isEmpty():
        discard(comp)
        comp = written(components(links.union(found)), "components")
    discard(classes, reps, same_doc, known, lacking, sets, met, links, found)
    placed = members.select("doc_id", "n_shingles", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    nameless = signed.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return placed.union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group its smallest doc_id stays."""
    return docs.join(near_duplicates(docs).where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


SQL = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM lowered),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
either_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS other FROM either_way UNION SELECT r.doc_id, e.b FROM reach r JOIN either_way e ON r.other = e.a),
least_id AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM sized d LEFT JOIN least_id c USING (doc_id)
"""
