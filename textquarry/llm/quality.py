"""Quality rules (operator 8): base counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted in one pass: the *target* over documents that the
labels call good, the *raw* one over every document. A document's score is the sum over its features of
``log(target / raw)``, divided by the number of features. Log ratios are kept as whole numbers (units of 2**-16), so
sums, scores and verdicts do not depend on the order of work. The threshold is the mean of two averages: the mean
score per feature over documents labelled good and over documents labelled bad, both summed over all labelled rows.

Cases: a null or empty text has no words and fails the base rule; with no good or no bad label there is nothing to
compare and only the base rule rejects; several labels of one document count as good only if all are; labels of
documents that are not there are without effect; rows with one doc_id are judged each by its own text and share a label.
A text of any length is one row of work. Columns other than doc_id and text pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import arrays as A
from textquarry.llm.common import parts, table, tidy

#: Buckets of hashed features (a power of two), and how many travel in one row.
BUCKET_BITS = 18
SLICE_BITS = 12
#: Bytes of text in work at a time, and labelled documents up to which the labels are sent to every executor.
SLICE_BYTES = 1 << 20
SENT_LABELS = 1_000_000
UNIT = 1 << 16
_PAIR = np.uint64(0xD6E8FEB86659FD93)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def features(hashes: np.ndarray, word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all unigrams and then all bigrams, and the row of each."""
    row = A.rows_of(word_offsets)
    shift = np.uint64(64 - BUCKET_BITS)
    inside = row[1:] == row[:-1]
    pairs = A.shingle_hashes(hashes, 2)[inside] if len(hashes) else hashes
    return np.concatenate([hashes >> shift, pairs >> shift]).astype(np.int64), np.concatenate([row, row[1:][inside]] if len(row) else [row])


def base_counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, word_offsets: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    n_words = np.diff(word_offsets)
    ends_line = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    line_start = np.union1d(np.flatnonzero(ends_line) + 1, offsets[:-1]) if len(data) else np.zeros(0, np.int64)
    # A line begins at a row's start and after each \n; one after a last \n has no word and does not count.
    line_start = line_start[line_start < len(data)]
    if len(line_start):
        stop = np.append(line_start[1:], len(data))
        line_end = stop - ends_line[stop - 1]
        row = np.searchsorted(offsets, line_start, side="right") - 1
        has = np.searchsorted(starts, stop) > np.searchsorted(starts, line_start)
        line_start, line_end, row = line_start[has], line_end[has], row[has]
        key = A.mix(A.segment_hashes(data, line_start, line_end) + row.astype(np.uint64) * _PAIR)
        _, first = np.unique(key, return_index=True)
        dup_lines = np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)
    else:
        dup_lines = np.zeros(rows, np.int64)

    covered = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        row = A.rows_of(word_offsets)
        inside = row[2:] == row[:-2]
        three = A.mix(A.shingle_hashes(hashes, 3) + A.mix(row[2:].astype(np.uint64)))
        again = np.zeros(len(three), bool)
        again[inside] = A.repeated(three[inside])
        for shift in range(3):
            covered[shift : shift + len(three)] |= again
    repeat_words = A.per_row(covered, word_offsets)
    return {
        "n_words": n_words,
        "word_chars": A.per_row(~A.SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": A.per_row(SYMBOL[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": (n_words < 50) | (100 * repeat_words > 50 * n_words),
    }


def _read(batch: pa.RecordBatch):
    data, offsets = A.texts(batch.column("text"))
    starts, ends, word_offsets = A.words(data, offsets)
    return data, offsets, starts, word_offsets, A.segment_hashes(data, starts, ends)


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's rows: kind 0 all, 1 labelled good, 2 labelled bad; one row for each kind and slice of buckets."""
    counts = np.zeros((3, 1 << BUCKET_BITS), np.int64)
    for batch in parts(batches, "text", SLICE_BYTES):
        _, _, _, word_offsets, hashes = _read(batch)
        bucket, row = features(hashes, word_offsets)
        label = batch.column("good").fill_null(-1).to_numpy(zero_copy_only=False)[row] if len(row) else row
        counts[0] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
        for kind, wanted in ((1, 1), (2, 0)):
            counts[kind] += np.bincount(bucket[label == wanted], minlength=1 << BUCKET_BITS)
    sliced = counts.reshape(3, -1, 1 << SLICE_BITS)
    found = [(k, s) for k in range(3) for s in range(sliced.shape[1]) if sliced[k, s].any()]
    yield pa.RecordBatch.from_pydict(
        {"kind": pa.array([k for k, _ in found], pa.int32()), "slice": pa.array([s for _, s in found], pa.int32()), "counts": pa.array([sliced[k, s].tobytes() for k, s in found], pa.binary())}
    )


def _add(group: pa.Table) -> pa.Table:
    total = np.zeros(1 << SLICE_BITS, np.int64)
    for blob in group.column("counts"):
        total += np.frombuffer(blob.as_py(), np.int64)
    return pa.table({"kind": group.column("kind")[:1], "slice": group.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


@dataclass(frozen=True)
class Ratios:
    """Log ratios of all buckets in units of 2**-16, and the threshold for their mean; no threshold: nothing is rejected."""

    units: np.ndarray
    threshold: float | None


def fit(docs: DataFrame, labels: DataFrame) -> Ratios:
    """Count both multinomials over all of ``docs``. What comes to the driver is three vectors of 2**18 counts."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))
    # Beyond the bound texts and labels meet by a shuffle.
    good = F.broadcast(good) if good.count() <= SENT_LABELS else good.hint("shuffle_hash")
    rows = docs.select("doc_id", "text").join(good, "doc_id", "left").select("text", "good")
    sums = rows.mapInArrow(_count, "kind int, slice int, counts binary").groupBy("kind", "slice").applyInArrow(_add, "kind int, slice int, counts binary")
    counts = np.zeros((3, 1 << (BUCKET_BITS - SLICE_BITS), 1 << SLICE_BITS), np.int64)
    for kind, piece, blob in sums.collect():
        counts[kind, piece] = np.frombuffer(bytes(blob), np.int64)
    raw, target, bad = counts.reshape(3, -1)
    if not target.sum() or not bad.sum():
        return Ratios(np.zeros(1 << BUCKET_BITS, np.int64), None)
    size = 1 << BUCKET_BITS
    share = lambda c: np.log((c + 1.0) / (float(c.sum()) + size))
    units = np.rint((share(target) - share(raw)) * UNIT).astype(np.int64)
    mean = lambda c: float((units * c).sum()) / float(c.sum())
    return Ratios(units, (mean(target) + mean(bad)) / 2)


def judge(batch: pa.RecordBatch, ratios: Ratios) -> dict[str, np.ndarray]:
    data, offsets, starts, word_offsets, hashes = _read(batch)
    out = base_counts(data, offsets, starts, word_offsets, hashes)
    bucket, row = features(hashes, word_offsets)
    total = np.bincount(row, weights=ratios.units[bucket], minlength=batch.num_rows).astype(np.int64)  # whole numbers far below 2**53
    n = np.bincount(row, minlength=batch.num_rows)
    likely = np.ones(batch.num_rows, bool) if ratios.threshold is None else total >= ratios.threshold * n
    return out | {"kept": ~out["base_failed"] & likely, "score_units": total, "n_features": n, "score": total / np.maximum(n, 1) / UNIT}


def measure(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """doc_id, the base counts, score_units (sum of log ratios), n_features, score (their mean, in nats) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", SLICE_BYTES):
            out = judge(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out.values())], names=["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id long, {STATS}, kept boolean, score_units long, n_features long, score double")


def accepted(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", SLICE_BYTES):
            yield batch.filter(pa.array(judge(batch, shared.value)["kept"]))

    return docs.mapInArrow(keep, docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``docs`` with ``labels`` (doc_id, quality) and judge every row of ``docs`` (doc_id, text)."""
    return measure(docs, fit(docs, labels))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, the columns of documents stay."""
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))
