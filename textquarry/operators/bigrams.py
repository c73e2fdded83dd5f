"""Bigrams of texts as numpy arrays: hashes of a text's bigrams, bigrams packed by parts of the hashes' range, candidates.

Functions over Arrow batches, for ``mapInArrow`` and ``applyInArrow``; ``similarity`` plans them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from textquarry.functions.text import UNSPACED

#: Bytes of text that are hashed together, and pairs that are made together.
SLICE, MADE = 1 << 20, 1 << 20
#: From this count on a bigram's frequency is kept to within an eighth.
EXACT = 128
_UNSPACED = re.compile(UNSPACED)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = 0x20
#: More than any set has bigrams.
_SIZES = 1 << 26


def _place(n: int) -> np.ndarray:
    """A multiplier for each place in a token."""
    return mix(np.arange(n, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(7)) | np.uint64(1)


def spaced(text: str) -> bytes:
    """A normalised text, with spaces between the characters of words in unspaced scripts."""
    raw = text.encode("utf-8", "surrogatepass")
    # The first character of these scripts takes three bytes.
    if raw and not text.isascii() and np.frombuffer(raw, np.uint8).max() >= 0xE0 and _UNSPACED.search(text):
        raw = " ".join(" ".join(w) if _UNSPACED.search(w) else w for w in text.split(" ")).encode("utf-8", "surrogatepass")
    return raw


def hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct pairs of neighbouring tokens of each text; every space parts two tokens."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.flatnonzero(joined == _SPACE)
    starts = np.append(0, ends[:-1] + 1)
    sizes = ends - starts
    place = np.arange(len(joined), dtype=np.int64) - np.repeat(starts, sizes + 1)
    upto = np.append(np.uint64(0), np.cumsum(_BYTE[joined] * _place(int(sizes.max()) + 1)[place], dtype=np.uint64))
    token = mix((upto[ends] - upto[starts]) + sizes.astype(np.uint64))
    pair = np.append(mix(token[:-1] * np.uint64(0x9FB21C651E98DF25) + mix(token[1:])), np.uint64(0)).view(np.int64)
    # The last token of a text has no neighbour.
    last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1)
    first = np.append(0, last[:-1] + 1)
    return [np.unique(pair[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def of_texts(keys: list[str], common: dict | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (cohort, id, normtext) to (cohort, id, hs); ``common`` has what is taken from a cohort's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = 0, [], 0
            texts = batch.column("normtext")
            cohorts = batch.column("cohort").to_pylist() if common is not None else None
            for k in range(len(texts)):
                held.append(spaced(texts[k].as_py()))
                size += len(held[-1])
                if size >= SLICE or k == len(texts) - 1:
                    sets = hashes(held)
                    if common:
                        sets = [np.setdiff1d(s, t, assume_unique=True) if (t := common.get(c)) is not None else s for s, c in zip(sets, cohorts[at : k + 1], strict=True)]
                    offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                    hs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, k + 1 - at) for c in keys], hs], names=[*keys, "hs"])
                    at, held, size = k + 1, [], 0

    return run


#: Packed bigrams of a document (c: hash of the cohort) in a part of the hashes' range: the lower 32 bits of each as h.
DEALT = "part int, c long, id long, size int, fresh boolean, h binary"
#: The same of those that several documents have, and how many have them as a byte each: f.
SHARED = "part int, c long, id long, size int, fresh boolean, h binary, f binary"
#: The same of those that stand among a document's rarest, with their place in its order as two bytes each: at.
RARE = "part int, c long, id long, size int, fresh boolean, h binary, at binary"
CANDIDATES = "a long, b long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _numbers(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and behind the last."""
    n = len(sorted_by[0])
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for x in sorted_by:
        new[1:n] |= x[1:] != x[:-1]
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


def dealt(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bigrams dealt out to n parts by their upper 16 bits."""
        for batch in batches:
            if not batch.num_rows:
                continue
            c, ids, sizes = (batch.column(k).to_numpy() for k in ("c", "id", "size"))
            fresh = batch.column("fresh").to_numpy(zero_copy_only=False)
            key = mix(batch.column("hs").flatten().to_numpy().view(np.uint64) + mix(np.repeat(c.view(np.uint64), sizes)))
            row = np.repeat(np.arange(len(ids)), sizes)
            part = (key >> np.uint64(48)).astype(np.int64) * n >> 16
            order = np.argsort(part * len(ids) + row, kind="stable")
            low, part, row = key[order].astype("<u4"), part[order], row[order]
            at = _runs(part, row)
            k = row[at[:-1]]
            yield _batch(DEALT, [part[at[:-1]], c[k], ids[k], sizes[k], fresh[k], [low[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]])

    return run


def frequency(df: np.ndarray) -> np.ndarray:
    """A byte that grows with the count."""
    return np.where(df < EXACT, df, np.minimum(255, EXACT + 6 * np.log2(np.maximum(df, EXACT) / EXACT))).astype(np.uint8)


def counted(group: pa.Table) -> pa.Table:
    """The bigrams of a part that several documents have."""
    key = _numbers(group.column("h"), "<u4")
    row = np.repeat(np.arange(group.num_rows, dtype=np.int32), [len(x) // 4 for x in group.column("h").to_pylist()])
    order = np.argsort(key, kind="stable")
    at = _runs(key[order])
    df = np.repeat(np.diff(at), np.diff(at))
    f = np.zeros(len(key), np.uint8)
    f[order] = frequency(df)
    some = np.flatnonzero(f > 1)
    key, f, row = key[some], f[some], row[some]
    at = _runs(row)
    kept = group.take(pa.array(row[at[:-1]]))
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.Table.from_batches([_batch(SHARED, [*[kept.column(c).combine_chunks() for c in ("part", "c", "id", "size", "fresh")], cut(key), cut(f)])])


def rarest(bound: float) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        """Of each document the bigrams that a document as similar as ``bound`` shares one of.

        They are ordered by how many documents have them; those that only one document has stand in front.
        """
        c, ids, size, part = (group.column(k).to_numpy() for k in ("c", "id", "size", "part"))
        key, f = _numbers(group.column("h"), "<u4"), _numbers(group.column("f"), np.uint8)
        row = np.repeat(np.arange(len(ids)), [len(x) for x in group.column("f").to_pylist()])
        by_doc = np.lexsort((ids, c))
        at = _runs(c[by_doc], ids[by_doc])
        doc = np.empty(len(ids), np.int64)
        doc[by_doc] = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((key, part[row], doc[row].astype(np.uint64) << np.uint64(8) | f))
        row, key = row[order], key[order]
        at = _runs(doc[row])
        n = np.diff(at)
        rank = np.arange(len(row)) - np.repeat(at[:-1], n)
        all_ = size[row].astype(np.int64)
        place = all_ - np.repeat(n, n) + rank
        # Of equal keys in one document the first one tells all.
        first = np.append(True, (key[1:] != key[:-1]) | (part[row[1:]] != part[row[:-1]]) | (doc[row[1:]] != doc[row[:-1]])) if len(row) else np.zeros(0, bool)
        some = np.flatnonzero(first & (place < all_ - np.ceil(all_ * bound).astype(np.int64) + 1))
        row, key, place = row[some], key[some], place[some]
        order = np.argsort(row, kind="stable")
        row, key, place = row[order], key[order], place[order].astype("<u4")
        at = _runs(row)
        kept = group.take(pa.array(row[at[:-1]]))
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.Table.from_batches([_batch(RARE, [*[kept.column(k).combine_chunks() for k in ("part", "c", "id", "size", "fresh")], cut(key), cut(place)])])

    return run


def _met(rows: pa.Table, bound: float, only_fresh: bool) -> Iterator[pa.RecordBatch]:
    key, place = _numbers(rows.column("h"), "<u4"), _numbers(rows.column("at"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(rows.num_rows), [len(x) // 4 for x in rows.column("h").to_pylist()])
    c, ids, size, part = (rows.column(k).to_numpy()[row] for k in ("c", "id", "size", "part"))
    fresh = rows.column("fresh").to_numpy()[row]
    order = np.lexsort((size, c, key, part))
    key, place, c, ids, size, part, fresh = (x[order] for x in (key, place, c, ids, size.astype(np.int64), part, fresh))
    at = _runs(part, key, c)
    group = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # Within a group sizes grow, so those that fit one stand together behind it.
    ranked = group * _SIZES + size
    last = np.searchsorted(ranked, group * _SIZES + np.floor(size / bound + 1e-6).astype(np.int64), "right")
    here = np.arange(len(ids))
    if only_fresh:
        start = np.searchsorted(ranked, group * _SIZES + np.ceil(size * bound - 1e-6).astype(np.int64), "left")
        source = np.flatnonzero(fresh)
    else:
        start, source = here + 1, here
    n = np.maximum(0, last - start)[source]
    upto = np.append(0, np.cumsum(n))
    done, total = 0, int(upto[-1])
    while done < total:
        # A document's partners may lie in several rounds.
        k = np.arange(done, min(total, done + MADE))
        done += len(k)
        x = np.searchsorted(upto, k, "right") - 1
        a = source[x]
        b = start[a] + k - upto[x]
        # What stands behind the first bigram in common must suffice.
        least = np.ceil((size[a] + size[b]) * (bound / (1 + bound)) - 1e-6)
        fits = (ids[a] != ids[b]) & (np.minimum(size[a] - place[a], size[b] - place[b]) >= least)
        a, b = ids[a[fits]], ids[b[fits]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        if len(pairs):
            yield _batch(CANDIDATES, [pairs[:, 0], pairs[:, 1]])


def met(bound: float, only_fresh: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of documents that have one of their rarest bigrams in common, once for each round they are made in."""
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _met(pa.Table.from_batches(held), bound, only_fresh)

    return run
