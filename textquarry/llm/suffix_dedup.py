"""Suffix-array removal of repeated bytes (operator 1), blockwise with a difference-cover sample.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id.

Two equal windows of 50 bytes have the same *anchor*: the smallest hash among their substrings of ``ANCHOR`` bytes. So

1. each document's distinct anchors are dealt out by value; those of two or more documents come back to the pieces
   (hash partitions of documents) that hold them;
2. each piece cuts its texts into runs of windows with one anchor, drops the runs whose anchor nobody else has, and
   sends the distinct rest (bytes, smallest doc_id) to the block of the anchor. Runs of an anchor that very many
   documents have are cut into single windows first and dealt by window, so no anchor gathers in one block;
3. a block is one text of bounded size. Its suffixes are sorted one bucket at a time: ranks of the suffixes in a
   difference-cover sample are computed first (to at least 50 bytes, by doubling); suffixes of a bucket are sorted by
   their first ``COVER`` bytes, and ties are resolved by the sample ranks at the offset at which both suffixes meet the
   sample. Neighbours that share 50 bytes form a class with a smallest doc_id, which goes back to the pieces;
4. each piece marks the bytes whose windows have a smaller doc_id.

Documents whose whole text is that of a smaller doc_id take no part: all their bytes go (if there are 50).

Cases: a null or empty text has nothing to remove; a row without doc_id neither loses bytes nor makes others lose any;
rows with the same doc_id do not affect each other. A text of any length is one row of work, cut into runs of bounded size.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import arrays as A
from textquarry.llm.common import parts, pieces_for, release, table, written

WIDTH = 50
ANCHOR = 20
#: A run holds at most so many windows (only text of short period makes longer ones).
LONGEST_RUN = 64
#: Documents from which an anchor's runs are dealt out by single windows.
FREQUENT = 1000
PIECE_BYTES = 4 << 20
#: Bytes of text whose windows are held at a time.
SLICE_BYTES = 1 << 19
#: A difference cover modulo 13: every difference occurs between two of its members.
COVER, MEMBERS = 13, (0, 1, 3, 9)
#: Suffixes of a bucket that is sorted at a time.
BUCKET = 1 << 18
_PIECES = "p long, kind int, blob binary, ids array<string>"
_KIND = {"anchors": 0, "copies": 1, "smaller": 2}


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    blobs = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
    head = np.array([len(blobs), *map(len, blobs)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(blobs))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at = 8 * (n + 1) + np.concatenate([[0], np.cumsum(sizes)])
    return [raw[a:b] for a, b in zip(at, at[1:])]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[A.Hasher, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hasher, first window, number of windows, anchor, row) of all runs of windows with one anchor."""
    hasher = A.Hasher(data)
    n_windows = np.maximum(np.diff(offsets) - (WIDTH - 1), 0)
    if not n_windows.any():
        none = np.zeros(0, np.int64)
        return hasher, none, none, none.astype(np.uint64), none
    least = A.slide_min(hasher.windows(ANCHOR), WIDTH - ANCHOR + 1) >> np.uint64(16)
    at = A.ragged(offsets[:-1], n_windows)
    row = np.repeat(np.arange(len(n_windows)), n_windows)
    anchor = least[at]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    if (count > LONGEST_RUN).any():
        new |= (np.arange(len(at)) - np.repeat(first, count)) % LONGEST_RUN == 0
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
    return hasher, at[first], count, anchor[first], row[first]


def _part_of(values: np.ndarray, n: int) -> np.ndarray:
    """Which of n parts a value belongs to; mixed first, as anchors are minima and so mostly small."""
    return ((A.mix(values) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, the places where it stands) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(keys) else []:
        yield int(keys[part[0]]), part


def _anchors(n: int):
    """Of each document its distinct anchors, with its piece, in blobs by the anchor's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            release()
            anchor, piece = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # One entry an anchor and piece, however many documents have it.
            order = np.lexsort((piece, anchor))
            anchor, piece = anchor[order], piece[order]
            first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]))) if len(anchor) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(anchor))).astype(np.uint32)
            anchor, piece = anchor[first], piece[first]
            found = list(_groups(_part_of(anchor, n)))
            blobs = [_pack(anchor[at].view(np.uint8).reshape(-1, 8)[:, :6].copy(), piece[at].astype(np.uint32), count[at]) for _, at in found]
            return pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in found], pa.int64()), "blob": pa.array(blobs, pa.binary())})

        for batch in parts(batches, "text", SLICE_BYTES):
            data, offsets = A.texts(batch.column("text"))
            _, _, _, anchor, row = runs(data, offsets)
            order = np.lexsort((row, anchor))
            anchor, row = anchor[order], row[order]
            own = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            held.append((anchor[own], batch.column("p").to_numpy()[row[own]]))
            if sum(len(x) for x, _ in held) > 500_000:
                yield flush()
        if held:
            yield flush()

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Anchors of a part that two or more documents have, for each piece; those of many documents are marked (bit 63)."""
    release()
    anchors, pieces, counts = [], [], []
    for blob in group.column("blob"):
        raw, piece, many = _unpack(blob.as_py())
        full = np.zeros((len(raw) // 6, 8), np.uint8)
        full[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        anchors.append(full.view(np.uint64).reshape(-1))
        pieces.append(np.frombuffer(piece, np.uint32))
        counts.append(np.frombuffer(many, np.uint32))
    anchor, piece, count = np.concatenate(anchors), np.concatenate(pieces), np.concatenate(counts).astype(np.int64)
    order = np.argsort(anchor, kind="stable")
    anchor, piece = anchor[order], piece[order]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
    # Documents that have the anchor, at each of its entries.
    count = np.repeat(np.add.reduceat(count[order], first), np.diff(np.append(first, len(anchor)))) if len(anchor) else count
    keep = count > 1
    anchor, piece = anchor[keep] | ((count[keep] >= FREQUENT).astype(np.uint64) << np.uint64(63)), piece[keep]
    found = [(k, np.unique(anchor[at])) for k, at in _groups(piece)]
    return _piece_rows("anchors", [(k, _pack(x)) for k, x in found])


def _piece_rows(kind: str, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table(
        {"p": pa.array([k for k, _ in rows], pa.int64()), "kind": pa.array([_KIND[kind]] * len(rows), pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary()), "ids": pa.nulls(len(rows), pa.list_(pa.string()))}
    )


class Piece:
    """A piece's texts with what others told it; ``each`` gives slices of rows with their compared runs."""

    def __init__(self, docs: pa.Table, told: pa.Table):
        self.docs = docs
        kinds = told.column("kind").to_pylist()
        blobs = {k: [_unpack(told.column("blob")[i].as_py()) for i, x in enumerate(kinds) if x == _KIND[k]] for k in ("anchors", "smaller")}
        marked = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(b[0], np.uint64) for b in blobs["anchors"]]])
        self.anchors = np.sort(marked & np.uint64((1 << 48) - 1))
        self.frequent = np.sort(marked[marked >> np.uint64(63) > 0] & np.uint64((1 << 48) - 1))
        self.smaller = blobs["smaller"]
        self.copies = {x for i, k in enumerate(kinds) if k == _KIND["copies"] for x in told.column("ids")[i].as_py()}
        self.copy_ids = {int(x.split(":")[0]) for x in self.copies}

    def is_copy(self, doc_id: int | None, text: bytes) -> bool:
        return doc_id in self.copy_ids and f"{doc_id}:{hashlib.md5(text).hexdigest()}" in self.copies

    def each(self):
        for batch in parts(iter(self.docs.to_batches()), "text", SLICE_BYTES):
            ids = batch.column("doc_id").to_pylist()
            data, offsets = A.texts(batch.column("text"))
            at = offsets.tolist()
            copy = np.array([self.is_copy(d, data[a:b].tobytes() if d in self.copy_ids else b"") for d, a, b in zip(ids, at, at[1:])], bool)
            hasher, first, count, anchor, row = runs(data, offsets)
            doc = np.array([-1 if d is None else d for d in ids], np.int64)[row] if len(row) else np.zeros(0, np.int64)
            alone = copy | np.array([d is None for d in ids], bool)
            keep = _among(anchor, self.anchors) & ~alone[row] if len(row) else np.zeros(0, bool)
            first, count, anchor, doc = first[keep], count[keep], anchor[keep], doc[keep]
            split = _among(anchor, self.frequent)
            single = A.ragged(first[split], count[split])
            first = np.concatenate([first[~split], single])
            doc = np.concatenate([doc[~split], np.repeat(doc[split], count[split])])
            count, anchor = np.concatenate([count[~split], np.ones(len(single), np.int64)]), anchor[~split]
            key = hasher(first, first + count + (WIDTH - 1))
            route = np.concatenate([anchor, key[len(anchor) :] >> np.uint64(16)])
            yield ids, data, offsets, copy, first, count, doc, key, route


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _send(n: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        """The piece's distinct runs with their smallest doc_id, in blobs by block."""
        release()
        held = []
        for _, data, _, _, first, count, doc, key, route in Piece(docs, told).each():
            order = np.lexsort((doc, key))
            order = order[np.append(True, np.diff(key[order]) != 0)] if len(order) else order
            size = count[order] + (WIDTH - 1)
            held.append((key[order], doc[order], route[order], size, data[A.ragged(first[order], size)]))
        empty = pa.table({"part": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        if not held or not sum(len(x[0]) for x in held):
            return empty
        key, doc, route, size, text = (np.concatenate(x) for x in zip(*held, strict=True))
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, key))
        order = order[np.append(True, np.diff(key[order]) != 0)]
        rows = []
        for part, at in _groups(_part_of(route[order], n)):
            at = order[at]
            rows.append((part, _pack(key[at], doc[at], size[at].astype(np.uint32), text[A.ragged(begin[at], size[at])])))
        p = docs.column("p")[0].as_py()
        return pa.table({"part": pa.array([k for k, _ in rows], pa.int64()), "p": pa.array([p] * len(rows), pa.int64()), "blob": pa.array([b for _, b in rows], pa.binary())})

    return run


def _meet() -> np.ndarray:
    """For residues a and b of two suffixes, the offset below COVER at which both meet the sample."""
    out = np.zeros((COVER, COVER), np.int64)
    for a in range(COVER):
        for b in range(COVER):
            out[a, b] = next(d for d in range(COVER) if (a + d) % COVER in MEMBERS and (b + d) % COVER in MEMBERS)
    return out


_MEET = _meet()


def _word(padded: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n bytes (8 at most) from each place, as a number that orders as they do."""
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    return words[at].astype(np.uint64) >> np.uint64(64 - 8 * n)


def _order(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by high and then by low (of so many bits), and where in it rows differ from the one before."""
    order = np.argsort(high)
    step = np.append(False, np.diff(high[order]) != 0) if len(order) else np.zeros(0, bool)
    rank = np.cumsum(step).astype(np.uint64)
    if len(rank) and int(rank[-1]) >> (64 - bits):
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        return order, np.append(False, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
    key = rank << np.uint64(bits) | low[order].astype(np.uint64)
    again = np.argsort(key)
    key = key[again]
    return order[again], np.append(False, key[1:] != key[:-1]) if len(key) else step


def _dense(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Ranks from 0 of rows by high and then by low; equal rows have equal ranks."""
    order, step = _order(high, low, bits)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def sample_ranks(padded: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the suffixes in the sample by at least WIDTH bytes (by 4 * COVER), at their places; 0 elsewhere."""
    at = np.flatnonzero(np.isin(np.arange(n + COVER) % COVER, MEMBERS))
    rank = np.zeros(n + 4 * COVER, np.int64)
    rank[at] = _dense(_word(padded, at, 8), _word(padded, at + 8, COVER - 8), 8 * (COVER - 8)) + 1
    reach = COVER
    while reach < WIDTH:
        rank[at] = _dense(rank[at], rank[np.minimum(at + reach, len(rank) - 1)], 32) + 1
        reach *= 2
    return rank


def sorted_suffixes(text: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """The suffixes at ``starts`` in order (to at least WIDTH bytes), one bucket of leading bytes after the other."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(5 * COVER + 8, np.uint8)])
    rank = sample_ranks(padded, n)
    lead = _word(padded, starts, 2).astype(np.int64)
    in_order = np.argsort(lead, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(lead[in_order]) != 0)) if len(starts) else np.zeros(0, np.int64)
    edges = np.append(edges, len(starts))
    a = 0
    while a < len(edges) - 1:
        b = a + 1
        while b < len(edges) - 1 and edges[b + 1] - edges[a] <= BUCKET:
            b += 1
        yield _sort_bucket(padded, rank, starts[in_order[edges[a] : edges[b]]])
        a = b


def _sort_bucket(padded: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    high, low = _word(padded, at, 8), _word(padded, at + 8, COVER - 8)
    order, step = _order(high, low, 8 * (COVER - 8))
    at, group = at[order], np.cumsum(step)
    out = np.empty_like(at)
    place = np.arange(len(at))
    # Groups of ties are parted around their first member, all groups at a time, until only equals remain.
    while len(at):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        pivot = np.repeat(at[first], size)
        offset = _MEET[at % COVER, pivot % COVER]
        side = np.sign(rank[at + offset] - rank[pivot + offset])
        order = np.argsort(3 * group + side)
        at, group, side = at[order], group[order], side[order]
        done = (side == 0) | (np.repeat(size, size) == 1)
        out[place[done]] = at[done]
        at, place = at[~done], place[~done]
        group = np.cumsum(np.append(False, (group[~done][1:] != group[~done][:-1]) | (side[~done][1:] != side[~done][:-1])))[: len(at)]
    return out


def least_of_windows(text: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every window of every run (bytes of one text), the smallest doc of the runs that hold an equal window."""
    count = size - (WIDTH - 1)
    starts = A.ragged(begin, count)
    own = np.repeat(doc, count)
    number = np.full(len(text), -1, np.int64)
    number[starts] = np.arange(len(starts))
    out = np.empty(len(starts), np.int64)
    words = np.ndarray((max(0, len(text) - 7),), np.uint64, np.ascontiguousarray(text), strides=(1,))
    for at in sorted_suffixes(text, starts):
        same = np.zeros(len(at), bool)
        for a in range(1, len(at), 1 << 16):
            b = min(len(at), a + (1 << 16))
            same[a:b] = True
            for k in (*range(0, WIDTH - 7, 8), WIDTH - 8):
                word = words[at[a - 1 : b] + k]
                same[a:b] &= word[1:] == word[:-1]
        first = np.flatnonzero(~same)
        which = number[at]
        least = np.minimum.reduceat(own[which], first)
        out[which] = np.repeat(least, np.diff(np.append(first, len(at))))
    return out


def _block(group: pa.Table) -> pa.Table:
    """Sort a block's windows; each piece hears of those of its runs that have a window with a smaller doc_id elsewhere."""
    release()
    sent = [(p, *_unpack(blob.as_py())) for p, blob in zip(group.column("p").to_pylist(), group.column("blob"), strict=True)]
    key = np.concatenate([np.frombuffer(x[1], np.uint64) for x in sent])
    doc = np.concatenate([np.frombuffer(x[2], np.int64) for x in sent])
    size = np.concatenate([np.frombuffer(x[3], np.uint32) for x in sent]).astype(np.int64)
    text = np.concatenate([np.frombuffer(x[4], np.uint8) for x in sent])
    piece = np.repeat([x[0] for x in sent], [len(x[1]) // 8 for x in sent])
    begin = np.cumsum(size) - size
    order = np.lexsort((doc, key))
    first = np.append(True, np.diff(key[order]) != 0)
    own = order[first]
    window_at = np.cumsum(size[own] - (WIDTH - 1)) - (size[own] - (WIDTH - 1))
    packed_text = text[A.ragged(begin[own], size[own])]
    least = least_of_windows(packed_text, np.cumsum(size[own]) - size[own], size[own], doc[own])
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(first) - 1
    smallest = np.minimum.reduceat(least, window_at)
    largest = np.maximum.reduceat(least, window_at)
    tell = np.flatnonzero(smallest[which] < doc)
    rows = []
    for p, at in _groups(piece[tell]):
        at = tell[at]
        run = which[at]
        even = smallest[run] == largest[run]
        odd = run[~even]
        # A run with one smallest doc_id for all its windows, or else one for each.
        rows.append((p, _pack(key[at[even]], smallest[run[even]], key[at[~even]], (size[own][odd] - (WIDTH - 1)).astype(np.int64), least[A.ragged(window_at[odd], size[own][odd] - (WIDTH - 1))])))
    return _piece_rows("smaller", rows)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        release()
        piece = Piece(docs, told)
        columns = [[np.frombuffer(b[k], t) for b in piece.smaller] for k, t in enumerate((np.uint64, np.int64, np.uint64, np.int64, np.int64))]
        even_key, even_doc, odd_key, odd_count, odd_doc = (np.concatenate([np.zeros(0, c[0].dtype if c else np.int64), *c]) for c in columns)
        if not piece.smaller:
            even_key, odd_key = even_key.astype(np.uint64), odd_key.astype(np.uint64)
        odd_at = np.cumsum(odd_count) - odd_count
        even_order, odd_order = np.argsort(even_key), np.argsort(odd_key)
        even_key, even_doc = even_key[even_order], even_doc[even_order]
        odd_key, odd_at = odd_key[odd_order], odd_at[odd_order]
        slices = list(piece.each())
        # Within the piece the smallest doc of a run's exact bytes is known here.
        key, doc = (np.concatenate([x[k] for x in slices]) if slices else np.zeros(0, t) for k, t in ((7, np.uint64), (6, np.int64)))
        order = np.lexsort((doc, key))
        first = np.append(True, np.diff(key[order]) != 0) if len(key) else np.zeros(0, bool)
        here_key, here_doc = key[order][first], doc[order][first]
        rows = []
        for ids, data, offsets, copy, begin, count, doc, key, _ in slices:
            least = here_doc[np.searchsorted(here_key, key)] if len(key) else doc
            told_even = _among(key, even_key)
            least = least.copy()
            least[told_even] = even_doc[np.searchsorted(even_key, key[told_even])]
            per_window = np.repeat(least, count)
            odd = np.flatnonzero(_among(key, odd_key))
            if len(odd):
                window_at = np.cumsum(count) - count
                per_window[A.ragged(window_at[odd], count[odd])] = odd_doc[A.ragged(odd_at[np.searchsorted(odd_key, key[odd])], count[odd])]
            hit = A.ragged(begin, count)[per_window < np.repeat(doc, count)]
            depth = np.bincount(hit, minlength=len(data) + 1) - np.bincount(hit + WIDTH, minlength=len(data) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            at = offsets.tolist()
            for k, d in enumerate(ids):
                mask = gone[at[k] : at[k + 1]]
                if copy[k] and len(mask) >= WIDTH:
                    mask = np.ones(len(mask), bool)
                kept = data[at[k] : at[k + 1]][~mask].tobytes()
                spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + bool(len(mask) and mask[0])
                rows.append((d, len(mask), int(np.count_nonzero(mask)), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row (doc_id, text)."""
    n = pieces_for(docs, "text", PIECE_BYTES)
    keyed = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("p"), "doc_id", "text")
    anchors = keyed.where("doc_id IS NOT NULL").select("p", "text").mapInArrow(_anchors(n), "part long, blob binary").groupBy("part").applyInArrow(_shared, _PIECES)

    digest = keyed.where(f"doc_id IS NOT NULL AND octet_length(text) >= {WIDTH}").select("p", "doc_id", F.md5("text").alias("digest"))
    # Written, so that the join sees two plain tables and a text with very many copies can be dealt out to several tasks.
    least = written(digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-texts")
    copies = digest.join(least, "digest").where("doc_id > least").groupBy("p").agg(F.collect_set(F.concat_ws(":", "doc_id", "digest")).alias("ids"))
    copies = copies.select("p", F.lit(_KIND["copies"]).alias("kind"), F.lit(None).cast("binary").alias("blob"), "ids")

    told = anchors.union(copies)
    blocks = keyed.groupBy("p").cogroup(told.groupBy("p")).applyInArrow(_send(n), "part long, p long, blob binary")
    smaller = blocks.groupBy("part").applyInArrow(_block, _PIECES)
    return keyed.groupBy("p").cogroup(told.union(smaller).groupBy("p")).applyInArrow(_cut(with_text), _RESULT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


SQL = f"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM bytes),
windows AS (
  SELECT doc_id, start_at AS pos, md5(substr(h, 2 * start_at + 1, {2 * WIDTH})) AS w
  FROM (SELECT doc_id, h, unnest(range(0, n - {WIDTH - 1})) AS start_at FROM sized WHERE n >= {WIDTH})),
least_doc AS (SELECT w, min(doc_id) AS m FROM windows GROUP BY w),
hits AS (SELECT doc_id, pos FROM windows JOIN least_doc USING (w) WHERE m < doc_id),
steps AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM hits),
numbered AS (SELECT doc_id, pos, sum(CASE WHEN gap IS NULL OR gap > {WIDTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM steps),
spans AS (SELECT doc_id, k, min(pos) AS a, max(pos) + {WIDTH} AS b FROM numbered GROUP BY doc_id, k),
cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops
  FROM spans GROUP BY doc_id),
kept AS (
  SELECT s.doc_id, s.n, c.n_removed, c.n_spans, CASE WHEN c.doc_id IS NULL THEN s.h ELSE
    array_to_string(list_transform(range(0, len(starts) + 1), lambda i:
      substr(s.h, 1 + 2 * (CASE WHEN i = 0 THEN 0 ELSE stops[i] END),
        2 * ((CASE WHEN i = len(starts) THEN s.n ELSE starts[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE stops[i] END)))), '') END AS h
  FROM sized s LEFT JOIN cut c USING (doc_id))
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(h)) AS kept_sha256
FROM kept
"""
