"""BPE encoding and decoding (operator 3) by concatenation.

A text is cut at white space where the tokenizer provably cuts too, and equal pieces of a task are encoded once. A
piece longer than ``LEAF`` (long unsplit text) is a tree: its leaves do not depend on each other and are encoded in one
batch (on one core: a task has one, and the library's own threads are off), as are all joins of a level. Two neighbours are
joined by re-encoding a window around the join. The window runs from a token start on the left to a token end on the
right and grows until its outer tokens equal those that both sides already had there. Beyond such a pair of agreeing
tokens nothing changes: a sequence of BPE tokens is the encoding of its text exactly if every adjacent pair is the
encoding of its own text, and all adjacent pairs then stem from a valid encoding.

Texts with other Unicode white space, or with the string of a special token, are encoded whole by the library.

Equal pieces are found by hash and compared byte by byte with the piece whose encoding they get.

Cases: a null or empty text has no tokens; repeated rows are encoded each; an empty table gives an empty result. A text of
any length is one row of work. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import arrays as A
from textquarry.llm.common import parts, table, tidy

#: Characters in a leaf of the tree, and tokens that must agree on either side of a window.
LEAF = 1024
AGREE = 2
#: Bytes of text in work at a time.
SLICE_BYTES = 1 << 20
#: Distinct pieces, and bytes of what is kept of them, that a worker remembers; beyond that it starts anew.
REMEMBERED, REMEMBERED_BYTES = 400_000, 48 << 20


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _cut(text: str, at: int) -> int:
    """The next place from ``at`` that does not part characters which normalisation may compose."""
    while at < len(text) and (unicodedata.combining(text[at]) or 0x1160 <= ord(text[at]) <= 0x11FF):
        at += 1
    return at


def encode_long(tok, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of one long text by tree concatenation. Works for texts in which no special token's string stands."""
    cuts, at = [0], _cut(text, leaf)
    while at < len(text):
        cuts.append(at)
        at = _cut(text, at + leaf)
    cuts.append(len(text))

    def encoded(spans: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
        found = tok.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False)
        return [[(i, a + s, a + e) for i, (s, e) in zip(x.ids, x.offsets, strict=True)] for (a, _), x in zip(spans, found, strict=True)]

    nodes = [(span, tokens) for span, tokens in zip(zip(cuts, cuts[1:]), encoded(list(zip(cuts, cuts[1:]))), strict=True)]
    while len(nodes) > 1:
        joined: list = [None] * ((len(nodes) + 1) // 2)
        if len(nodes) % 2:
            joined[-1] = nodes[-1]
        waiting = {k: 4 for k in range(len(nodes) // 2)}  # how many tokens the window of a join takes from either side
        while waiting:
            spans = {}
            for k, take in waiting.items():
                (a, mid), left = nodes[2 * k]
                (_, b), right = nodes[2 * k + 1]
                spans[k] = (left[-take][1] if take < len(left) else a, right[take - 1][2] if take < len(right) else b)
            for k, window in zip(spans, encoded(list(spans.values())), strict=True):
                take = waiting[k]
                (a, _), left = nodes[2 * k]
                (_, b), right = nodes[2 * k + 1]
                whole_left, whole_right = take >= len(left), take >= len(right)
                if (whole_left or window[:AGREE] == left[-take:][:AGREE]) and (whole_right or window[-AGREE:] == right[:take][-AGREE:]):
                    joined[k] = ((a, b), ([] if whole_left else left[:-take]) + window + ([] if whole_right else right[take:]))
                    del waiting[k]
                else:
                    waiting[k] = 2 * take
        nodes = joined
    return [i for i, _, _ in nodes[0][1]]


#: UTF-8 of the white space that the byte rules below do not know.
_OTHER_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with other white space or a possible special token."""
    at = [np.flatnonzero(data[:-1] == 60)] if len(data) > 1 else []  # <|
    at = [a[data[a + 1] == 124] for a in at]
    for c in _OTHER_SPACE:
        code = c.encode()
        first = np.flatnonzero(data == code[0]) if len(code) == 1 else None
        if first is None:
            where = _lead(data, code[0])
            where = where[where + len(code) <= len(data)]
            for k, byte in enumerate(code[1:], 1):
                where = where[data[where + k] == byte]
            first = where
        at.append(first)
    out = np.zeros(len(offsets) - 1, bool)
    hits = np.concatenate(at) if at else np.zeros(0, np.int64)
    out[np.searchsorted(offsets, hits, side="right") - 1] = True
    return out


_LEADS: dict = {}


def _lead(data: np.ndarray, byte: int) -> np.ndarray:
    key = (data.__array_interface__["data"][0], len(data))
    if _LEADS.get("of") != key:
        _LEADS.clear()
        _LEADS["of"] = key
        _LEADS["held"] = data  # keeps the address from being used again
    if byte not in _LEADS:
        _LEADS[byte] = np.flatnonzero(data == byte)
    return _LEADS[byte]


def word_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces for a tokenizer that drops white space: the words."""
    return A.words(data, offsets)


def byte_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces for a byte-level tokenizer, where a word takes one space before it and other white space stands alone.

    Of a run of white space before a word, all but its last character is one piece; the last goes with the word if
    it is a space and is a piece of its own otherwise. A run that ends a text is one piece.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = A.SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = edge[:-1].copy()
    begins[1:] |= space[1:] & ~space[:-1]  # a run of white space
    last = np.zeros(n, bool)  # the last of a run, with a word of the same text behind it
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    begins |= last
    begins[1:] |= last[:-1] & (data[:-1] != 32)
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


class Pieces:
    """Encodings of the distinct pieces this worker has met."""

    def __init__(self, path: str, cuts):
        self.tok, self.cuts = tokenizer(path), cuts
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        #: The bytes of each piece.
        self.at, self.size, self.raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def look_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slot of every piece, the offsets of rows within the pieces, and rows with a piece whose bytes are not its slot's."""
        starts, ends, piece_offsets = self.cuts(data, offsets)
        if len(self.keys) > REMEMBERED or len(self.raw) + 4 * len(self.flat) > REMEMBERED_BYTES:
            self._forget()
        keys, first, inverse = np.unique(A.segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        slots = np.empty(len(keys), np.int64)
        slots[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            sizes = ends[first[new]] - starts[first[new]]
            bytes_ = data[A.ragged(starts[first[new]], sizes)]
            slots[new] = len(self.count) + np.arange(len(new))
            counts, flat = self._encoded(bytes_, sizes)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, flat])
            self.at = np.concatenate([self.at, len(self.raw) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.raw = np.concatenate([self.raw, bytes_])
            self.keys, self.slots = np.insert(self.keys, at[new], keys[new]), np.insert(self.slots, at[new], slots[new])
        slots = slots[inverse]
        return slots, piece_offsets, self._other(data, starts, ends, slots, piece_offsets)

    def _other(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray, piece_offsets: np.ndarray) -> np.ndarray:
        """Rows with a piece that has the hash of another one: its bytes differ from those of its slot."""
        sizes = ends - starts
        unequal = sizes != self.size[slots]
        short = np.where(unequal, 0, sizes)
        differs = np.flatnonzero(data[A.ragged(starts, short)] != self.raw[A.ragged(self.at[slots], short)])
        if len(differs):
            unequal[np.searchsorted(np.cumsum(short), differs, side="right")] = True
        return A.per_row(unequal, piece_offsets) > 0

    def learned(self, found: list[list[int]]) -> None:
        """For what is kept beside the ids."""

    def _encoded(self, bytes_: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the pieces that follow each other in ``bytes_`` has, and all their ids."""
        cuts = np.cumsum(sizes).tolist()
        whole = bytes_.tobytes()
        found = self._encode([whole[a:b].decode() for a, b in zip([0, *cuts], cuts)])
        self.learned(found)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return counts, np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum()))

    def _encode(self, strings: list[str]) -> list[list[int]]:
        short = [s for s in strings if len(s) <= LEAF]
        found = iter(self.tok.encode_batch_fast(short, add_special_tokens=False))
        return [next(found).ids if len(s) <= LEAF else encode_long(self.tok, s) for s in strings]


#: Bytes that may belong to other white space or to a special token.
_UNSURE = np.zeros(256, bool)
_UNSURE[[ord("<"), *{c.encode()[0] for c in _OTHER_SPACE}]] = True


class BytePieces(Pieces):
    """For a byte-level tokenizer: pieces of a space and a word are encoded as one text, as it cuts before each such space.

    Every token stands for so many bytes, so the ids are dealt out to the pieces by their bytes. Other pieces, and all of a
    text whose tokens do not end where its pieces do, are encoded by themselves.
    """

    #: Bytes of pieces that are encoded as one text.
    JOINED = 1 << 14

    def __init__(self, path: str, cuts):
        super().__init__(path, cuts)
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        # In a byte-level vocabulary a character stands for a byte.
        self.width[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def _encoded(self, bytes_: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        starts = ends - sizes
        unsure = A.per_row(A.SPACE[bytes_] | _UNSURE[bytes_], np.append(0, ends)) != (bytes_[starts] == 32)
        plain = np.flatnonzero((bytes_[starts] == 32) & (sizes > 1) & (sizes <= LEAF) & ~unsure)
        counts, starts_at, chunks = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
        alone = np.ones(len(sizes), bool)
        held = 0
        groups = np.split(plain, np.flatnonzero(np.diff(np.cumsum(sizes[plain]) // self.JOINED)) + 1) if len(plain) else []
        texts_ = [bytes_[A.ragged(starts[g], sizes[g])].tobytes().decode() for g in groups]
        for g, found in zip(groups, self.tok.encode_batch_fast(texts_, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            token_ends, piece_ends = np.cumsum(self.width[ids]), np.cumsum(sizes[g])
            last = np.searchsorted(token_ends, piece_ends)
            if len(ids) and token_ends[-1] == piece_ends[-1] and (token_ends[last] == piece_ends).all():
                counts[g] = np.diff(last, prepend=-1)
                starts_at[g] = held + np.append(0, last[:-1] + 1)
                alone[g] = False
                chunks.append(ids)
                held += len(ids)
        rest = np.flatnonzero(alone)
        counts[rest], ids = super()._encoded(bytes_[A.ragged(starts[rest], sizes[rest])], sizes[rest])
        starts_at[rest] = held + np.cumsum(counts[rest]) - counts[rest]
        return counts, np.concatenate([*chunks, ids])[A.ragged(starts_at, counts)]


class WordPieces(Pieces):
    """Also keeps each piece's ids as decimals and its decoded text."""

    def _forget(self) -> None:
        super()._forget()
        self.decimals: list[bytes] = []
        self.decoded: list[bytes] = []

    def learned(self, found: list[list[int]]) -> None:
        name = self.tok.id_to_token
        self.decimals += [b" ".join(b"%d" % i for i in x) for x in found]
        self.decoded += [" ".join(map(name, x)).encode() for x in found]


_MET: dict[tuple, Pieces] = {}


def pieces(path: str, kind: type = WordPieces, cuts=word_cuts) -> Pieces:
    if (path, kind) not in _MET:
        _MET[path, kind] = kind(path, cuts)
    return _MET[path, kind]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (text) of every document, for the word tokenizer at ``path``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", SLICE_BYTES):
            ids, decoded = [], []
            for x, y in _rows(batch.column("text"), path):
                ids.append(np.array([int(i) for i in x.split()], np.int32))
                decoded.append(y.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _rows(column: pa.Array, path: str) -> Iterator[tuple[bytes, bytes]]:
    """Of each row the decimal ids joined by spaces, and the decoded text, in UTF-8."""
    data, offsets = A.texts(column)
    met = pieces(path)
    slots, piece_offsets, other = met.look_up(data, offsets)
    odd = odd_rows(data, offsets) | other
    slots, piece_offsets = slots.tolist(), piece_offsets.tolist()
    decimals, decoded = met.decimals, met.decoded
    for k, whole in enumerate(odd.tolist()):
        if whole:
            ids = met.tok.encode(data[offsets[k] : offsets[k + 1]].tobytes().decode(), add_special_tokens=False).ids
            yield b" ".join(b"%d" % i for i in ids), met.tok.decode(ids, skip_special_tokens=False).encode()
        else:
            own = slots[piece_offsets[k] : piece_offsets[k + 1]]
            # A piece without tokens (only characters that normalisation drops) must not leave a space.
            yield b" ".join([d for s in own if (d := decimals[s])]), b" ".join([d for s in own if (d := decoded[s])])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded text, without moving either."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", SLICE_BYTES):
            n, ids, decoded = [], [], []
            for x, y in _rows(batch.column("text"), path):
                n.append(x.count(b" ") + 1 if x else 0)
                ids.append(hashlib.sha256(x).hexdigest())
                decoded.append(hashlib.sha256(y).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every remaining document with its tokens."""
    return encoded(docs, public_path("word_bpe_49k.json"))
