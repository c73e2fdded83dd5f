"""Vectorised work on the bytes of a column of texts.

A batch of texts is one byte array with row offsets, as Arrow stores it. Words, lines and windows are found on the
whole array at once. A white-space byte (space, tab to carriage return) never occurs inside a UTF-8 sequence, so
words split on bytes are the words split on code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(RADIX, -1, 1 << 64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the offsets of rows within them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary() if pa.types.is_binary(column.type) else column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        n = max(n, 2 * len(_POWERS["up"]))
        for name, base in (("up", RADIX), ("down", _INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes from which a segment is hashed by itself.
LONG_SEGMENT = 256
#: One seed for each of two independent families of hashes.
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """64-bit hashes of segments of one byte array, eight bytes at a time, each block mixed before the next.

    Unlike a polynomial modulo 2**64 this has no family of colliding strings that is known for every multiplier.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64) * np.uint64(RADIX) + np.uint64(seed))
    long = length >= LONG_SEGMENT
    for k in np.flatnonzero(long).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]], seed)
    left = np.flatnonzero(~long & (length > 0))
    at, rest, acc = starts[left], length[left], out[left]
    while len(left):
        block = word[at]
        short = rest < 8
        block[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        acc = mix((acc ^ block) * np.uint64(RADIX) + np.uint64(seed))
        out[left] = acc
        more = rest > 8
        left, at, rest, acc = left[more], at[more] + 8, rest[more] - 8, acc[more]
    return out


def shingle_hashes(words_: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` word hashes (windows over row ends included); each word is mixed before the next."""
    n = len(words_) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words_[:n]
    for k in range(1, width):
        out = mix(out * np.uint64(RADIX) + words_[k : k + n])
    return out


class Hasher:
    """64-bit hashes of any short segments of one byte array, from prefix sums of a polynomial.

    Strings of 1,024 bytes and more are known to collide modulo 2**64 for every multiplier: only for shorter segments.
    """

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))

    def windows(self, width: int) -> np.ndarray:
        """The hash of each window of ``width`` bytes (windows over row ends included)."""
        n = len(self._sums) - width
        return mix((self._sums[width:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the offsets of rows within the list of words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each row's entries are true."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each entry."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for the first length, then the second, and so on."""
    ends = np.cumsum(lengths)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    return out + np.repeat(starts - (ends - lengths), lengths)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one elsewhere."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def slide_max(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        values = np.maximum(values[:-have], values[have:])
        have *= 2
    return np.maximum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values
