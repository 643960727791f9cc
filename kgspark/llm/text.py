"""Words, lines and hashes of whole Arrow text columns, as NumPy arrays.

Every operator here that looks at words uses the same definition: a word is a
maximal run of characters other than the six ASCII white-space characters
(space and U+0009 to U+000D).  Documents are handled a chunk of rows at a time,
so the arrays stay a fixed multiple of ``CHUNK`` bytes or of one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: The pattern of a word, for engines with regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: The pattern of white space between words.
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text worked on at a time; a longer document makes a chunk of its own.
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ALL = np.uint64((1 << 64) - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    return mix(a * _FOLD + b)


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of ``values[i : i + n]`` for each i that has so many, by doubling."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    part, size, out, done = mix(values), 1, None, 0
    while True:
        if n & size:
            rest = part[done:]
            out = rest if out is None else fold(out[: len(rest)], rest)
            done += size
        if done == n:
            return out[: len(values) - n + 1]
        part = fold(part[:-size], part[size:])
        size *= 2


_P61 = np.uint64((1 << 61) - 1)
_BASE = 0x0F58476D1CE4E5B9


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P61) + (x >> np.uint64(61))
    return np.where(x >= _P61, x - _P61, x)


def _times(a: np.ndarray, b) -> np.ndarray:
    """Products modulo 2**61 - 1, from halves that do not overflow."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    b = np.asarray(b, np.uint64)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = al * bh + ah * bl
    return _reduced((ah * bh << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + _reduced(al * bl))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, _times(out, pow(base, len(out), (1 << 61) - 1))))
    return out[:n]


class Spans:
    """Hashes of any spans of a sequence in constant time each: a polynomial modulo the prime 2**61 - 1, in prefix sums."""

    def __init__(self, values: np.ndarray):
        terms = _times(_reduced(values), _powers(_BASE, len(values)))
        self.down = _powers(pow(_BASE, -1, (1 << 61) - 1), len(values) + 1)
        half = np.uint64(31)
        high, low = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (terms >> half, terms & np.uint64((1 << 31) - 1)))
        self.sums = _reduced(_times(_reduced(high), 1 << 31) + _reduced(low))

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        span = _reduced(self.sums[ends] + _P61 - self.sums[starts])
        return fold(_times(span, self.down[starts]), (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of consecutive documents: where they are in ``data``, and which are whose."""

    data: np.ndarray  # bytes of the documents
    offsets: np.ndarray  # of the documents in data, and the end
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, from its length and its bytes, eight at a time; ``which`` (0 or 1) picks one of two."""
        size = self.ends - self.starts
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(self.data) + 1,), np.dtype("<u8"), padded, strides=(1,))
        h = (size.astype(np.uint64) + np.uint64(1)) * np.uint64(_SEEDS[which])
        for at in range(0, min(int(size.max(initial=0)), LONG_WORD), 8):
            left = size - at
            rows = np.flatnonzero(left > 0) if at else slice(None)
            left = np.minimum(left[rows], 8).astype(np.uint64)
            part = eight[self.starts[rows] + at] & (_ALL >> (np.uint64(8) * (np.uint64(8) - left)))
            h[rows] = mix(h[rows] ^ part)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), _SEEDS[which])
        return h

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums by document of what is given for each word."""
        return sums(flags, self.first)

    def windows(self, n: int) -> np.ndarray:
        """Index of the first word of each window of n words that lies in one document."""
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(last))
        return at[at + n <= last]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word shingles (of the whole sequence where it is shorter), and where each document's start, and the end."""
        h, count = self.hashes(), self.counts
        bounds = np.concatenate(([0], np.cumsum(np.where(count > 0, np.maximum(count - n + 1, 1), 0))))
        out = np.zeros(bounds[-1], np.uint64)
        long = np.repeat(count >= n, np.diff(bounds))
        at = self.windows(n)
        out[long] = window_hashes(h, n)[at]
        for m in range(1, n):
            docs = np.flatnonzero(count == m)
            if len(docs):
                out[bounds[docs]] = window_hashes(h, m)[self.first[docs]]
        return out, bounds


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; null reads as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = False
    edge[offsets] = True
    inside = ~_SPACE[data]
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = ~inside
    before = np.ones(len(data), bool)
    before[1:] = gap[:-2]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (gap[1:] | edge[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def ranges(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(from row, to row), in order: so many rows as have ``size`` bytes at most, a longer one alone."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, their words), in order, over a whole column."""
    if not len(column):
        return
    data, offsets = raw(column)
    for lo, hi in ranges(offsets, size):
        part = data[offsets[lo] : offsets[hi]]
        yield lo, hi, split(_LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo])


def joined(words: Words, doc: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A document's words with one space between them, and where each starts and ends there."""
    lo, hi = words.first[doc], words.first[doc + 1]
    if lo == hi:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = b" ".join(words.data[words.starts[lo] : words.ends[hi - 1]].tobytes().split())
    size = words.ends[lo:hi] - words.starts[lo:hi]
    starts = np.zeros(hi - lo, np.int64)
    np.cumsum(size[:-1] + 1, out=starts[1:])
    return text, starts, starts + size


def put(counts: np.ndarray, kind=np.uint8) -> bytes:
    """Numbers, mostly small, in a byte each (or another unsigned type); those from its largest value on follow in full."""
    most = np.iinfo(kind).max
    large = counts[counts >= most].astype(np.int64)
    return np.minimum(counts, most).astype(kind).tobytes() + large.tobytes() + np.array([len(large)], np.int64).tobytes()


def got(data: bytes, kind=np.uint8) -> np.ndarray:
    n, size = int(np.frombuffer(data, np.int64, 1, len(data) - 8)[0]), np.dtype(kind).itemsize
    out = np.frombuffer(data, kind, (len(data) - 8 - 8 * n) // size).astype(np.int64)
    out[out == np.iinfo(kind).max] = np.frombuffer(data, np.int64, n, len(data) - 8 - 8 * n)
    return out
