"""Vectorised words, shingles and 64-bit hashes over Arrow batches of text.

All of it works on a *chunk*: a slice of an Arrow string column with a bounded
number of bytes (one longer text makes a chunk of its own).  A chunk's bytes
stay in one numpy array; nothing is split into Python strings.  Words are runs
of bytes other than ASCII whitespace (0x20, 0x09-0x0D) with A-Z lower-cased;
null texts count as empty.  Words and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_STEP, _SEED = U64(0x9E3779B97F4A7C15), U64(0x2545F4914F6CDD1D)
_BASE = 0x100000001B3
#: Hash of the end-of-text token.
END = U64(0x5851F42D4C957F2D)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h *= _M1
    h ^= h >> U64(33)
    h *= _M2
    h ^= h >> U64(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U64) * _STEP)[LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 18)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, U64(base))
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


@dataclass
class Chunk:
    """Rows first .. first+n-1 of a batch; data holds their texts end to end, text i at start[i]:stop[i]."""

    first: int
    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 1 << 17) -> Iterator[Chunk]:
    """Slices of a string column whose texts hold about `most` bytes; a longer text comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at], offsets[at + 1 : to + 1] - offsets[at])
        at = to


class Spans:
    """Hashes of any spans of a chunk's bytes, A-Z lower-cased, in constant time each."""

    def __init__(self, c: Chunk):
        n = len(c.data)
        up, self.down = _power(n + 1)
        self.total = np.empty(n + 1, U64)
        self.total[0] = 0
        np.cumsum(_BYTE[c.data] * up[:n], out=self.total[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.down[start] + (stop - start).astype(U64) * _STEP)


@dataclass
class Words:
    """Word hashes of a chunk in reading order; text i has words first[i]:first[i+1]."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(c: Chunk, blank: np.ndarray = SPACE) -> Words:
    """blank: for each byte, whether it separates words."""
    n = len(c.data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), np.zeros(c.n + 1, np.int64), z, z)
    solid = ~blank[c.data]
    edge = np.zeros(n + 1, bool)
    edge[c.start[c.start < n]] = True
    edge[n] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = Spans(c).hash(start, stop)
    first = np.empty(c.n + 1, np.int64)
    first[:-1] = np.searchsorted(start, c.start)
    first[-1] = len(start)
    return Words(h, first, start, stop)


def joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position on; the last n-1 positions have none."""
    out = np.full(max(0, len(h) - n + 1), _SEED * U64(n))
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * _STEP
        out ^= out >> U64(29)
    return mix(out)


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """For each text its distinct n-word shingles, ascending; a shorter text has its whole word sequence as one, a text without words none."""
    every = joined(w.hash, n)
    sets = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(every[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif b > a:
            sets.append(joined(w.hash[a:b], b - a))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes, the same in any order."""
    if not len(s):
        return 0
    both = np.add.reduceat(mix(s + _SEED), [0]) + np.array([len(s)], U64) * _STEP
    return int(mix(mix(np.bitwise_xor.reduceat(s, [0])) * _STEP + both).view(np.int64)[0])
