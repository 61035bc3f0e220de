"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes: no Python object per word.

Hashes are polynomials over table-mixed bytes modulo 2**64, finished by a bit mixer. Prefix sums give the hash of any
byte range from two of its entries, so hashing a million words costs a few passes over the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18


def give_back() -> None:
    """Returns what Arrow and malloc hold but do not use to the system: a worker that served another stage keeps it else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed) * U(0xD1342543DE82EF95))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as long as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK + 1)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, b, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


class RangeHash:
    """Hashes of ranges of one sequence of 64-bit numbers."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def get(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


BYTES, WORDS, WORDS2 = stream(11, 256), Powers(0x2545F4914F6CDD1D), Powers(0x9E6C63D0876A9A47)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def chunks(column: pa.Array, most: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets) of runs of at most that many rows with at most that many bytes, or of one row."""
    raw, off = buffers(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, min(a + rows, int(np.searchsorted(off, off[a] + most, "right")) - 1))
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """Words between white space of one chunk: start, end (bytes), row (of the chunk), hash; first: each row's first word (n + 1)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, white: np.ndarray = _WHITE):
        inside = ~white[raw]
        fresh = np.zeros(len(raw) + 1, bool)
        fresh[off] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | fresh[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | fresh[1:-1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.hash = RangeHash(BYTES[raw], WORDS).get(self.start, self.end)

    def text_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each row's sequence of words."""
        a, b = self.first[:-1], self.first[1:]
        return RangeHash(self.hash, WORDS).get(a, b), RangeHash(mix64(self.hash ^ U(0x5DEECE66D)), WORDS2).get(a, b)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words and their rows, in order; a row of fewer words has one of all its words, a row without words none."""
        count = np.diff(self.first)
        ranges = RangeHash(self.hash, WORDS2)
        begin = np.arange(len(self.hash))
        left = self.first[1:][self.row] - begin
        ok = (left >= n) | (begin == self.first[:-1][self.row]) & (count[self.row] < n)
        begin = begin[ok]
        return ranges.get(begin, begin + np.minimum(left[ok], n)), self.row[ok]
