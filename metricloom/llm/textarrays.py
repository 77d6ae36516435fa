"""Text columns as numpy arrays: bytes, words, hashes of spans. Every array covers many rows at once.

A span hash is the difference of two prefix sums of scrambled units times powers of an odd number, taken
modulo 2^64 and mixed, so equal spans have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U), np.ones(1, U)]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column as one array, and the offsets of its rows. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows that hold at most ``limit`` units, or one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high
        low = high


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of 256 byte values lie in the given closed ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


#: Bytes of words: all but blank, tab to carriage return; and letters, digits and all above ASCII (after lower-casing).
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
WORD = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a row border."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all bits."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Spans:
    """Hashes of spans of a sequence of scrambled 64-bit units."""

    def __init__(self, units: np.ndarray):
        up, self.down = _power(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, U)
        np.cumsum(units * up[:len(units)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all spans of ``k`` units, by start."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


_BYTE_UNITS = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def byte_units(data: np.ndarray) -> np.ndarray:
    """Scrambled units of bytes."""
    return _BYTE_UNITS[data]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of all rows, and for each row the number of words before it."""
    starts, ends = runs(table[data], offsets)
    hashes = Spans(byte_units(data)).hash(starts, ends) if len(starts) else np.zeros(0, U)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def inside(offsets: np.ndarray, k: int) -> np.ndarray:
    """Which of the spans of ``k`` units, by start, end in the row they start in."""
    n = int(offsets[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    out = np.ones(n, bool)
    for border in offsets[1:-1]:
        out[max(0, border - k + 1):border] = False
    return out


def least(values: np.ndarray, w: int) -> np.ndarray:
    """Index of the least value of every window of ``w`` values, the first of equals, by doubling."""
    best, width = np.arange(len(values)), 1
    while width < w:
        step = min(width, w - width)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        width += step
    return best


def chosen(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order of appearance, where each first stands, and which of them each value is."""
    which, found = pd.factorize(values)
    first = np.empty(len(found), np.int64)
    first[which[::-1]] = np.arange(len(values) - 1, -1, -1)
    return found, first, which
