"""Words of whole Arrow string columns and 64-bit hashes of words and word windows, in numpy.

A hash is a polynomial over random values of the bytes (or words) modulo 2**64, taken from running sums: every
byte costs a few vector operations, whatever the number of windows that hold it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SEGMENT = 1 << 18
"""Bytes hashed at a time; a single word may not be longer, else it is hashed by itself."""
BATCH_BYTES = 6 << 20
"""Arrow batches end at this size, so that memory does not follow the length of the texts."""

_BYTE_VALUES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_BASE, _WORD_BASE, _SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than by default, unless the session already says how large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def white_space() -> np.ndarray:
    """The bytes 09 to 0D and 20."""
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def column_bytes(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one after the other, and where each begins and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(column) else np.zeros(0, np.uint8)
    return _LOWER[data] if lower else data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def words_of(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where the words begin and end, and the number of words before each text (and after the last)."""
    inside = ~breaks[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = np.unique(offsets)
    heads, tails = edges[edges < len(data)], edges[edges > 0] - 1
    begin[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """The first powers of an odd number modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SEGMENT:
            _POWERS[base] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial of ``values[begin:end]`` for each pair, without regard to where it stands."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    return (total[end] - total[begin]) * _powers(_inverse(base), len(values) + 1)[begin]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        if hi - lo > SEGMENT:
            out[at] = int.from_bytes(hashlib.blake2b(data[lo:hi].tobytes(), digest_size=8).digest(), "little")
        else:
            values = _BYTE_VALUES[data[lo:hi]]
            out[at:stop] = mixed(_ranges(values, starts[at:stop] - lo, ends[at:stop] - lo, _BYTE_BASE))
        at = stop
    return out


def window_hashes(words: np.ndarray, first: np.ndarray, length: int | np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of ``words[i : i + length]`` for each i in ``first``; ``second`` gives an independent one."""
    if second:
        words = mixed(words ^ np.uint64(_SECOND_BASE))
    return mixed(_ranges(words, first, first + length, _SECOND_BASE if second else _WORD_BASE))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64, copy=False).view(np.uint64)
