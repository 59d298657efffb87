"""Vectorised word shingles straight from Arrow string buffers.

A text becomes ASCII-lower-cased words ``[^\\x20\\x09-\\x0D]+`` and then the set
of its distinct 5-word shingles, each held as a 64-bit value.  Nothing here
makes a Python object per word: words are hashed by differences of a
polynomial prefix sum over the raw bytes (wrapping 64-bit arithmetic over
byte values mapped through a random table), and shingles by a second
polynomial over the word values.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Texts are taken this many bytes at a time (one longer text is taken alone),
#: which bounds a worker's scratch memory to some 15 times as much.
CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93


def trim() -> None:
    """Give freed memory back to the system: workers are kept between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


_POWERS = _powers(_BASE, 1 << 16)
_INVERSE = _powers(_BASE_INVERSE, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if n > len(_POWERS):
        if n > CHUNK_BYTES * 2:  # an outsized text: not kept
            return _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        size = 1 << int(n - 1).bit_length()
        _POWERS, _INVERSE = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _POWERS, _INVERSE


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def word_values(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of all words, in order, and the row of each word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _tables(len(data) + 1)
    solid = ~_IS_SPACE[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    first = offsets[:-1][(offsets[:-1] < offsets[1:])]
    starts[first] = solid[first]  # a row never continues a word of the row before
    start = np.flatnonzero(starts)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(solid, _BYTE[data] * power[: len(data)], np.uint64(0)), out=prefix[1:])
    # White space adds nothing, so a word's sum runs to the next word's start.
    after = np.append(start[1:], len(data))
    value = (prefix[after] - prefix[start]) * inverse[start]
    row = np.searchsorted(offsets, start, side="right") - 1
    return mix(value), row


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted by value within the row, and the
    rows' offsets into them.  Rows of fewer words than ``width`` have their
    whole sequence as one shingle; rows without words have none."""
    rows = len(offsets) - 1
    value, row = word_values(offsets, data)
    if not len(value):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    count = np.bincount(row, minlength=rows)
    n = len(value)
    total = np.zeros(n, np.uint64)
    power = 1
    for k in range(width):
        total[: max(n - k, 0)] += value[k:] * np.uint64(power)
        power = power * _STEP % (1 << 64)
    ends = np.cumsum(count)
    left = ends[row] - np.arange(n)  # words from here to the row's end
    keep = left >= width
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        where = (ends - count)[short]
        keep[where] = True
        sums = np.zeros(len(short), np.uint64)
        power = 1
        for k in range(width - 1):
            has = count[short] > k
            sums[has] += value[np.minimum(where + k, n - 1)][has] * np.uint64(power)
            power = power * _STEP % (1 << 64)
        total[where] = sums + count[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    total, row = mix(total[keep]), row[keep]
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
    total, row = total[fresh], row[fresh]
    return total, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
