"""Vectorised 64-bit hashes of words, word shingles and character shingles of Arrow text columns.

A word's hash is a polynomial over random byte values modulo 2**64, taken from
running sums, so a whole slice of texts is hashed by a few array operations.
Equal hashes are taken as equal words: two different ones agree with a chance of
about 2**-60, and all uses compare shingles of few documents with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that are hashed at a time (or one word); the tables of powers that a worker keeps are as long.
PIECE = 1 << 20
_RANDOM = np.random.RandomState(20240201)
_BYTE = _RANDOM.randint(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RANDOM.randint(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = _powers(base, n)
    return _POWERS[base]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text starts and ends in them; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_ranges(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of one piece."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power_table(_BASE, n + 1)[:n], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * _power_table(_BASE_INVERSE, n + 1)[starts])


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text.

    A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
    """
    raw, rows = text_bytes(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(rows) - 1, np.int64)
    inside = ~_WHITE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    breaks = rows[(rows > 0) & (rows < len(raw))]
    before[breaks] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after[breaks - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, rows))
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
        low, high = starts[i], ends[j - 1]
        out[i:j] = _hash_ranges(raw[low:high], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out, counts


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, text after text in order, and their number in each text.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    hashes, counts = words(column)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    if len(hashes) >= width:
        runs = sum(hashes[k : len(hashes) - width + 1 + k] * _PLACE[k] for k in range(width))
    else:
        runs = np.zeros(0, np.uint64)
    many = np.maximum(counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), many)
    start = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + firsts[row]
    out = np.empty(len(row), np.uint64)
    full = counts[row] >= width
    out[full] = runs[start[full]]
    for i in np.flatnonzero(~full):
        own = hashes[start[i] : start[i] + counts[row[i]]]
        out[i] = np.append(own * _PLACE[: len(own)], _PLACE[32 + len(own)]).sum(dtype=np.uint64)
    return mix(out), many


def sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    hashes, many = shingles(column, width)
    ends = np.cumsum(many)
    return [np.unique(hashes[e - n : e]) for e, n in zip(ends, many)]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column of 64-bit integers."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
