"""Arrays of fixed size that all tasks add to: counts per hash bucket, and sets of hashes as bits.

A task sends its array in slices, compressed; slices meet in a shuffle and the
driver gets one array of a size that the parameters fix, whatever the input.
Neither is ever needed for a right result: counts order shingles, and bits only
let rows pass that a join would drop later.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64
PARTS = "slice int, cells binary"


def sliced(cells: np.ndarray) -> pa.RecordBatch:
    """The slices of a task's array that are not all zero."""
    rows = [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(np.split(cells, SLICES)) if part.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["slice", "cells"])


def gathered(parts: DataFrame, size: int, kind: str, combine) -> np.ndarray:
    """The tasks' arrays of ``size`` cells combined, slice by slice, by a ufunc."""

    def merge(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(cells.as_py()), kind)
                own[k] = combine(own[k], part) if k in own else part
        for k, part in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "cells"])

    out = np.zeros((SLICES, size // SLICES), kind)
    for row in parts.select("slice", "cells").repartition(8, "slice").mapInArrow(merge, PARTS).collect():
        own = np.frombuffer(zlib.decompress(row.cells), kind)
        out[row.slice] = combine(out[row.slice], own)
    return out.reshape(-1)


def bit_set(values: DataFrame, bits: int = 24) -> np.ndarray:
    """Bits of the 64-bit values in the one column of ``values``, 2**bits of them in all."""

    def run(batches):
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            flags[places(batch.column(0).to_numpy(zero_copy_only=False), bits)] = True
        yield sliced(np.packbits(flags))

    return gathered(values.mapInArrow(run, PARTS), 1 << bits - 3, "u1", np.bitwise_or)


def places(values: np.ndarray, bits: int = 24) -> np.ndarray:
    return (values.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def within(cells: np.ndarray, values: np.ndarray, bits: int = 24) -> np.ndarray:
    """Which values may be in the set."""
    at = places(values, bits).astype(np.int64)
    return (cells[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
