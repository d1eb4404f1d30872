"""Shared pieces of the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A task works on slices of a batch of about this much text (or one text, if longer).
SLICE_BYTES = 1 << 19
# Tokenizing keeps little besides the text, and larger slices cost it less.
TOKEN_SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id (bigint) and the text (string); all other columns, whatever their names, are left behind."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of id and text: rows that differ in one of them have keys of their own, in every run of a task."""
    return F.xxhash64(doc_id.cast("bigint"), text.cast("string"))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_text`` and the key of each row."""
    return id_text(docs, doc_id, text).withColumn("row", row_key(F.col("doc_id"), F.col("text")))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, ends: bool = True) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by the size of their texts, so that memory is bounded by the slice or the longest text.

    ``ends``: the task ends with the batches, and what it held is given back.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    if ends:
        release()


def release() -> None:
    """Give memory that a task no longer uses back to the system; a worker that waits would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # Only the GNU C library has it.
        pass


def kept_in_worker(key: str, make):
    """A value that a Python worker keeps between tasks (tokenizers, word caches)."""
    state = sys.modules.setdefault("keepsake_worker_state", types.ModuleType("keepsake_worker_state"))
    if not hasattr(state, key):
        setattr(state, key, make())
    return getattr(state, key)
