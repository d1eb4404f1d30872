"""Packing along a space-filling curve: neighbouring documents share sequences.

Each document's hashed token counts are projected to ``DIMENSIONS`` numbers; these
are centred and scaled by their mean and deviation over all documents, cut into
``2**BITS`` cells each, and give the document's place on a Hilbert curve.
Documents are range-sorted by that place, and each range is packed as one stream:
cut every ``LENGTH`` ids, so no sequence but a range's last is short. The rest of
a range is split into sequences of powers of two, which need no padding.

A text is tokenized once; the ids are shuffled once, by range. A task holds the
rows of one Arrow batch. Nothing is gathered but the means and deviations.

Defined cases: a null text is empty and has only the end id; rows with equal or
null doc_id are all packed; documents of one place are ordered by doc_id, checksum
and size, so a repeated task gives the same sequences; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import id_text, kept_in_worker, slices
from keepsake.llm.token_store import packed, unpacked
from keepsake.llm.tokens import WordTokenizer
from keepsake.session import cut

LENGTH = 2048
END_ID = 1
DIMENSIONS = 4
BITS = 10
BUCKETS = 1024
# Documents of one block of the projection; bounds the block of counts.
ROWS = 512

VECTORS = "doc_id bigint, n_tokens bigint, crc bigint, ids binary, vector array<double>"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "sequence_length bigint, ids array<int>"
)
# A task's sequences are numbered within its range.
RANGE_SHIFT = 40


def projection(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.RandomState(7).standard_normal((buckets, dimensions))


def vectors(docs: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Unit vectors of hashed, damped token counts, projected."""
    out = np.zeros((len(docs), matrix.shape[1]))
    for i in range(0, len(docs), ROWS):
        own = docs[i : i + ROWS]
        row = np.repeat(np.arange(len(own)), [len(d) for d in own])
        bucket = (np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64) * 40503) >> 6 & (len(matrix) - 1)
        counts = np.sqrt(np.bincount(row * len(matrix) + bucket, minlength=len(own) * len(matrix)).reshape(len(own), -1))
        norm = np.sqrt((counts * counts).sum(axis=1))
        out[i : i + ROWS] = counts @ matrix / np.maximum(norm, 1e-9)[:, None]
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), each coordinate of ``bits`` bits.

    Coordinates are turned into the curve's transposed digits by undoing rotations
    and reflections from the top bit down, then a Gray code; digits interleave to the place.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[n - 1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> level) & 1)
    return place


def embedded(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, crc, ids and the projected vector of every row."""

    def run(batches):
        tok = kept_in_worker(f"tokenizer {tokenizer}", lambda: WordTokenizer(tokenizer))
        end, matrix = np.array([] if end_id is None else [end_id], np.uint32), projection()
        for batch in slices(batches):
            ids, many = tok.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum(many)
            bare = [ids[e - n : e] for e, n in zip(ends, many)]
            own = [np.concatenate([b, end]).astype("<u4") for b in bare]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in own], pa.int64()),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    pa.array([packed(x) for x in own], pa.binary()),
                    pa.array(list(vectors(bare, matrix)), pa.list_(pa.float64())),
                ],
                names=["doc_id", "n_tokens", "crc", "ids", "vector"],
            )
        tok.rest()

    return id_text(docs, doc_id, text).mapInArrow(run, VECTORS)


def with_place(table: DataFrame, bits: int = BITS) -> DataFrame:
    """Add ``place`` on the curve; cells are of about equal weight where a coordinate is normal."""
    stats = table.agg(
        *[F.avg(F.get("vector", F.lit(d))).alias(f"m{d}") for d in range(DIMENSIONS)],
        *[F.stddev_pop(F.get("vector", F.lit(d))).alias(f"s{d}") for d in range(DIMENSIONS)],
    ).first()
    mean = np.array([stats[f"m{d}"] or 0.0 for d in range(DIMENSIONS)])
    deviation = np.array([stats[f"s{d}"] or 1.0 for d in range(DIMENSIONS)])

    @F.pandas_udf("bigint")
    def place(vector):
        z = (np.stack(vector.to_numpy()) - mean) / deviation
        cells = (1 / (1 + np.exp(-1.702 * np.clip(z, -8, 8))) * (1 << bits)).astype(np.int64)
        return type(vector)(hilbert(np.clip(cells, 0, (1 << bits) - 1), bits))

    return table.withColumn("place", place("vector")).drop("vector")


def tail_lengths(n: int) -> list[int]:
    """Powers of two that sum to ``n``, falling."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pieces(ordered: DataFrame, length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """Cut each range's stream into sequences; one row per piece of a document."""

    def run(batches):
        first = TaskContext.get().partitionId() << RANGE_SHIFT
        # A sequence is given out when it is full, so that the last one can be split anew.
        sequence, filled, waiting = 0, 0, []

        def out(rows):
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(columns[8]).astype(np.int32)))
            else:
                ids = pa.nulls(len(rows), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays(
                [*arrays, ids],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"],
            )

        def row(part, at, size):
            doc, start, ids, total = part
            crc = zlib.crc32(ids.astype("<u4"))
            return (doc, start, len(ids), crc, total, first + sequence, at, size, ids)

        for batch in slices(batches, "ids", 1 << 22):
            done = []
            for doc, total, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids, start = unpacked(data), 0
                while start < total:
                    n = min(total - start, length - filled)
                    waiting.append((doc, start, ids[start : start + n], total))
                    start, filled = start + n, filled + n
                    if filled == length:
                        at = 0
                        for part in waiting:
                            done.append(row(part, at, length))
                            at += len(part[2])
                        sequence, filled, waiting = sequence + 1, 0, []
            if done:
                yield out(done)
        done = []
        for size in tail_lengths(filled):
            at = 0
            while at < size:
                doc, start, ids, total = waiting.pop(0)
                n = min(len(ids), size - at)
                done.append(row((doc, start, ids[:n], total), at, size))
                if n < len(ids):
                    waiting.insert(0, (doc, start + n, ids[n:], total))
                at += n
            sequence += 1
        if done:
            yield out(done)

    return ordered.select("doc_id", "n_tokens", "ids").mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int | None = END_ID, keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its sequence, its checksum and, if asked, its ids."""
    table = with_place(cut(embedded(docs, tokenizer, end_id, doc_id, text)))
    order = ["place", F.col("doc_id").asc_nulls_first(), "crc", "n_tokens"]
    return pieces(table.repartitionByRange(*order).sortWithinPartitions(*order), length, keep_ids)
