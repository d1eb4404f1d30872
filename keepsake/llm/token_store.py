"""Token ids on disk: canonical length-limited Huffman codes from global counts.

``write`` tokenizes each text once, counts the ids of all documents, gives them
code lengths of at most ``MOST_BITS`` (package-merge) and stores every document as
a byte-aligned run of canonical codes, in ascending order of id. Blocks of about
``BLOCK_IDS`` ids are independent: a block carries the ids, sizes and places of its
documents and the bit offset of every ``STEP``-th id, so that ``read`` decodes all
stretches of a block side by side from one table of ``2**MOST_BITS`` entries.

The folder holds ``blocks`` (one row per block, with the id number inside its part),
``parts`` (ids per part) and ``code`` (id, length). Parts are ranges of document
ids; the place of a document among all ids is its part's sum plus its own offset.

Ids are only counted and coded where Spark reads them: the driver sees the counts
per id, whose number the vocabulary bounds, and the number of ids of each part.

Defined cases: a null text is empty and has just the end id; rows with equal or
null doc_id are all kept, nulls first, equal ones in order of their ids' checksum;
an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.common import TOKEN_SLICE_BYTES, id_text, kept_in_worker, slices
from keepsake.llm.tokens import WordTokenizer
from keepsake.session import cut

MOST_BITS = 18
STEP = 256
BLOCK_IDS = 1 << 18
BLOCK_DOCS = 1 << 14
END_ID = 0

TOKENS = "doc_id bigint, n_tokens bigint, crc bigint, ids binary"
CODED = "doc_id bigint, n_tokens bigint, crc bigint, bits binary, marks binary"
BLOCKS = (
    "part int, block bigint, first_id bigint, n_ids bigint, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "doc_bytes array<bigint>, bits binary, marks binary"
)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, crc and ids (little-endian, unsigned 32-bit stored as bytes) of every row."""

    def run(batches):
        tok = kept_in_worker(f"tokenizer {tokenizer}", lambda: WordTokenizer(tokenizer))
        for batch in slices(batches, most=TOKEN_SLICE_BYTES):
            ids, many = tok.encode([t or "" for t in batch.column(1).to_pylist()])
            if end_id is not None:
                ids, many = np.insert(ids, np.cumsum(many), end_id), many + 1
            # Views of one array each; ids of a document are bytes first..last of it.
            wide = memoryview(ids.astype("<u4").tobytes())
            narrow = memoryview(ids.astype("<u2").tobytes()) if not len(ids) or int(ids.max()) < 1 << 16 else None
            last = np.cumsum(many).tolist()
            places = list(zip([0, *last], last))
            stored = [b"".join((narrow[2 * a : 2 * b], b"\x02")) for a, b in places] if narrow is not None else [packed(ids[a:b]) for a, b in places]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(many, pa.int64()), pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in places], pa.int64()), pa.array(stored, pa.binary())],
                names=["doc_id", "n_tokens", "crc", "ids"],
            )
        tok.rest()

    return id_text(docs, doc_id, text).mapInArrow(run, TOKENS)


def packed(ids: np.ndarray) -> bytes:
    """Two bytes an id where all ids allow it, else four, and a last byte that says which."""
    if not len(ids) or int(ids.max()) < 1 << 16:
        return ids.astype("<u2").tobytes() + b"\x02"
    return ids.astype("<u4").tobytes() + b"\x04"


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[-1]}", (len(data) - 1) // data[-1]).astype(np.int64)


def code_lengths(counts: np.ndarray, most_bits: int = MOST_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code none of which exceeds ``most_bits`` (package-merge); 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")]
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most_bits:
        raise ValueError(f"{len(used)} ids need codes of more than {most_bits} bits")
    leaves = counts[used].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(most_bits):
        weights = np.concatenate([leaves, packages])
        order = np.argsort(weights, kind="stable")
        levels.append(order < len(leaves))
        merged = weights[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * (len(leaves) - 1)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    code = last = 0
    for n in np.unique(lengths[used]):
        own = used[lengths[used] == n]
        code <<= int(n) - last
        codes[own] = code + np.arange(len(own))
        code, last = code + len(own), int(n)
    return codes


def decoding_table(lengths: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next ``most_bits`` bits: the id and the length of its code."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (most_bits - lengths[used])
    ids, sizes = np.zeros(1 << most_bits, np.int64), np.zeros(1 << most_bits, np.int64)
    ids[: spans.sum()] = np.repeat(used, spans)
    sizes[: spans.sum()] = np.repeat(lengths[used], spans)
    return ids, sizes


def encode(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Byte-aligned codes of each document, and the bit offsets in them of ids 0, STEP, 2*STEP ..."""
    many = np.array([len(d) for d in docs])
    ids = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
    n_bits = lengths[ids]
    ends = np.cumsum(n_bits)
    firsts = np.cumsum(many) - many
    total = np.add.reduceat(np.append(n_bits, 0), firsts) if len(docs) else np.zeros(0, np.int64)
    total = np.where(many > 0, total, 0)
    n_bytes = (total + 7) // 8
    byte_start = np.cumsum(n_bytes) - n_bytes
    before = np.cumsum(total) - total
    row = np.repeat(np.arange(len(docs)), many)
    inside = ends - n_bits - before[row]
    place = inside + 8 * byte_start[row]
    # A code of at most 32 bits lies in two neighbouring words of 32 bits; bits never overlap, so sums below 2**32 join them.
    word, shift = place >> 5, 64 - n_bits - (place & 31)
    both = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    size = int(n_bytes.sum()) // 4 + 2
    out = np.bincount(word, both >> np.uint64(32), size)
    out[1:] += np.bincount(word, both & np.uint64(0xFFFFFFFF), size)[:-1]
    raw = out.astype(">u4").view(np.uint8)
    bits = [raw[s : s + n].tobytes() for s, n in zip(byte_start, n_bytes)]
    marks = [inside[f : f + n : STEP] for f, n in zip(firsts, many)]
    return bits, marks


def decode(bits: bytes, places: np.ndarray, many: np.ndarray, table: tuple[np.ndarray, np.ndarray], most_bits: int = MOST_BITS) -> np.ndarray:
    """Ids of stretches that start at the bits ``places`` and hold ``many`` ids each, stretch after stretch."""
    ids, sizes = table
    raw = np.frombuffer(bits, np.uint8)
    raw = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int64)
    word = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    order = np.argsort(-many, kind="stable")
    at, left = places[order].copy(), many[order]
    firsts = (np.cumsum(many) - many)[order]
    out = np.zeros(int(many.sum()), np.int64)
    # Stretches are in falling size: step k concerns the first of them.
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
    for k, n in enumerate(active):
        now = at[:n]
        window = (word[now >> 3] >> (32 - most_bits - (now & 7))) & ((1 << most_bits) - 1)
        out[firsts[:n] + k] = ids[window]
        at[:n] = now + sizes[window]
    return out


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; one row per task and id is combined by Spark."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in slices(batches, "ids", 1 << 24):
            own = np.bincount(np.concatenate([unpacked(x) for x in batch.column(0).to_pylist()]))
            if len(own) > len(counts):
                own, counts = counts, own
            counts[: len(own)] += own
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows.id.max()) + 1 if len(rows) else 1, np.int64)
    counts[rows.id.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return counts


def _coded(tokens: DataFrame, lengths) -> DataFrame:
    def run(batches):
        own = lengths.value
        codes = canonical_codes(own)
        for batch in slices(batches, "ids", 1 << 21):
            bits, marks = encode([unpacked(x) for x in batch.column(3).to_pylist()], own, codes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(bits, pa.binary()), pa.array([m.astype("<u8").tobytes() for m in marks], pa.binary())],
                names=["doc_id", "n_tokens", "crc", "bits", "marks"],
            )

    return tokens.mapInArrow(run, CODED)


def _blocks(coded: DataFrame) -> DataFrame:
    """Rows of a part in order of id, joined to blocks."""

    def run(batches):
        part, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        ids = 0

        def flush():
            doc_ids, many, bits, marks = zip(*held)
            base = np.cumsum([0, *(len(b) for b in bits)])
            places = [np.frombuffer(m, "<u8") + 8 * b for m, b in zip(marks, base)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int64()),
                    pa.array([first], pa.int64()),
                    pa.array([ids], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([many], pa.list_(pa.int64())),
                    pa.array([np.diff(base).tolist()], pa.list_(pa.int64())),
                    pa.array([b"".join(bits)], pa.binary()),
                    pa.array([np.concatenate(places).astype("<u8").tobytes()], pa.binary()),
                ],
                names=["part", "block", "first_id", "n_ids", "doc_ids", "doc_tokens", "doc_bytes", "bits", "marks"],
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for row in zip(*columns):
                held.append(row)
                ids += row[1]
                if ids >= BLOCK_IDS or len(held) >= BLOCK_DOCS:
                    yield flush()
                    held, block, first, ids = [], block + 1, first + ids, 0
        if held:
            yield flush()

    return coded.mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenize ``docs`` and write the store to the new folder ``path``."""
    spark = docs.sparkSession
    tokens = cut(tokenized(docs, tokenizer, end_id, doc_id, text))
    lengths = code_lengths(id_counts(tokens))
    used = np.flatnonzero(lengths)
    code = spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist())), "id bigint, length bigint")
    code.coalesce(1).write.parquet(f"{path}/code")
    coded = _coded(tokens, spark.sparkContext.broadcast(lengths))
    # The ranges come from the ids alone, so that documents are coded once.
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = tokens.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts).alias("m")).first().m if parts > 1 else []
    bounds = F.array(*[F.lit(int(x)) for x in sorted(set(marks or []))]).cast("array<bigint>")
    placed = coded.withColumn("_part", F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))), F.lit(0)))
    ordered = placed.repartitionById(parts, "_part").drop("_part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc", "n_tokens")
    _blocks(ordered).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, want=None, schema: str = "doc_id bigint, start bigint, ids array<bigint>") -> DataFrame:
    """The documents of a store: doc_id, start and ids; or what ``want(ids)`` makes of the ids.

    ``want`` gives a tuple of values per document for the columns of ``schema`` after ``start``.
    """
    code = spark.read.parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(code.id.max()) + 1 if len(code) else 1, np.int64)
    lengths[code.id.to_numpy(np.int64)] = code.length.to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(lengths)
    sums, base = {}, 0
    # One number per part, as many as there were tasks.
    for row in sorted(spark.read.parquet(f"{path}/parts").collect()):
        sums[row.part], base = base, base + row.n_ids
    made = want or (lambda ids: (ids.tolist(),))

    def run(batches):
        table = decoding_table(shared.value)
        names = [f.split()[0] for f in schema.split(",")]
        for batch in slices(batches, "bits", 1 << 20):
            for r in batch.to_pylist():
                many = np.array(r["doc_tokens"], np.int64)
                stretches = -(-many // STEP)
                left = np.repeat(many, stretches) - STEP * (np.arange(stretches.sum()) - np.repeat(np.cumsum(stretches) - stretches, stretches))
                ids = decode(r["bits"], np.frombuffer(r["marks"], "<u8").astype(np.int64), np.minimum(left, STEP), table)
                ends = np.cumsum(many)
                starts = ends - many + r["first_id"] + sums[r["part"]]
                values = [made(ids[e - n : e]) for e, n in zip(ends, many)]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(list(c)) for c in zip(*values)], names=names)

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, schema)


def size_and_crc(ids: np.ndarray) -> tuple[int, int]:
    return len(ids), zlib.crc32(ids.astype("<u4"))
