"""Fixity audit of WARC archives with Merkle trees.

``write_warc`` stores pages as WARC files, ``records`` reads them back as one row
per record with its place and SHA-256, and ``audit`` compares two replicas. Each
archive's records are the leaves of a tree. A node covers a stretch of records that
begins where a hash of the record id is a multiple of ``FANOUT`` (of its powers,
further up), about ``FANOUT`` children. Its hash covers the hashes of its children in
order and their ranges of offsets, counted from the node's own start. So a record that
is lost, added or of another length changes the nodes above it and no others, however
far it moves what follows. The archives' roots go on to one root of the replica. The
audit starts at the two roots and descends only where hashes differ; below the lowest
nodes that differ, records are matched by id.

A node gathers some ``FANOUT`` rows, and at most an archive's. An archive is closed
after ``ARCHIVE_BYTES`` (or one longer record), which bounds what a reading task holds.
Archives and places come from the order in which Spark deals out the table's files, so
a repeated task writes the same file again.

Defined cases: a null page is an empty payload, a null url an empty header value,
line ends in a url become blanks; null and repeated ids are kept as separate
records; an empty table gives empty archives and an empty audit; other columns are
ignored. Where a record's stated length does not lead to the next record, or its
header is broken, it ends before the next record mark. A record whose id cannot be read
any more is ``extra``, and its original ``missing``. Records of one id are matched in
their order; a record that only moved is not reported.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.llm.common import slices
from keepsake.session import cut

FANOUT = 64
ARCHIVE_BYTES = 32 << 20
ARCHIVE_SHIFT = 12
DATE = "2024-02-01T00:00:00Z"
MARK = b"WARC/1.0\r\n"
END = b"\r\n\r\n"

RECORDS = "archive bigint, ordinal bigint, record_id string, start bigint, stop bigint, digest string"


def write_warc(pages: DataFrame, path: str, damage: Column | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages as gzipped WARC files, one folder per archive, without a shuffle.

    ``damage``, if given, replaces the stored payload while header and length stay
    those of the page; it serves to make a damaged replica.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    plain = pages.select(
        F.coalesce(F.col(page_id).cast("string"), F.lit("")).alias("id"),
        F.translate(F.coalesce(F.col(url).cast("string"), F.lit("")), "\r\n", "  ").alias("url"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("size"),
        (payload if damage is None else F.coalesce(damage, F.lit(""))).alias("text"),
    )

    def run(batches):
        first, held, archive = TaskContext.get().partitionId() << ARCHIVE_SHIFT, 0, 0
        for batch in slices(batches):
            archives, values = [], []
            for r in batch.to_pylist():
                if held > ARCHIVE_BYTES:
                    held, archive = 0, archive + 1
                head = (
                    f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{r['id']}>\r\nWARC-Date: {DATE}\r\n"
                    f"WARC-Target-URI: {r['url']}\r\nWARC-Payload-Digest: sha256:{r['digest']}\r\n"
                    f"Content-Type: text/html\r\nContent-Length: {r['size']}\r\n\r\n"
                )
                archives.append(first + archive)
                values.append(head + r["text"])
                held += len(values[-1])
            yield pa.RecordBatch.from_arrays([pa.array(archives, pa.int64()), pa.array(values, pa.string())], names=["archive", "value"])

    rows = plain.mapInArrow(run, "archive bigint, value string")
    rows.write.partitionBy("archive").option("lineSep", END.decode()).option("compression", "gzip").text(path)


def parsed(data: bytes):
    """(record id, start, stop) of the records of one archive."""
    size_of, id_of = re.compile(rb"\r\nContent-Length: ([0-9]+)\r\n"), re.compile(rb"\r\nWARC-Record-ID: <urn:page:([^\r\n]*)>")
    at = 0
    while at < len(data):
        body = data.find(END, at)
        head = data[at : body + 2] if body >= 0 else data[at:]
        size, name = size_of.search(head), id_of.search(head)
        stop = body + 4 + int(size[1]) + 4 if size and body >= 0 else -1
        # The stated end counts if a record mark or the end of the file follows it.
        if stop != len(data) and not (0 < stop < len(data) and data.startswith(MARK, stop) and data.startswith(END, stop - 4)):
            following = data.find(END + MARK, at)
            stop = following + 4 if following >= 0 else len(data)
        yield (name[1].decode("utf-8", "replace") if name else None), at, stop
        at = stop


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = gzip.decompress(content.as_py())
                rows = [(archive, n, name, a, b, hashlib.sha256(memoryview(data)[a:b]).hexdigest()) for n, (name, a, b) in enumerate(parsed(data))]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in RECORDS.split(", ")])

    files = spark.read.format("binaryFile").load(path)
    if "archive" not in files.columns:
        return spark.createDataFrame([], RECORDS)
    return files.select(F.col("archive").cast("bigint"), "content").mapInArrow(run, RECORDS)


def _folded(nodes: DataFrame, keys: list[str], place: str) -> DataFrame:
    """One node per ``keys`` and side: the hash of its children in order of ``place``, with ranges counted from its start."""
    child = F.struct(F.col(place).alias("place"), "digest", "start", "stop")
    grouped = nodes.groupBy("side", *keys).agg(F.sort_array(F.collect_list(child)).alias("c"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    seen = F.transform("c", lambda x: F.concat_ws(":", *[(x[c] - F.col("start")).cast("string") for c in ("start", "stop")], x["digest"]))
    return grouped.select("side", *keys, F.sha2(F.concat_ws("\n", seen), 256).alias("digest"), "start", "stop")


def _rooted(archives: DataFrame) -> DataFrame:
    """Roots of archives one level up: up to FANOUT to one, by number."""
    child = F.struct("archive", "digest")
    grouped = archives.groupBy("side", F.expr(f"archive div {FANOUT}").alias("archive")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    seen = F.transform("c", lambda x: F.concat_ws(":", x["archive"].cast("string"), x["digest"]))
    return grouped.select("side", "archive", F.sha2(F.concat_ws("\n", seen), 256).alias("digest"))


def _height(most: int) -> int:
    """Levels of nodes of about FANOUT children each over so many places."""
    n = 0
    while FANOUT ** (n + 1) <= most:
        n += 1
    return n


def tree(leaves: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """Levels of both replicas' trees (column ``side``), from the leaves to the roots, each with the columns that name a node.

    ``node1`` is the id of the record that begins a lowest node, and so on; archives are
    above them. Every level is written out: the descent reads each once more.
    """
    most = leaves.agg(F.max("ordinal").alias("o"), F.max("archive").alias("a")).first()
    names = [f"node{k}" for k in range(1, _height(most.o or 0) + 1)]
    before = Window.partitionBy("side", "archive").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = {name: F.when(F.crc32("record_id") % FANOUT**k == 0, F.col("record_id")) for k, name in enumerate(names, 1)}
    placed = leaves.withColumns({name: F.coalesce(F.last(own, True).over(before), F.lit("")) for name, own in begins.items()}) if names else leaves
    levels = [(["archive", *names], cut(placed))]
    for k in range(1, len(names) + 1):
        keys = ["archive", *names[k - 1 :]]
        levels.append((keys, cut(_folded(levels[-1][1], keys, "start"))))
    levels.append((["archive"], cut(_folded(levels[-1][1], ["archive"], "start"))))
    for _ in range(_height(most.a or 0) + 1):
        levels.append((["archive"], cut(_rooted(levels[-1][1]))))
    return levels


def _sides(nodes: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Both sides' nodes at each place where their hashes differ or one has nothing; a group has two rows at most."""
    both = nodes.groupBy(*keys).agg(*[F.first(F.when(F.col("side") == side, F.struct(*carried)), True).alias(side) for side in "ab"])
    return both.where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))


def descend(leaves: DataFrame) -> tuple[DataFrame, list[int]]:
    """Leaves of both sides below differing nodes, and the number of such nodes per level, from the top."""
    (lowest, records_), *levels = tree(leaves)
    suspect, counts = None, []
    for i, (keys, level) in enumerate(reversed(levels)):
        # Roots of several archives are above those of one.
        above = i <= len(levels) - len(lowest)
        if suspect is not None and above:
            parent = suspect.withColumnRenamed("archive", "_parent")
            level = level.withColumn("_parent", F.expr(f"archive div {FANOUT}")).join(parent, "_parent", "left_semi").drop("_parent")
        elif suspect is not None:
            level = level.join(suspect, suspect.columns, "left_semi")
        suspect = cut(_sides(level, keys, ["digest"]).select(*keys))
        counts.append(suspect.count())
    return records_.join(suspect, suspect.columns, "left_semi"), counts


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ: archive, ordinal (of the original, if there), record_id, state, and both offset ranges.

    ``state`` is ``changed``, ``missing`` (in the replica) or ``extra``.
    """
    leaves = cut(original.withColumn("side", F.lit("a")).unionByName(replica.withColumn("side", F.lit("b"))))
    below, _ = descend(leaves)
    same_id = Window.partitionBy("side", "archive", "record_id").orderBy("ordinal")
    numbered = below.withColumn("number", F.row_number().over(same_id))
    found = _sides(numbered, ["archive", "record_id", "number"], ["ordinal", "start", "stop", "digest"])
    state = F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "extra").otherwise("changed")
    return found.select(
        "archive",
        F.coalesce("a.ordinal", "b.ordinal").alias("ordinal"),
        "record_id",
        state.alias("state"),
        *[F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("a", "original"), ("b", "replica")) for c in ("start", "stop")],
    )
