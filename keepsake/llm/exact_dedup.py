"""Exact dedup: rows grouped by a 128-bit content hash, texts compared byte by byte inside groups.

1. Hashes are counted; only rows whose hash may occur twice (``copies``) carry their
   text any further, all others are unique and leave the job.
2. Possible copies are grouped by hash and text, in the task that reads them, then in
   one of ``SALTS`` parts, then as a whole: equal bytes fold at every step, so that of
   a text with a third of all rows one row per task travels. Two texts with one hash
   stay two groups.
3. A row finds its group by its hash; where a hash has several texts, by hash and text.
   Groups above a share of the rows, a bounded number, are broadcast.

All of it is column functions; no Python runs on the executors.

Defined cases: a null text counts as empty. A row with a null doc_id stays only where
no row of its text has an id. Of repeated rows (equal id and text) one stays. An empty
table gives an empty result. Other columns, whatever their names, pass through
``clean`` and are ignored by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import id_text
from keepsake.llm.copies import SALTS, Repeated, hash128, same_text
from keepsake.session import cut

LEAST, GREATEST = "least", "greatest"


def unchanged(text: Column) -> Column:
    return text


def _rank(keep: str, doc_id: Column) -> Column:
    """The row with the greatest rank stays."""
    if keep not in (LEAST, GREATEST):
        raise ValueError(f"keep is {LEAST!r} or {GREATEST!r}, not {keep!r}")
    # Null is the least of a column, so a null id loses either way.
    return doc_id if keep == GREATEST else -doc_id.cast("decimal(20,0)")


def _hashed(docs: DataFrame, doc_id: str, text: str, normalise: Callable[[Column], Column], content_hash: Callable[[Column], Column]) -> DataFrame:
    rows = id_text(docs, doc_id, text).withColumn("text", normalise(F.coalesce("text", F.lit(""))))
    return rows.withColumn("hash", content_hash(F.col("text")))


def dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: str = LEAST,
    normalise: Callable[[Column], Column] = unchanged,
    content_hash: Callable[[Column], Column] = hash128,
) -> DataFrame:
    """doc_id, keep_id (of the row that stays), group_size, kept, text_sha256 of every row."""
    rows = _hashed(docs, doc_id, text, normalise, content_hash)
    repeated = Repeated.of(rows.select("hash"))
    shown = rows.select("doc_id", "hash", "text", F.sha2("text", 256).alias("text_sha256"))
    # Numbers of rows are written before they are compared.
    marked = cut(
        repeated.flagged(shown).select("doc_id", "hash", "text_sha256", "possible", F.when(F.col("possible"), F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row"))
    )
    single = marked.where("not possible").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    possible = marked.where("possible")
    best = F.struct(_rank(keep, F.col("doc_id")).alias("rank"), (-F.col("row")).alias("place"), "doc_id")
    groups = cut(same_text(possible, "best", F.max, best))
    return single.unionByName(_placed(possible, groups, repeated))


def _placed(rows: DataFrame, groups: DataFrame, repeated: Repeated) -> DataFrame:
    """Every row with its group."""

    def shown(joined: DataFrame) -> DataFrame:
        kept = F.col("row") == -F.col("best.place")
        return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256")

    plain, mixed = groups.select("hash", "n", "best"), None
    collided = cut(groups.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash"))
    if not collided.isEmpty():
        mixed = shown(rows.join(collided, "hash", "left_semi").join(groups, ["hash", "text"]))
        rows, plain = rows.join(collided, "hash", "left_anti"), plain.join(collided, "hash", "left_anti")
    narrow = rows.select("doc_id", "hash", "text_sha256", "row")
    hot = repeated.hot()
    often = shown(narrow.join(F.broadcast(plain.join(hot.select("hash"), "hash", "left_semi")), "hash"))
    rest = shown(narrow.join(hot, "hash", "left_anti").join(plain, "hash"))
    return often.unionByName(rest) if mixed is None else often.unionByName(rest).unionByName(mixed)


def clean(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: str = LEAST,
    normalise: Callable[[Column], Column] = unchanged,
    content_hash: Callable[[Column], Column] = hash128,
) -> DataFrame:
    """``docs`` with one row of each text, its columns as they were."""
    whole = F.struct(*docs.columns)
    plain = normalise(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(whole.alias("whole"), F.col(doc_id).cast("bigint").alias("doc_id"), plain.alias("text")).withColumn("hash", content_hash(F.col("text")))
    flagged = Repeated.of(_hashed(docs, doc_id, text, normalise, content_hash).select("hash")).flagged(rows)
    rank = F.struct(F.col("doc_id").isNotNull(), _rank(keep, F.col("doc_id")))
    salted = flagged.where("possible").withColumn("rank", rank).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    parts = salted.groupBy("hash", "text", "salt").agg(F.max_by("whole", "rank").alias("whole"), F.max("rank").alias("rank"))
    kept = parts.groupBy("hash", "text").agg(F.max_by("whole", "rank").alias("whole"))
    return flagged.where("not possible").select("whole.*").unionByName(kept.select("whole.*"))
