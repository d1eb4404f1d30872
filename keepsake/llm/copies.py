"""Rows whose text may occur more than once, found by content hashes without moving any text.

Texts are hashed to 128 bits and counted by hash; hashes of two rows or more become
a blocked Bloom filter. While it has at most ``FILTER_BLOCKS`` blocks (64 bytes each)
it is broadcast, and a row that fails it is the only one of its text. Beyond that all
rows count as possible copies, which costs a shuffle of their texts and changes no result.

Only column functions, so that native operators may use it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.url_filters import BITS_PER_KEY, WORDS, _block, _word, bloom_filter
from keepsake.session import cut

# 8 million repeated hashes at 16 bits each, 16 MB of bits.
FILTER_BLOCKS = 1 << 18
# Groups above a share of 1 / HOT_GROUPS of all rows are hot, so there are at most HOT_GROUPS of them.
HOT_GROUPS = 10_000
# Smaller groups are never hot; a hot one is dealt out in parts of about so many rows.
HOT_ROWS = 500
# A text's rows meet in so many parts before they meet as a whole.
SALTS = 32


def hash128(text: Column) -> Column:
    """The 16 bytes of a text's MD5."""
    return F.unhex(F.md5(text))


@dataclass
class Repeated:
    """``groups``: hash, n of hashes that two rows or more have. ``rows``: all rows counted."""

    groups: DataFrame
    rows: int

    @classmethod
    def of(cls, hashes: DataFrame) -> Repeated:
        """From the column ``hash`` of all rows; counts are combined in the task that reads the rows."""
        counts = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("shared", F.col("n") > 1)
        # A unique hash leaves nothing but its share of one row per task of the shuffle.
        part = F.when(~F.col("shared"), F.spark_partition_id())
        own = counts.groupBy(F.when(F.col("shared"), F.col("hash")).alias("hash"), part.alias("part")).agg(F.sum("n").alias("n"))
        kept = cut(own)
        total = kept.agg(F.sum("n")).first()[0] or 0
        return cls(kept.where("hash is not null").select("hash", "n"), total)

    def hot(self) -> DataFrame:
        """hash, parts: groups of so many rows that each is dealt out in parts; a bounded number."""
        hot = self.groups.where(F.col("n") >= max(HOT_ROWS, self.rows // HOT_GROUPS))
        return F.broadcast(hot.select("hash", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts")))

    def flagged(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a column ``hash``) and ``possible``: false only where the hash occurs once."""
        return flagged(rows, "hash", self.groups.select("hash"))


def flagged(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` and ``possible``: false only where ``column`` is none of the ``keys`` (one column, distinct)."""
    held = keys.select(F.col(keys.columns[0]).alias("key"))
    blocks = max(1, -(-held.count() * BITS_PER_KEY // (64 * WORDS)))
    if blocks > FILTER_BLOCKS:
        return rows.withColumn("possible", F.lit(True))
    bloom = F.broadcast(bloom_filter(held, blocks))
    probed = rows.withColumn("key", F.col(column)).withColumn("block", _block("key", blocks)).join(bloom, "block", "left")
    hit = F.lit(True)
    for w in range(WORDS):
        hit = hit & (F.col(f"word{w}").bitwiseAND(_word("key", w)) == _word("key", w))
    return probed.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("possible"))


def same_text(rows: DataFrame, name: str, fold: Callable[[Column | str], Column], value: Column) -> DataFrame:
    """hash, text, n and ``fold`` of ``value`` for every text: hashes bring rows together, their bytes decide.

    Rows fold in the task that reads them, then per part, then as a whole, so that of a
    text with a third of all rows one row per task travels.
    """
    salted = rows.select("hash", "text", value.alias(name), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    parts = salted.groupBy("hash", "text", "salt").agg(F.count(F.lit(1)).alias("n"), fold(name).alias(name))
    return parts.groupBy("hash", "text").agg(F.sum("n").alias("n"), fold(name).alias(name))
