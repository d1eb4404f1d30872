"""Positions and neighbours inside groups, without putting a whole group in one task.

A plain window over ``session_id`` sorts a session in one task, which fails when
one session holds a third of all rows. Here each group is cut into chunks by an
expression of the ordering column (a turn block, an hour). The big window runs
per (group, chunk); only one small row per chunk crosses chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(
    df: DataFrame, keys: list[str], order: list[Column], chunk: Column, out: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row in its group. ``chunk`` must not decrease along ``order``."""
    chunked = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        chunked.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(out, (F.col("_offset") + F.col("_rn") - 1).cast("bigint"))
        .drop("_chunk", "_rn", "_offset")
    )


def with_size(df: DataFrame, keys: list[str], out: str = "group_size") -> DataFrame:
    """Add the number of rows of the group; the count is combined before the shuffle."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), keys)


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, cols: list[str], out: str = "previous"
) -> DataFrame:
    """Add a struct of the previous row's ``cols`` in the group (null for the first row)."""
    return _neighbour(df, keys, order, chunk, cols, out, forward=False)


def with_next(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, cols: list[str], out: str = "following"
) -> DataFrame:
    """Add a struct of the next row's ``cols`` in the group (null for the last row)."""
    return _neighbour(df, keys, order, chunk, cols, out, forward=True)


def _neighbour(df, keys, order, chunk, cols, out, forward):
    chunked = df.withColumn("_chunk", chunk)
    payload = F.struct(*cols)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    edge_row = F.min_by if forward else F.max_by
    shift = F.lead if forward else F.lag
    edges = (
        chunked.groupBy(*keys, "_chunk")
        .agg(edge_row(payload, F.struct(*order)).alias("_edge"))
        .select(*keys, "_chunk", shift("_edge").over(chunks).alias("_carried"))
    )
    return (
        chunked.withColumn("_near", shift(payload).over(inside))
        .join(edges, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_chunk", "_near", "_carried")
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark prunes to ``k`` per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[Column], chunk: Column, value: str, out: str
) -> DataFrame:
    """Add the running sum of ``value`` along the group, this row included."""
    chunked = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.sum(value).alias("_s"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        chunked.withColumn("_run", F.sum(value).over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.col("_offset") + F.col("_run"))
        .drop("_chunk", "_run", "_offset")
    )
