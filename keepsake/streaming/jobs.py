"""Structured Streaming jobs. Each returns a query writer or a streaming DataFrame; callers choose the trigger."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators import ranking, sessions, tools
from keepsake.session import ensure_checkpoint_dir
from keepsake.streaming import state

# --- fixed values ---
CONSOLIDATE_EVERY_FACTS = 50
CONSOLIDATE_HOURLY_OVER = 5
HARD_PRUNE_EVERY_RUNS = 24
DIGEST_EVERY_HOURS = 6
# --- end of fixed values ---


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run over everything available and read the result back from the checkpoint folder.

    In ``update`` and ``complete`` mode each batch replaces its own folder, so a
    batch that is run again after a lost executor leaves no second copy.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.outputMode(mode).foreachBatch(
            lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
        ).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else f"{_ddl(stream)}, batch bigint").parquet(f"{base}/out")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def idempotent_sink(path: str, step: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler: the tables ``step`` makes of a batch, each under its batch number."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, df in step(batch).items():
                df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return handle


def continuous_ingest(messages: DataFrame, path: str, checkpoint: str, ingest: Callable[[DataFrame], dict[str, DataFrame]]):
    """Messages -> tier tables, batch by batch. ``ingest`` compares a batch with the stored tables."""
    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(idempotent_sink(path, ingest))


def tool_outcomes(calls: DataFrame) -> DataFrame:
    """Counters per tool, for update or complete mode."""
    return tools.tool_outcomes(calls)


def outcome_rates(calls: DataFrame, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Success rate per tool in tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return calls.withWatermark("ts", delay).groupBy("tool", w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("success").cast("int")).alias("rate")
    )


def session_windows(events: DataFrame, gap: str = "4 hours", delay: str = "1 hour") -> DataFrame:
    return sessions.session_windows(events, gap, delay)


def transitions(calls: DataFrame, ttl_ms: int | None = state.TTL_MS) -> DataFrame:
    """(previous, current) tool pairs; count them downstream."""
    state.use_rocksdb(calls.sparkSession)
    return state.previous_rows(calls, "tool", "event_id", ttl_ms).filter("previous <> current")


def episode_links(episodes: DataFrame, ttl_ms: int | None = state.TTL_MS) -> DataFrame:
    """Each episode with the one before it; the next one is filled by ``extraction.chain_episodes`` in batch."""
    state.use_rocksdb(episodes.sparkSession)
    rows = episodes.withColumn("_id", F.col("episode_id").cast("string"))
    return state.previous_rows(rows, "_id", "episode_id", ttl_ms).select(
        "session_id", "episode_id", F.col("previous").cast("bigint").alias("prev_episode_id")
    )


def rolling_contexts(summaries: DataFrame, ttl_ms: int | None = state.TTL_MS) -> DataFrame:
    state.use_rocksdb(summaries.sparkSession)
    return state.rolling_contexts(summaries, ttl_ms)


def without_redelivery(rows: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each key once, however often it is delivered within the delay."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def split_late(rows: DataFrame, arrival: str, delay_minutes: int, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that arrived later than the delay, to be kept aside before the stateful step."""
    late = (F.unix_micros(arrival) - F.unix_micros(ts)) > delay_minutes * 60_000_000
    return rows.filter(~late), rows.filter(late)


def access_bumps(hits: DataFrame, facts: Callable[[], DataFrame], path: str, checkpoint: str, id_col: str = "fact_id"):
    """Hits of recall applied to the facts: each batch writes the touched rows of the next version.

    A batch starts from the rows earlier batches wrote and takes only facts that
    none touched from ``facts``; run again, it sees the same earlier batches.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            touched = batch.select(id_col).distinct()
            now = facts().join(touched, id_col, "left_semi")
            if number and (done := bumped(batch.sparkSession, path, id_col, number)) is not None:
                before = done.join(touched, id_col, "left_semi")
                now = before.unionByName(now.join(before.select(id_col), id_col, "left_anti"), allowMissingColumns=True)
            ranking.bump_access(now, batch, id_col).write.mode("overwrite").parquet(f"{path}/facts/batch={number}")
        finally:
            batch.unpersist()

    return hits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)


def bumped(spark: SparkSession, path: str, id_col: str = "fact_id", before: int | None = None) -> DataFrame | None:
    """The newest version of each fact that batches (numbered below ``before``) of ``access_bumps`` wrote; None if there is none."""
    # Only a folder that is not there means that no batch was written; other errors are errors.
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/facts")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder) or not files.listStatus(folder):
        return None
    rows = spark.read.parquet(f"{path}/facts")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.groupBy(id_col).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [id_col, "batch"]).drop("batch")


def upkeep_due(facts_since: Column, hours_since: Column, prune_runs: Column, hours_since_digest: Column) -> dict[str, Column]:
    """Which batch jobs a scheduler should start, from the counters of the ingest log."""
    return {
        "consolidate": (facts_since >= CONSOLIDATE_EVERY_FACTS) | ((hours_since >= 1) & (facts_since > CONSOLIDATE_HOURLY_OVER)),
        "hard_prune": prune_runs >= HARD_PRUNE_EVERY_RUNS,
        "digest": hours_since_digest >= DIGEST_EVERY_HOURS,
    }
