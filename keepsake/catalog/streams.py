"""Registered queries that run a stream over a whole table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.catalog import derived as d
from keepsake.catalog.graph_tools import GRAPH
from keepsake.catalog.registry import ENTRIES, query
from keepsake.catalog.sessions import SUMMARIES
from keepsake.streaming import jobs


def call_stream(spark, sf):
    """The event log as a stream of tool calls."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return jobs.parquet_stream(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"),
        F.concat(F.lit("tool_"), k % 12).alias("tool"), (F.col("event_type") != "error").alias("success"), "value", "event_type",
    )


@query("stream_tool_outcomes", "STR4 TL6", ENTRIES["tool_reliability"].sql)
def stream_tool_outcomes(spark, sf):
    return jobs.run_to_end(jobs.tool_outcomes(call_stream(spark, sf)), "complete").drop("batch")


@query("stream_outcome_rates", "STR4", f"""WITH {d.TOOL_CALLS} SELECT 'tool_' || (k % 12) AS tool, epoch_us(date_trunc('day', ts)) AS day, count(*) AS n, round(avg((event_type <> 'error')::INT), 4) AS rate FROM calls GROUP BY ALL""")
def stream_outcome_rates(spark, sf):
    """Success rates per tool and day, as windows of a stream."""
    out = jobs.run_to_end(jobs.outcome_rates(call_stream(spark, sf), "1 day"), "complete")
    return out.select("tool", F.unix_micros("w.start").alias("day"), "n", F.round("rate", 4).alias("rate"))


@query("stream_transitions", "STR5 TL2", f"WITH {GRAPH} SELECT src, dst, n FROM tg")
def stream_transitions(spark, sf):
    pairs = jobs.run_to_end(jobs.transitions(call_stream(spark, sf), None))
    return pairs.groupBy(F.col("previous").alias("src"), F.col("current").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_episode_links", "STR6", "SELECT event_id AS episode_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_episode_id FROM events")
def stream_episode_links(spark, sf):
    eps = call_stream(spark, sf).withColumnRenamed("event_id", "episode_id")
    return jobs.run_to_end(jobs.episode_links(eps, None)).select("episode_id", "prev_episode_id")


@query("stream_rolling_context", "STR2 SES1 SES2", ENTRIES["rolling_context"].sql)
def stream_rolling_context(spark, sf):
    text = F.concat(F.lit("ran "), "tool", F.lit(" for "), F.col("value").cast("string"), F.repeat(F.lit(" step"), (F.col("event_id") % 9).cast("int")))
    rows = call_stream(spark, sf).select("session_id", F.col("event_id").alias("seq"), text.alias("summary"))
    out = jobs.run_to_end(jobs.rolling_contexts(rows, None), "update")
    return out.groupBy("session_id").agg(F.max("turns").alias("turns"), F.max_by("context", "batch").alias("context"))


@query("stream_session_windows", "STR3 SES8", f"""WITH {d.TOOL_CALLS}, g AS (SELECT session_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 14400000000 THEN 0 ELSE 1 END AS o FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
s AS (SELECT session_id, ts, sum(o) OVER (PARTITION BY session_id ORDER BY ts) AS k FROM g)
SELECT session_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY session_id, k
HAVING (epoch_us(max(ts)) + 14400000000) <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM calls)""")
def stream_session_windows(spark, sf):
    """Sessions closed by the watermark; the open ones at the end of the log stay in state."""
    out = jobs.run_to_end(jobs.session_windows(call_stream(spark, sf)))
    return out.select("session_id", F.unix_micros("start").alias("start"), "n")


@query("stream_redelivery", "STR7", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_redelivery(spark, sf):
    """Every call delivered twice, counted once."""
    twice = call_stream(spark, sf).union(call_stream(spark, sf))
    once = jobs.run_to_end(jobs.without_redelivery(twice, ["event_id"]).select("event_id", "event_type"))
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_late_rows", "STR10", "SELECT event_id % 97 = 0 AS late, count(*) AS n FROM events GROUP BY 1")
def stream_late_rows(spark, sf):
    """Arrival times set so that some rows come two days late; both outputs are kept."""
    wait = F.make_dt_interval(F.when(F.col("event_id") % 97 == 0, 2).otherwise(0))
    rows = call_stream(spark, sf).withColumn("arrived", F.col("ts") + wait)
    on_time, late = jobs.split_late(rows, "arrived", 60)
    both = jobs.run_to_end(on_time.select("event_id", F.lit(False).alias("late"))).unionByName(jobs.run_to_end(late.select("event_id", F.lit(True).alias("late"))))
    return both.groupBy("late").agg(F.count(F.lit(1)).alias("n"))


@query("stream_access_bumps", "STR8 HEAT3", f"WITH {d.FACTS}, h AS (SELECT event_id * 7 % (SELECT count(*) FROM documents) AS fact_id, count(*) AS n FROM events GROUP BY 1) SELECT fact_id, access_count + n AS access_count FROM facts JOIN h USING (fact_id)")
def stream_access_bumps(spark, sf):
    import uuid

    from keepsake.session import ensure_checkpoint_dir

    n = d.table(spark, sf, "documents").count()
    base = f"{ensure_checkpoint_dir(spark)}/bumps-{uuid.uuid4().hex}"
    hits = call_stream(spark, sf).select((F.col("event_id") * 7 % n).alias("fact_id"), F.col("ts").alias("hit_ts"))
    jobs.access_bumps(hits, lambda: d.facts(spark, sf), f"{base}/out", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return jobs.bumped(spark, f"{base}/out").select("fact_id", "access_count")


@query("stream_ingest", "STR1 STR9", None)
def stream_ingest(spark, sf):
    """Statements streamed through the ingest gate, with the upkeep a scheduler would start after each batch."""
    import uuid

    from keepsake.operators import extraction
    from keepsake.plans import ingest
    from keepsake.session import cut, ensure_checkpoint_dir

    base = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    said = jobs.parquet_stream(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), F.lit("user").alias("role"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("I prefer "), F.lower("o_orderpriority"), F.lit(", always use box "), F.col("o_orderkey") % 50, F.lit(".")).alias("content"),
    )

    def step(batch):
        # Three tables are made of the turns and two of the facts.
        turns = cut(ingest.gate(ingest.turns(batch, min_messages=1, by_first=True).withColumn("best", F.lit(None).cast("double"))).select("chunk_id", "user_text", "outcome"))
        kept = turns.filter("outcome = 'admitted'")
        facts = cut(extraction.rule_facts(kept.select("chunk_id", F.col("user_text").alias("text")), "chunk_id"))
        due = jobs.upkeep_due(F.count(F.lit(1)), F.lit(0), F.lit(0), F.lit(0))
        return {"log": turns.select("chunk_id", "outcome"), "facts": facts, "upkeep": facts.agg(*[v.alias(k) for k, v in due.items()])}

    jobs.continuous_ingest(said, f"{base}/out", f"{base}/state", step).trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(f"{base}/out/log")
    return log.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
