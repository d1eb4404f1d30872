"""Cleaning jobs over a ``messages(session_id, seq, role, content)`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import content as ct
from keepsake.functions import text as tx
from keepsake.operators.ordering import with_position, with_previous, with_running_sum, with_size

# Rows of a session that one task sorts; see operators.ordering.
CHUNK_TURNS = 4096


def turn_chunk(col: str = "seq") -> Column:
    return F.floor(F.col(col) / CHUNK_TURNS)


def clean(messages: DataFrame) -> DataFrame:
    """Flattened text without platform noise; empty and injected messages are dropped."""
    body = tx.strip_noise(ct.flatten(F.col("content")))
    # As a row of its own: otherwise the planner repeats the whole expression in the filter, for each time it is named there.
    made = messages.drop("text").select("*", F.explode_outer(F.array(body)).alias("text"))
    return made.filter((F.col("text") != "") & ~tx.is_injected(F.col("text")))


def noise_sessions(messages: DataFrame) -> DataFrame:
    """Sessions whose every non-blank user message is only a memory wrapper."""
    users = messages.filter((F.col("role") == "user") & (tx.strip(F.col("content")) != ""))
    return users.groupBy("session_id").agg(F.bool_and(tx.only_noise(F.col("content"))).alias("noise")).filter("noise").select("session_id")


def rule_report(messages: DataFrame) -> DataFrame:
    """Messages hit by each cleaning rule, in one pass."""
    flat = messages.select("content", ct.flatten(F.col("content")).alias("_flat"))
    body = F.col("_flat")
    rules = {
        "empty": tx.strip_noise(body) == "",
        "injected": tx.is_injected(body),
        "trivial": tx.is_trivial(body),
        "secret": tx.contains_secret(body),
        "wrapper_only": tx.only_noise(F.col("content")),
    }
    counts = flat.agg(*[F.sum(v.cast("bigint")).alias(k) for k, v in rules.items()])
    pairs = F.explode(F.create_map(*[x for k in rules for x in (F.lit(k), F.col(k))]))
    return counts.select(pairs.alias("rule", "n"))


def secret_report(rows: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """Secrets per rule and source."""
    hits = F.array(*[F.struct(F.lit(r).alias("rule"), tx.secret_hits(F.col(text_col), r).alias("n")) for r in tx.SECRET_RULES])
    return (
        rows.select(F.col(source_col).alias("source"), F.explode(hits).alias("h"))
        .filter("h.n > 0")
        .groupBy("source", "h.rule")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("h.n").alias("hits"))
    )


def turn_windows(messages: DataFrame, size: int = 4, min_messages: int = 2) -> DataFrame:
    """Chunks of ``size`` messages: (session_id, window_id, chunk_id, n, text)."""
    placed = with_position(messages, ["session_id"], [F.asc("seq")], turn_chunk()).withColumn(
        "window_id", F.floor(F.col("pos") / size)
    )
    line = F.concat_ws(": ", "role", "content")
    return (
        placed.groupBy("session_id", "window_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("_l"))
        .filter(F.col("n") >= min_messages)
        .select(
            "session_id",
            "window_id",
            F.concat("session_id", F.lit(":w"), "window_id").alias("chunk_id"),
            "n",
            F.array_join(F.col("_l.line"), "\n").alias("text"),
        )
    )


def last_turn(messages: DataFrame, keep: int = 4) -> DataFrame:
    """The last ``keep`` messages of every session as one text: (session_id, turn_text, user_text).

    Spark keeps ``keep`` rows per session and task before the shuffle.
    """
    from keepsake.operators.ordering import top_per_group

    last = top_per_group(messages, ["session_id"], [F.desc("seq")], keep, "_back")
    rows = F.sort_array(F.collect_list(F.struct("seq", "role", "text")))
    return last.groupBy("session_id").agg(rows.alias("_m")).select(
        "session_id",
        F.array_join(F.transform("_m", lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n").alias("turn_text"),
        F.array_join(F.transform(F.filter("_m", lambda m: m["role"] == "user"), lambda m: m["text"]), " ").alias("user_text"),
        F.element_at("_m", -1)["seq"].alias("last_seq"),
    )


def keep_last_pairs(messages: DataFrame, keep: int = 30, size_limit: int = 300 * 1024) -> DataFrame:
    """Marks each user or assistant message with its pair and whether it is kept.

    A user message opens a pair; an assistant message joins the user message
    right before it or stands alone. Over ``keep`` pairs the last ``keep`` stay;
    under it a session above ``size_limit`` bytes keeps its later half.
    """
    talk = messages.filter(F.col("role").isin("user", "assistant"))
    seen = with_previous(talk, ["session_id"], ["seq"], turn_chunk(), ["role"])
    opens = (F.col("role") == "user") | F.coalesce(F.col("previous.role") != "user", F.lit(True))
    numbered = with_running_sum(
        seen.withColumn("_open", opens.cast("bigint")), ["session_id"], [F.asc("seq")], turn_chunk(), "_open", "pair"
    )
    totals = numbered.groupBy("session_id").agg(
        F.max("pair").alias("pairs"), F.sum(F.octet_length("content")).alias("_bytes")
    )
    n = F.col("pairs")
    limit = F.when(n > keep, F.lit(keep)).when((n <= 1) | (F.col("_bytes") < size_limit), n).otherwise(
        F.greatest(F.lit(1), F.floor(n / 2))
    )
    return numbered.join(totals, "session_id").withColumn("kept", F.col("pair") > n - limit).drop("_open", "previous", "_bytes")
