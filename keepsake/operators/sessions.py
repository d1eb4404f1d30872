"""Rolling contexts, promotion of ended sessions, digests and listings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import content as ct
from keepsake.functions import text as tx
from keepsake.operators.ordering import top_per_group, with_position

# --- fixed values ---
FOLD_OVER, FOLD_TO, CONTEXT_CAP = 1200, 900, 1500
JOIN = "\n---\n"
PROMOTE_CHARS, PINNED_CHARS = 80, 600
DIGEST_HOURS, DIGEST_MIN_FACTS, DIGEST_TOP, DIGEST_AGE_HOURS = 1, 5, 20, 24
# --- end of fixed values ---


def append_context(existing: Column, summary: Column) -> Column:
    """One step of the rolling context, without a model: append; over 1200 characters the first 900 stay."""
    joined = F.concat(existing, F.lit(JOIN), summary)
    longer = F.when(F.length(joined) > FOLD_OVER, F.substring(joined, 1, FOLD_TO)).otherwise(joined)
    return F.substring(F.when(existing == "", summary).otherwise(longer), 1, CONTEXT_CAP)


def rolling_contexts(summaries: DataFrame, chunk_turns: int = 4096) -> DataFrame:
    """Context per session after its last turn: (session_id, turns, context).

    ``summaries``: (session_id, seq, summary). The context is built turn by turn,
    but its shape depends only on lengths: text is appended until it passes 1200
    characters, which sets it back to its first 900, and those never change
    again. So each chunk of a session is reduced to a small table saying, for
    each length the context may have on entry, the length on leaving and the
    turn that the current run began with. These tables are chained per session,
    and only the turns of the first 900 characters and of the last run are
    gathered. No task reads a whole session.
    """
    placed = with_position(
        summaries.filter("summary <> ''").withColumn("summary", F.substring(tx.redact(F.col("summary")), 1, CONTEXT_CAP)),
        ["session_id"], [F.asc("seq")], F.floor(F.col("seq") / chunk_turns),
    ).withColumn("_chunk", F.floor(F.col("pos") / chunk_turns))
    lengths = placed.select("session_id", "_chunk", "pos", F.length("summary").alias("n"))
    parts = lengths.groupBy("session_id", "_chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("_l"))
    maps = parts.select("session_id", "_chunk", F.col("_l.pos").alias("pos"), F.col("_l.n").alias("n")).mapInArrow(
        _length_maps, "session_id bigint, _chunk bigint, turns bigint, upto array<int>, leave array<int>, began array<bigint>"
    )
    # Start in the state "empty" (length 0); walk the chunk tables in order.
    def walk(acc, m):
        at = F.array_position(F.transform(m["upto"], lambda u: u >= acc["state"]), True).cast("int") - 1
        began = F.get(m["began"], at)
        return F.struct(
            F.get(m["leave"], at).alias("state"),
            F.when(began == -1, acc["began"]).otherwise(began).alias("began"),
            (acc["folded"] | (began != -1)).alias("folded"),
        )

    empty = F.struct(F.lit(0).alias("state"), F.lit(-1).cast("bigint").alias("began"), F.lit(False).alias("folded"))
    chained = maps.groupBy("session_id").agg(
        F.sum("turns").alias("turns"),
        F.sort_array(F.collect_list(F.struct("_chunk", "upto", "leave", "began"))).alias("_m"),
    ).withColumn("_end", F.aggregate("_m", empty, walk)).select(
        "session_id", "turns", F.col("_end.began").alias("_began"), F.col("_end.folded").alias("_folded")
    )
    # A turn adds at least the joiner, so the first 900 characters need few turns.
    head_turns = FOLD_TO // len(JOIN) + 1
    need = placed.join(chained, "session_id").filter((F.col("pos") <= head_turns) | (F.col("pos") >= F.col("_began")) & F.col("_folded") | ~F.col("_folded"))
    rows = need.groupBy("session_id", "turns", "_began", "_folded").agg(
        F.sort_array(F.collect_list(F.struct("pos", "summary"))).alias("_r")
    )
    texts = lambda cond: F.array_join(F.transform(F.filter("_r", cond), lambda r: r["summary"]), JOIN)
    head = F.substring(texts(lambda r: F.lit(True)), 1, FOLD_TO)
    run = texts(lambda r: r["pos"] >= F.col("_began"))
    folded = F.when(run == "", head).otherwise(F.concat(head, F.lit(JOIN), run))
    return rows.select("session_id", "turns", F.when(F.col("_folded"), folded).otherwise(texts(lambda r: F.lit(True))).alias("context"))


def _length_maps(batches):
    """For every entry length 0..1500 of a chunk: leaving length, and first turn after the last set-back (-1: none).

    Entry lengths with equal results are stored as one range; after a few turns
    nearly all of them agree, so a table is a handful of numbers.
    """
    size = CONTEXT_CAP + 1
    for batch in batches:
        upto, leave, began, turns = [], [], [], []
        for pos, n in zip(batch.column("pos").to_pylist(), batch.column("n").to_pylist()):
            state = np.arange(size)
            start = np.full(size, -1, dtype=np.int64)
            for p, k in zip(pos, n):
                grown = np.where(state == 0, k, state + len(JOIN) + k)
                over = (state > 0) & (grown > FOLD_OVER)
                state = np.minimum(np.where(over, FOLD_TO, grown), CONTEXT_CAP)
                start = np.where(over, p + 1, start)
            last = np.flatnonzero(np.r_[(state[1:] != state[:-1]) | (start[1:] != start[:-1]), True])
            upto.append(last)
            leave.append(state[last])
            began.append(start[last])
            turns.append(len(pos))
        lists = lambda rows, kind: pa.array([[int(x) for x in r] for r in rows], pa.list_(kind))
        yield pa.RecordBatch.from_arrays(
            [batch.column("session_id"), batch.column("_chunk"), pa.array(turns, pa.int64()), lists(upto, pa.int32()), lists(leave, pa.int32()), lists(began, pa.int64())],
            names=["session_id", "_chunk", "turns", "upto", "leave", "began"],
        )


def compact(contexts: DataFrame, threshold: int = 3000, chunk: int = 1200, target: int = 1000) -> DataFrame:
    """Long contexts folded down: (session_id, size_before, size_after, context)."""
    size = F.length("context")
    starts = F.sequence(F.lit(1), size, F.lit(chunk))
    pieces = F.transform(starts, lambda s: F.substr(F.col("context"), s, F.lit(chunk)))
    fold = lambda memory, piece: F.substring(F.concat(memory, F.lit(JOIN), piece), 1, target)
    many = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), ct.summary_fallback(F.get(pieces, F.lit(0))), fold)
    mid = F.floor(size / 2).cast("int")
    halves = fold(F.substr(F.col("context"), F.lit(1), mid), F.substr(F.col("context"), mid + 1))
    done = F.substring(F.when(size > 2 * chunk, many).otherwise(halves), 1, CONTEXT_CAP)
    return contexts.filter(size > threshold).select(
        "session_id", size.alias("size_before"), F.length(done).alias("size_after"), done.alias("context")
    )


def promote(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ended sessions (session_id, context, ended_at) -> summary episodes, and the one pinned summary.

    Facts come from ``extraction.rule_facts`` over the ``context`` column of the first.
    """
    clean = contexts.filter(F.length("context") >= PROMOTE_CHARS).withColumn("context", tx.strip_noise(F.col("context")))
    kept = clean.filter(F.length("context") >= PROMOTE_CHARS).withColumn("summary", ct.summary_fallback(F.col("context")))
    episodes = kept.withColumn("content", F.concat(F.lit("[Session Summary] "), F.substring("summary", 1, 2000)))
    last = kept.agg(F.max_by(F.struct("session_id", F.substring(tx.strip_noise(F.col("summary")), 1, PINNED_CHARS).alias("summary")), F.struct("ended_at", "session_id")).alias("p"))
    return episodes, last.select("p.session_id", "p.summary")


MINUTE, SECOND = 60_000_000, 1_000_000


def digests(
    sessions: DataFrame, facts: DataFrame, as_of: Column, done: DataFrame | None = None, min_facts: int = DIGEST_MIN_FACTS, top: int = DIGEST_TOP
) -> DataFrame:
    """Digest per session of the facts within an hour of its start.

    ``sessions``: (session_id, ts); ``facts``: (fact_id, ts, importance, category,
    entities). Facts are summed up per minute, per second and per instant first.
    A session then reads whole minutes inside its range, whole seconds at both
    ends, and instants in the two outer seconds: at most some 240 small rows
    however many facts lie there, and never the facts themselves. Sessions that
    start at the same instant share the work.
    """
    ready = sessions.filter((F.unix_micros(as_of) - F.unix_micros("ts")) >= DIGEST_AGE_HOURS * 3600 * 1_000_000)
    if done is not None:
        ready = ready.join(done.select("session_id"), "session_id", "left_anti")
    ready = ready.withColumn("_s", F.unix_micros("ts"))
    lo, hi = F.col("_s") - DIGEST_HOURS * 3600 * 1_000_000 + 1, F.col("_s") + DIGEST_HOURS * 3600 * 1_000_000 - 1  # inclusive
    first_m, end_m = F.ceil(lo / MINUTE), F.floor((hi + 1) / MINUTE)
    to_m, from_m = first_m * MINUTE, end_m * MINUTE
    ceil_s, floor_s = F.ceil(lo / SECOND), F.floor((hi + 1) / SECOND)
    safe = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    level = lambda name, keys: F.transform(keys, lambda k: F.struct(F.lit(name).alias("level"), k.cast("bigint").alias("key")))
    keys = F.concat(
        level("m", safe(first_m, end_m - 1)),
        level("s", safe(ceil_s, F.floor(to_m / SECOND) - 1)),
        level("s", safe(F.floor(from_m / SECOND), floor_s - 1)),
        level("i", F.array_distinct(F.array(F.floor(lo / SECOND), F.floor(hi / SECOND)))),
    )
    starts = ready.select("_s", lo.alias("_lo"), hi.alias("_hi"), ceil_s.alias("_cs"), floor_s.alias("_fs")).distinct().withColumn("_k", F.explode(keys)).select(
        "_s", "_lo", "_hi", "_cs", "_fs", "_k.level", "_k.key"
    )

    timed = facts.withColumn("_t", F.unix_micros("ts"))
    at = F.explode(F.array(
        F.struct(F.lit("m").alias("level"), F.floor(F.col("_t") / MINUTE).alias("key"), F.lit(None).cast("bigint").alias("instant")),
        F.struct(F.lit("s").alias("level"), F.floor(F.col("_t") / SECOND).alias("key"), F.lit(None).cast("bigint").alias("instant")),
        F.struct(F.lit("i").alias("level"), F.floor(F.col("_t") / SECOND).alias("key"), F.col("_t").alias("instant")),
    ))
    slots = timed.withColumn("_at", at).select("*", "_at.level", "_at.key", "_at.instant")
    group = ["level", "key", "instant"]
    inside = (F.col("level") != "i") | (
        F.col("instant").between(F.col("_lo"), F.col("_hi"))
        # Seconds wholly inside are read as seconds; instants only from the cut ones.
        & ((F.col("key") < F.col("_cs")) | (F.col("key") >= F.col("_fs")))
    )
    near = lambda part: starts.join(part, ["level", "key"]).filter(inside)
    counts = near(slots.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))).groupBy("_s").agg(F.sum("n").alias("facts_available"))
    order = [F.desc("importance"), F.asc("fact_id")]
    best = top_per_group(slots.select(*group, "importance", "fact_id", "category"), group, order, top, "_r").drop("_r")
    tops = top_per_group(near(best).select("_s", "importance", "fact_id", "category"), ["_s"], order, top, "_r")
    lists = tops.groupBy("_s").agg(
        F.sort_array(F.collect_list(F.struct("_r", "fact_id"))).alias("_f"), F.sort_array(F.collect_set("category")).alias("categories")
    )
    names = slots.select(*group, F.explode("entities").alias("entity")).distinct()
    ents = near(names).select("_s", "entity").distinct().groupBy("_s").agg(F.sort_array(F.collect_list("entity")).alias("entities"))
    return (
        ready.select("session_id", "_s")
        .join(counts.filter(F.col("facts_available") >= min_facts), "_s")
        .join(lists, "_s")
        .join(ents, "_s", "left")
        .select(
            "session_id",
            F.size("_f").alias("fact_count"),
            "facts_available",
            F.col("_f.fact_id").alias("fact_ids"),
            F.coalesce("entities", F.array().cast("array<string>")).alias("entities"),
            "categories",
            as_of.alias("crystallized_at"),
        )
    )


def latest_digests(found: DataFrame, n: int = 3) -> DataFrame:
    return found.orderBy(F.desc("crystallized_at"), F.desc("session_id")).limit(n)


def session_windows(events: DataFrame, gap: str = "4 hours", watermark: str | None = None) -> DataFrame:
    """Sessions by inactivity; with a watermark also on a stream."""
    src = events.withWatermark("ts", watermark) if watermark else events
    grouped = src.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def timeline(episodes: DataFrame, limit: int = 20) -> DataFrame:
    """Newest episodes of each session."""
    return top_per_group(episodes, ["session_id"], [F.desc("ts"), F.desc("episode_id")], limit, "pos").select(
        "session_id", "episode_id", F.substring("content", 1, 200).alias("content"), "ts", "pos"
    )


def observations(episodes: DataFrame) -> DataFrame:
    return episodes.select("episode_id", F.substring("content", 1, 300).alias("content"), "session_id", "ts")


def session_list(contexts: DataFrame) -> DataFrame:
    return contexts.select("session_id", F.substring("context", 1, 300).alias("summary"), F.length("context").alias("length"))


def commit_list(commits: DataFrame, branch: str | None = None, repo: str | None = None, limit: int = 20) -> DataFrame:
    rows = commits
    if branch:
        rows = rows.filter(F.col("branch") == branch)
    if repo:
        rows = rows.filter(F.col("repo") == repo)
    return rows.orderBy(F.desc("ts"), "sha").limit(limit)
