"""Ingest of messages: windows, gate, episodes, facts, procedures, edges, persona and a log row per window."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import content as ct
from keepsake.functions import scene
from keepsake.functions import text as tx
from keepsake.operators import admission, embedding, extraction, graph, lifecycle, messages, persona, similarity, vectors
from keepsake.operators.ordering import with_position
from keepsake.session import cut


@dataclass(frozen=True)
class Stored:
    episodes: DataFrame | None = None  # episode_id, embedding
    facts: DataFrame | None = None  # fact_id, content, keywords, topic, entities, superseded_by, embedding
    procedures: DataFrame | None = None  # proc_id, success_count, embedding


@dataclass(frozen=True)
class Ingested:
    episodes: DataFrame
    facts: DataFrame
    procedures: DataFrame
    matches: DataFrame | None  # new facts near a stored one: new id, fact_id, score, action
    log: DataFrame  # chunk_id, outcome


def turns(rows: DataFrame, size: int = 4, min_messages: int = 2, by_first: bool = False) -> DataFrame:
    """Windows of clean messages: (session_id, window_id, chunk_id, ts, turn_text, user_text).

    A window is named by its number in the session or, ``by_first``, by its first
    message: batches of one session, which all count from 0, then share no name.
    """
    clean = messages.clean(rows).join(messages.noise_sessions(rows), "session_id", "left_anti")
    placed = with_position(clean, ["session_id"], [F.asc("seq")], messages.turn_chunk())
    grouped = placed.withColumn("window_id", F.floor(F.col("pos") / size)).groupBy("session_id", "window_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("ts").alias("ts"), F.min("seq").alias("_first"), F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("_m")
    )
    return grouped.filter(F.col("_n") >= min_messages).select(
        "session_id",
        "window_id",
        F.concat("session_id", F.lit(":m"), F.col("_first")).alias("chunk_id") if by_first else F.concat("session_id", F.lit(":w"), "window_id").alias("chunk_id"),
        "ts",
        F.array_join(F.transform("_m", lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n").alias("turn_text"),
        F.array_join(F.transform(F.filter("_m", lambda m: m["role"] == "user"), lambda m: m["text"]), " ").alias("user_text"),
    )


def gate(windows: DataFrame, text: str = "user_text", best: str = "best") -> DataFrame:
    """Adds ``outcome``: no_user_text, trivial, gate, or admitted."""
    scored = admission.admit(windows, text, best)
    return scored.withColumn(
        "outcome",
        F.when(F.col(text) == "", "no_user_text").when(tx.is_trivial(F.col(text)), "trivial").when(~F.col("admitted"), "gate").otherwise("admitted"),
    )


def nearest(new: DataFrame, stored: DataFrame | None, id_col: str, k: int = 1) -> DataFrame | None:
    """Best stored row per new row (query_id, id, score); exact, however many there are."""
    if stored is None:
        return None
    hits = vectors.knn(stored, new, k, id_col)
    return hits.groupBy("query_id").agg(F.max_by(id_col, F.struct("score", -F.col(id_col))).alias(id_col), F.max("score").alias("score"))


def earlier_wins(rows: DataFrame, vectors: DataFrame, text: str, score: float, id_col: str = "id") -> DataFrame:
    """Drops rows that resemble an earlier row of the batch above ``score``. Rows hold id, ts and a text, and get its ``embedding``.

    ``vectors`` has the embedding of every text. Copies of a text or a vector fold to the earliest first. What resembles
    an earlier row goes in a few passes over the rows; pairs are only formed of what these leave undecided.
    """
    # Few columns of fixed width first: these are summed up without a sort.
    by_time = rows.groupBy(text, "ts").agg(F.min(id_col).alias(id_col))
    by_text = by_time.groupBy(text).agg(F.min(F.struct("ts", id_col)).alias("_f"))
    # A hash in front of the vector: long arrays are only compared where it is equal.
    first = by_text.join(vectors, text).groupBy(F.xxhash64("embedding").alias("_h"), "embedding").agg(F.min("_f").alias("_f"))
    first = cut(first.select(F.col("_f.ts").alias("ts"), F.col(f"_f.{id_col}").alias(id_col), "embedding"))
    threshold = 2 * score - 1 + 1e-9
    nodes = lambda df: df.select(F.col(id_col).alias("id"), (-F.unix_micros("ts")).alias("early"))
    chosen, left = first.limit(0).select(id_col), first
    if first.groupBy(id_col).count().where(F.col("count") > 1).isEmpty():
        linked = first.where("embedding is not null")
        chosen, left = similarity.settle(linked, threshold, [F.asc_nulls_last("ts"), F.asc(id_col)], id_col)
        chosen = chosen.where("id = keeper_id").select(F.col("id").alias(id_col)).unionByName(first.where("embedding is null").select(id_col))
    if left is not None:
        pairs = similarity.similar_pairs(left, threshold, id_col)
        own = lifecycle.choose_keepers(nodes(left), pairs, ["early"]).filter("id = keeper_id")
        chosen = chosen.unionByName(own.select(F.col("id").alias(id_col)))
    return rows.join(chosen, id_col, "left_semi").join(vectors, text).select(*rows.columns, "embedding")


def run(rows: DataFrame, stored: Stored = Stored(), encode: Callable[[DataFrame, str], DataFrame] | None = None, dims: int = 384, min_messages: int = 2) -> Ingested:
    """One batch. ``rows``: (session_id, seq, role, content, ts). ``encode`` adds ``embedding`` for a text column."""
    encode = encode or (lambda df, col: embedding.hashed(df, col, dims))
    found = cut(turns(rows, min_messages=min_messages).withColumn("query_id", F.xxhash64("chunk_id")))
    # Vectors of windows are only needed, and made, where there are stored episodes to be compared with.
    seen = encode(found.withColumn("_head", F.substring("user_text", 1, admission.ADMISSION_CHARS)), "_head").select("query_id", "embedding")
    best = nearest(seen, stored.episodes, "episode_id", 3)
    scored = found.withColumn("best", F.lit(None).cast("double")) if best is None else found.join(
        best.select("query_id", F.col("score").alias("best")), "query_id", "left"
    )
    judged = cut(gate(scored))
    kept = judged.filter("outcome = 'admitted'").select("query_id", "session_id", "window_id", "chunk_id", "ts", "turn_text", "user_text").withColumn(
        "language", scene.language(F.col("user_text"))
    ).withColumn("domain", scene.domain(F.col("user_text"))).withColumn("summary", ct.summary_fallback(F.col("turn_text")))
    kept = cut(kept)
    # Equal texts are encoded once.
    encoded = lambda df, col: cut(encode(df.select(col).distinct(), col))
    fresh = kept.withColumn("_s", F.substring("summary", 1, ct.EMBED_CHARS)).withColumn("id", F.col("query_id"))
    summaries = encoded(fresh, "_s")
    near = nearest(fresh.join(summaries, "_s").select("query_id", "embedding"), stored.episodes, "episode_id")
    if near is not None:
        fresh = fresh.join(near.filter(F.col("score") > admission.SKIP_EPISODE), "query_id", "left_anti")
    new_eps = cut(earlier_wins(fresh, summaries, "_s", admission.SKIP_EPISODE).drop("_s"))

    # What a fact takes over from its window goes with it as one value, so nothing is joined back.
    source = F.struct("query_id", "session_id", "language", "domain", "ts")
    found_facts = extraction.rule_facts(kept.select(source.alias("_w"), F.col("user_text").alias("text")), "_w").filter(~tx.contains_secret(F.col("content")))
    raw = cut(found_facts.select("_w.query_id", "fact_no", "category", "content", "confidence", "_w.session_id", "_w.language", "_w.domain", "_w.ts"))
    facts = raw.withColumn("id", F.xxhash64("query_id", "fact_no", "content"))
    contents = encoded(facts, "content")
    matches = None
    fresh_facts = facts
    if stored.facts is not None:
        active = stored.facts.filter("superseded_by IS NULL")
        hit = nearest(facts.join(contents, "content").select(F.col("id").alias("query_id"), "embedding"), active, "fact_id").select(F.col("query_id").alias("id"), "fact_id", "score")
        matches = hit.withColumn("action", admission.ingest_action(F.col("score")))
        fresh_facts = facts.join(matches.filter("action = 'skip'"), "id", "left_anti")
    new_facts = cut(earlier_wins(fresh_facts, contents, "content", admission.SKIP_FACT))

    types = extraction.type_episodes(raw.join(new_eps.select("query_id"), "query_id", "left_semi"), "query_id")
    chained = extraction.chain_episodes(
        new_eps.join(types, "query_id", "left").select(
            F.col("id").alias("episode_id"), "query_id", "session_id", F.substring("turn_text", 1, ct.EPISODE_CHARS).alias("content"),
            F.coalesce("ep_type", F.lit("general")).alias("ep_type"), "language", "domain", "ts", "embedding",
        ),
        F.date_trunc("day", "ts"),
    )
    procs = extraction.procedure_facts(new_facts)
    if stored.procedures is not None:
        close = nearest(procs.select(F.col("id").alias("query_id"), "embedding"), stored.procedures, "proc_id")
        procs = procs.join(close.filter(F.col("score") >= admission.SKIP_PROCEDURE).select(F.col("query_id").alias("id")), "id", "left_anti")
    saved = new_eps.select("query_id", F.lit(True).alias("_saved"))
    log = judged.join(saved, "query_id", "left").select(
        "chunk_id", "session_id", "ts",
        F.when((F.col("outcome") == "admitted") & F.col("_saved").isNull(), "duplicate").otherwise(F.col("outcome")).alias("outcome"),
    )
    return Ingested(chained.drop("query_id"), new_facts, procs, matches, log)


def persona_of(facts: DataFrame, subject: str, owner) -> DataFrame:
    return persona.build(facts.select(F.col(subject).alias("subject"), "category", "content"), owner)


def edges_of(facts: DataFrame, stored: DataFrame | None = None, persons: str | None = None) -> DataFrame:
    """Co-occurrence edges of facts that carry entity (and person) lists."""
    return graph.upsert(graph.cooccurrences(facts, persons=persons), stored)


def observe(rows: DataFrame) -> DataFrame:
    """Hook events (observation_id, tool_name, tool_input, tool_output, hook_type, best) with content and action."""
    body = ct.observation_text(F.col("tool_name"), F.col("tool_input"), F.col("tool_output"))
    made = rows.withColumn("_raw", body).withColumn("content", tx.redact(F.col("_raw")))
    scored = admission.admit(made, "content", "best")
    return scored.withColumn(
        "action",
        F.when(tx.strip(F.col("_raw")) == "", "skipped_empty")
        .when(tx.is_trivial(F.col("_raw")) | tx.is_injected(F.col("_raw")), "skipped_filter")
        .when(~F.col("admitted"), "skipped_gate")
        .otherwise("observed"),
    ).drop("_raw")
