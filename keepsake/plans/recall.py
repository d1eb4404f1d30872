"""Recall for a table of queries: search, fuse, boost, widen by the graph, and pack."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import depth, scene
from keepsake.operators import graph, lexical, packing, ranking, tools, vectors
from keepsake.operators.ordering import top_per_group
from keepsake.operators.vectors import Match
from keepsake.session import cut


@dataclass(frozen=True)
class Memory:
    """Tables recall reads. Only ``facts`` is required."""

    facts: DataFrame  # fact_id, content, category, importance, ts, access_count, session_id, embedding, ...
    episodes: DataFrame | None = None  # episode_id, session_id, content, ts, access_count, importance, embedding
    index: lexical.Index | None = None
    edges: DataFrame | None = None  # src, dst
    persona: str | DataFrame | None = None  # one text for all
    environment: str | None = None
    pinned: str | None = None
    contexts: DataFrame | None = None  # session_id, context
    digests: DataFrame | None = None  # latest: fact_count, summary, position
    tools: DataFrame | None = None  # tool_key, name, description, category, source, capability_summary, embedding
    tool_graph: DataFrame | None = None
    procedures: DataFrame | None = None  # proc_id, task, procedure, success_count, fail_count, embedding


@dataclass(frozen=True)
class Recalled:
    facts: DataFrame  # query_id, fact_id, rank, score, content
    episodes: DataFrame | None
    context: DataFrame  # query_id, context, tokens, items


def prepare(queries: DataFrame) -> DataFrame:
    """Adds scene tags and wanted numbers; columns already present stay."""
    t = F.col("text")
    have = set(queries.columns)
    extra = {
        "language": scene.language(t),
        "domain": scene.domain(t),
        "asks_tools": scene.asks_capability(t),
        "n_facts": depth.facts_wanted(t, F.col("memory_limit")),
        "n_episodes": depth.episodes_wanted(t, F.col("memory_limit")),
        "has_entities": F.lit(False),
        "has_time": F.lit(False),
        "token_budget": F.lit(packing.DEFAULT_BUDGET),
    }
    out = queries.select("*", *[v.alias(k) for k, v in extra.items() if k not in have])
    if "hyde_embedding" in have:
        out = out.withColumn("embedding", vectors.blend("embedding", "hyde_embedding"))
    return out


def _rules(queries: DataFrame, corpus: DataFrame) -> list[Match]:
    rules = []
    if "language" in corpus.columns:
        rules.append(Match("language", "language"))
    if "domain" in corpus.columns:
        rules.append(Match("domain", "domain", wildcard="general"))
    if "ts_ms" in corpus.columns:
        rules += [Match(c, "ts_ms", k) for c, k in (("time_from", "at_least"), ("time_to", "at_most")) if c in queries.columns]
    return rules


def rank_facts(memory: Memory, queries: DataFrame, as_of: Column, entity_vectors: DataFrame | None = None) -> DataFrame:
    """Fused, boosted and diversified facts: (query_id, fact_id, rank, score, content, n_limit)."""
    active = memory.facts.filter("superseded_by IS NULL") if "superseded_by" in memory.facts.columns else memory.facts
    k = int(queries.agg(F.max("n_facts")).first()[0] or 1)
    rules = _rules(queries, active)
    found = vectors.scene_then_global(active, queries, k, rules, wanted="n_facts")
    lists = [
        found.filter("source = 'scene'").select("query_id", "fact_id", "score", F.lit(1).alias("list_no")),
        found.filter("source = 'global'").select("query_id", "fact_id", "score", F.lit(2).alias("list_no")),
    ]
    if entity_vectors is not None:
        named = vectors.fan_out(queries, entity_vectors.filter("part < 3"), active, 3)
        seen = lists[0].select("query_id", "fact_id")
        lists.append(
            named.join(seen, ["query_id", "fact_id"], "left_anti").select("query_id", "fact_id", ((1 + F.col("cosine")) / 2).alias("score"), F.lit(3).alias("list_no"))
        )
    warm = vectors.attach(reduce(DataFrame.unionByName, lists), active, ["ts", "access_count", "content"])
    warm = warm.withColumn("heat_score", F.greatest(F.lit(0.0), F.col("score")) * ranking.heat(F.col("ts"), F.col("access_count"), as_of))
    w = Window.partitionBy("query_id", "list_no").orderBy(F.desc(F.round("heat_score", 12)), F.asc("fact_id"))
    ranked = warm.withColumn("rank", F.row_number().over(w)).select("query_id", "fact_id", "content", "list_no", "rank")
    if memory.index is not None:
        text = "topic_text" if "topic_text" in queries.columns else "text"
        bm = lexical.search(memory.index, queries, k, text).withColumnRenamed("doc_id", "fact_id")
        bm = bm.join(queries.select("query_id", "n_facts"), "query_id").filter("rank <= n_facts")
        ranked = ranked.unionByName(
            vectors.attach(bm, active, ["content"]).select("query_id", "fact_id", "content", F.lit(4).alias("list_no"), "rank")
        )
    weights = queries.select("query_id", "n_facts", ranking.fusion_weights(F.col("has_entities"), F.col("has_time")).alias("_w"))
    weighted = ranked.join(weights, "query_id").withColumn("weight", F.element_at("_w", F.col("list_no")))
    fused = cut(ranking.fuse(weighted, k)).join(queries.select("query_id", "n_facts", "text"), "query_id").filter("rank <= n_facts")
    return _boost(fused.drop("rank"), active, 0.06, 0.15, 3, "fact_id").withColumnRenamed("n_facts", "n_limit")


def _boost(fused: DataFrame, corpus: DataFrame, keyword: float, importance: float, per_session: int, id_col: str) -> DataFrame:
    cols = [c for c in ("importance", "session_id", "keywords") if c in corpus.columns]
    full = vectors.attach(fused, corpus, cols, id_col).withColumn("_tokens", lexical.boost_tokens(F.col("text")))
    words = F.col("keywords") if "keywords" in cols else None
    score = F.col("rrf") + lexical.keyword_boost(F.col("_tokens"), F.col("content"), words, keyword)
    scored = full.withColumn("score", ranking.importance_boost(score, F.col("importance"), importance))
    order = [F.desc(F.round("score", 12)), F.asc(id_col)]
    kept = ranking.diversify(scored, per_session, order) if "session_id" in cols else scored
    w = Window.partitionBy("query_id").orderBy(*order)
    return kept.withColumn("rank", F.row_number().over(w)).drop("_tokens", "rrf", "importance", "session_id", "keywords", "text")


def rank_episodes(memory: Memory, queries: DataFrame, as_of: Column) -> DataFrame:
    eps = memory.episodes
    k = int(queries.agg(F.max("n_episodes")).first()[0] or 2)
    both = vectors.knn_in_and_out(eps, queries, k, _rules(queries, eps), "episode_id")
    in_scope = lambda scope: both.where(F.col("scope") == scope).drop("scope")
    scene_hits = in_scope(vectors.FILTERED)
    wants = queries.select("query_id", "n_episodes")
    scene_hits = scene_hits.join(wants, "query_id").filter("rank <= n_episodes")
    found = scene_hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    gap = wants.join(found, "query_id", "left").select(
        "query_id", F.when(n < F.greatest(F.lit(2), F.floor(F.col("n_episodes") / 2)), F.col("n_episodes") - n).otherwise(0).alias("_gap")
    )
    fill = in_scope(vectors.OPEN).join(gap, "query_id").filter("rank <= _gap")
    part = lambda df, no: df.select("query_id", "episode_id", "score", F.lit(no).alias("list_no"))
    warm = vectors.attach(part(scene_hits, 1).unionByName(part(fill, 2)), eps, ["ts", "access_count", "content"], "episode_id")
    warm = warm.withColumn("heat_score", F.greatest(F.lit(0.0), F.col("score")) * ranking.heat(F.col("ts"), F.col("access_count"), as_of))
    w = Window.partitionBy("query_id", "list_no").orderBy(F.desc(F.round("heat_score", 12)), F.asc("episode_id"))
    weights = queries.select("query_id", ranking.fusion_weights(F.col("has_entities"), F.col("has_time")).alias("_w"))
    lists = warm.withColumn("rank", F.row_number().over(w)).join(weights, "query_id").withColumn("weight", F.element_at("_w", F.col("list_no")))
    fused = cut(ranking.fuse(lists, k, id_col="episode_id")).join(queries.select("query_id", "n_episodes", "text"), "query_id").filter("rank <= n_episodes")
    return _boost(fused.drop("rank"), eps, 0.03, 0.05, 4, "episode_id")


def widen(memory: Memory, queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Graph and bridge facts appended for queries that name entities or ask for the graph."""
    asks = F.col("has_entities") | (F.col("include_graph") if "include_graph" in queries.columns else F.lit(False))
    going = queries.filter(asks)
    active = memory.facts.filter("superseded_by IS NULL")
    wide = vectors.attach(vectors.knn(active, going, 24), active, ["content", "entities"])
    wide = cut(wide)
    top = vectors.attach(ranked.filter("rank <= 3").select("query_id", "fact_id", "rank"), active, ["entities"])
    named = top.select("query_id", "rank", F.posexplode("entities").alias("at", "entity"))
    first = top_per_group(named, ["query_id", "entity"], [F.asc("rank"), F.asc("at")], 1, "_r")
    asked = top_per_group(first, ["query_id"], [F.asc("rank"), F.asc("at")], 5, "_no").join(going.select("query_id"), "query_id", "left_semi")
    near = graph.entity_recall(wide.filter("rank <= 6"), asked.select("query_id", "entity"), memory.edges, 2)
    order = asked.select("query_id", "entity", "_no")
    extra = near.join(order, ["query_id", "entity"]).select("query_id", "fact_id", (F.col("_no") * 100 + F.col("pos")).alias("extra_rank"))
    content = active.select("fact_id", "content")
    step = cut(ranking.append_extra(ranked, vectors.attach(extra, active, ["content"]), 3))
    # Bridges start from what is ranked now: its first five and the nearest others.
    terminals = vectors.attach(step.filter("rank <= 5").select("query_id", "fact_id", "rank"), active, ["content", "entities"])
    cands = wide.select("query_id", "fact_id", (F.col("rank") + 5).alias("rank"), "content", "entities")
    both = terminals.join(going.select("query_id"), "query_id", "left_semi").unionByName(cands)
    found = graph.bridges(both, memory.edges, k=3 + 1)  # ranks moved by five terminals: 8 * k must cover them
    best = top_per_group(found, ["query_id"], [F.asc("rank")], 3, "_b")
    bridge = best.select("query_id", "fact_id", F.col("rank").alias("extra_rank"))
    return ranking.append_extra(step, vectors.attach(bridge, active, ["content"]), 5)


def recall(memory: Memory, queries: DataFrame, as_of: Column, entity_vectors: DataFrame | None = None) -> Recalled:
    """The whole plan. Reading writes nothing: hits may be kept for ``ranking.bump_access``."""
    q = cut(prepare(queries))
    ranked = cut(rank_facts(memory, q, as_of, entity_vectors))
    wide = ranked.select("query_id", "fact_id", "content", "rank", "n_limit")
    if memory.edges is not None:
        wide = cut(widen(memory, q, ranked))
    ids = q.select("query_id")
    blank = F.array().cast("array<string>")
    parts = []
    one_text = lambda name, text: parts.append(packing.section(ids, name, 0, F.lit(text)))
    if memory.persona:
        one_text("persona", memory.persona)
    has_context = None
    if memory.contexts is not None:
        has_context = q.select("query_id", "session_id").join(memory.contexts, "session_id").select("query_id", "context")
        parts.append(packing.section(has_context, "session", 0, F.col("context")))
    if memory.pinned:
        fresh = ids if has_context is None else ids.join(has_context, "query_id", "left_anti")
        parts.append(packing.section(fresh, "summary", 0, F.substring(F.lit(memory.pinned), 1, 600)))
    if memory.digests is not None:
        # Three lines for all queries, read as one value.
        line = packing.digest_line(F.col("fact_count"), F.col("summary"))
        three = memory.digests.filter("position < 3").agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))))
        rows = ids.withColumn("_d", F.explode(three.scalar())).select("query_id", "_d.position", "_d.line")
        parts.append(packing.section(rows, "digests", "position", F.col("line")))
    asking = q.filter("asks_tools")
    if memory.environment:
        parts.append(packing.section(asking.select("query_id"), "environment", 0, F.lit(memory.environment)))
    if memory.tools is not None:
        hits = vectors.knn(memory.tools, asking, 6, "tool_key")
        rows = vectors.attach(hits, memory.tools, ["name", "category", "source", "description", "capability_summary"], "tool_key")
        line = packing.tool_line(*[F.col(c) for c in ("name", "category", "source", "description", "capability_summary")])
        block = rows.groupBy("query_id").agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("rank", line.alias("l"))))["l"], "\n").alias("t"), F.min_by("tool_key", "rank").alias("src")
        )
        if memory.tool_graph is not None:
            block = block.join(tools.next_tool_hints(memory.tool_graph), "src", "left")
            tail = F.when(F.col("hint").isNotNull(), F.concat(F.lit("\n- *Frequent next tools*: "), "hint")).otherwise("")
        else:
            tail = F.lit("")
        parts.append(packing.section(block, "tools", 0, F.concat(F.lit("## Available Tools (Relevant)\n"), "t", tail)))
    if memory.procedures is not None:
        hits = vectors.attach(vectors.knn(memory.procedures, q, 6, "proc_id"), memory.procedures, ["task", "procedure", "success_count", "fail_count"], "proc_id")
        adjusted = hits.withColumn("_a", ranking.beta_score(F.col("score"), F.col("success_count"), F.col("fail_count")))
        best = top_per_group(adjusted, ["query_id"], [F.desc(F.round("_a", 12)), F.asc("proc_id")], 2, "pos")
        parts.append(packing.section(best, "skills", "pos", packing.skill_line(F.col("task"), F.col("procedure"))))
    optional = {"persons": blank, "entities": blank, "topic": F.lit(""), "triple_str": F.lit("")}
    shown = vectors.attach(wide.select("query_id", "fact_id", "rank"), memory.facts.select(
        "fact_id", "content", "category", *[(F.col(c) if c in memory.facts.columns else v).alias(c) for c, v in optional.items()]
    ), ["content", "category", *optional])
    parts.append(packing.section(shown, "facts", "rank", packing.fact_line(*[F.col(c) for c in ("rank", "category", "content", "persons", "entities", "topic", "triple_str")])))
    episodes = None
    if memory.episodes is not None:
        episodes = cut(rank_episodes(memory, q, as_of))
        kind = F.col("ep_type") if "ep_type" in memory.episodes.columns else F.lit("general")
        typed = vectors.attach(episodes.select("query_id", "episode_id", "rank"), memory.episodes.select("episode_id", "content", kind.alias("ep_type")), ["content", "ep_type"], "episode_id")
        parts.append(packing.section(typed, "episodes", "rank", packing.episode_line(F.col("rank"), F.col("ep_type"), F.col("content"))))
    packed = packing.pack(reduce(DataFrame.unionByName, parts), q.select("query_id", "token_budget"))
    return Recalled(wide, episodes, packed)
