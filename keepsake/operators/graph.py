"""The entity graph as a table of directed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.operators.ordering import top_per_group
from keepsake.session import broadcast_if_small, cut

# --- fixed values ---
EDGE_TYPES = ["uses", "depends_on", "contradicts", "caused", "fixed", "supersedes", "related_to"]
BRIDGE_STOP = [
    "the", "and", "for", "with", "from", "that", "this", "have", "they", "were", "been", "their", "what", "when", "where",
]
MAX_SOURCES = 5
# --- end of fixed values ---


def cooccurrences(facts: DataFrame, entities: str = "entities", confidence: float = 0.8, persons: str | None = None) -> DataFrame:
    """Edge events for every pair of a fact's entities (and ``persons``, if named), both ways.

    Pairs are formed inside the row from a list the fact schema caps, so a fact
    gives a bounded number of rows and nothing is joined.
    """
    if persons is not None:
        none = F.array().cast("array<string>")
        facts = facts.withColumn(entities, F.array_distinct(F.concat(F.coalesce(F.col(persons), none), F.coalesce(F.col(entities), none))))
    pairs = F.flatten(
        F.transform(
            entities,
            lambda a, i: F.transform(
                F.slice(F.col(entities), i + 2, F.size(entities)), lambda b: F.struct(tx.slug(a).alias("a"), tx.slug(b).alias("b"))
            ),
        )
    )
    rows = facts.filter(F.size(entities) > 1).select(F.explode(pairs).alias("p"), "ts", F.col("fact_id").cast("string").alias("source"))
    both = F.explode(F.array(F.struct(F.col("p.a").alias("src"), F.col("p.b").alias("dst")), F.struct(F.col("p.b").alias("src"), F.col("p.a").alias("dst"))))
    return (
        rows.filter("p.a <> p.b")
        .select(both.alias("e"), "ts", "source")
        .select("e.src", "e.dst", F.lit("related_to").alias("type"), F.lit(confidence).alias("confidence"), "ts", "source")
    )


def typed_edges(rows: DataFrame) -> DataFrame:
    """Edge events from (source_entity, target_entity, type, confidence, ts, source, bidirectional)."""
    kind = F.when(F.col("type").isin(EDGE_TYPES), F.col("type")).otherwise("related_to")
    one = F.struct(tx.slug(F.col("source_entity")).alias("src"), tx.slug(F.col("target_entity")).alias("dst"))
    back = F.struct(tx.slug(F.col("target_entity")).alias("src"), tx.slug(F.col("source_entity")).alias("dst"))
    ends = F.when(F.col("bidirectional"), F.array(one, back)).otherwise(F.array(one))
    return (
        rows.select(F.explode(ends).alias("e"), kind.alias("type"), "confidence", "ts", "source")
        .select("e.src", "e.dst", "type", "confidence", "ts", "source")
        .filter("src <> dst")
    )


def upsert(events: DataFrame, stored: DataFrame | None = None, with_sources: bool = True, by_type: bool = False) -> DataFrame:
    """Edges (src, dst, type, confidence, source_count, last_seen, sources).

    Counts and maxima are combined before the shuffle. The type of the first
    write stays. Only the last five distinct sources of an edge are gathered.
    """
    keys = ["src", "dst", "type"] if by_type else ["src", "dst"]
    new = events.groupBy(*keys).agg(
        *([] if by_type else [F.min_by("type", F.struct("ts", "source")).alias("type")]),
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("source_count"),
        F.max("ts").alias("last_seen"),
        F.min("ts").alias("_first"),
    )
    if with_sources:
        seen = events.filter("source <> ''").groupBy(*keys, "source").agg(F.min("ts").alias("_at"))
        last = top_per_group(seen, keys, [F.desc("_at"), F.desc("source")], MAX_SOURCES, "_r")
        lists = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "source"))).alias("_s"))
        new = new.join(lists.select(*keys, F.col("_s.source").alias("sources")), keys, "left")
    if stored is None:
        return new.drop("_first")
    old = stored.withColumn("_first", F.lit("1970-01-01").cast("timestamp"))
    both = old.unionByName(new, allowMissingColumns=True)
    merged = both.groupBy(*keys).agg(
        *([] if by_type else [F.min_by("type", "_first").alias("type")]),
        F.max("confidence").alias("confidence"),
        F.sum("source_count").alias("source_count"),
        F.max("last_seen").alias("last_seen"),
        *([F.flatten(F.sort_array(F.collect_list(F.struct("_first", F.coalesce("sources", F.array().cast("array<string>")).alias("s"))))["s"]).alias("sources")] if with_sources else []),
    )
    if with_sources:  # at most two lists of five
        d = F.array_distinct("sources")
        merged = merged.withColumn("sources", F.slice(d, F.greatest(F.lit(1), F.size(d) - MAX_SOURCES + 1), MAX_SOURCES))
    return merged


def traverse(
    edges: DataFrame, starts: DataFrame, max_depth: int = 2, types: list[str] | None = None, max_nodes: int | None = None
) -> DataFrame:
    """Breadth-first walk from each start: (start, node, depth, edge_type, confidence, path).

    One join with the edges per hop. A node keeps the smallest path of its
    smallest depth; confidence is the least on that path. Many paths to a node are
    combined before the shuffle, and hub nodes are split by AQE's skew join.
    """
    use = edges if types is None else edges.filter(F.col("type").isin(types))
    use = use.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("type").alias("_type"), F.col("confidence").alias("_conf"))
    front = starts.select("start", F.col("start").alias("node"), F.lit(1.0).alias("confidence"), F.col("start").alias("path")).distinct()
    seen = front.select("start", "node")
    found = None
    for depth in range(1, max_depth + 1):
        step = front.join(use, F.col("node") == F.col("_src")).select(
            "start",
            F.col("_dst").alias("node"),
            F.col("_type").alias("edge_type"),
            F.least("confidence", "_conf").alias("confidence"),
            F.concat_ws(" → ", "path", "_type", "_dst").alias("path"),
        )
        best = step.groupBy("start", "node").agg(F.min_by(F.struct("edge_type", "confidence", "path"), "path").alias("_b"))
        front = cut(
            best.join(seen, ["start", "node"], "left_anti").select("start", "node", "_b.edge_type", "_b.confidence", "_b.path")
        )
        layer = front.withColumn("depth", F.lit(depth))
        found = layer if found is None else found.unionByName(layer)
        if depth < max_depth:
            seen = seen.unionByName(front.select("start", "node"))
    if max_nodes is not None:
        found = top_per_group(found, ["start"], [F.asc("depth"), F.asc("path")], max_nodes, "_r").drop("_r")
    return found


def related(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Distinct nodes within ``depth`` hops: (start, node)."""
    nodes = edges.select("src", "dst")
    front = starts.select("start", F.col("start").alias("node")).distinct()
    if depth > 1:
        return _related_together(nodes, front.select("start"), depth)
    step = front.join(nodes, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
    return step.filter("start <> node")


# Starts are numbered in groups of about so many rows, by hash.
NUMBERED = 4096


def _related_together(nodes: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``related`` over several hops: 64 starts walk together, as the bits of a number, so that an edge
    is met once for all of them and paths to a node are joined by *or* before the shuffle."""
    groups = max(1, starts.count() // NUMBERED)
    in_group = Window.partitionBy("_g").orderBy("start")
    numbered = starts.where("start is not null").withColumn("_g", F.pmod(F.xxhash64("start"), F.lit(groups))).withColumn("_n", F.row_number().over(in_group) - 1)
    placed = cut(numbered.select("start", (F.shiftleft("_g", 32) + F.floor(F.col("_n") / 64)).alias("block"), (F.col("_n") % 64).alias("bit")))
    joined = lambda df: df.groupBy("block", "node").agg(F.bit_or("mask").alias("mask"))
    reached = front = placed.select("block", F.col("start").alias("node"), F.expr("shiftleft(1L, bit)").alias("mask"))
    for hop in range(depth):
        step = front.join(nodes, F.col("node") == F.col("src")).select("block", F.col("dst").alias("node"), "mask")
        old, reached = reached, cut(joined(reached.unionByName(step)))
        if hop + 1 < depth:
            fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("bigint"))))
            front = reached.join(joined(old).withColumnRenamed("mask", "_old"), ["block", "node"], "left").select("block", "node", fresh.alias("mask")).where("mask <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("mask", b) == 1)
    return reached.select("block", "node", F.explode(bits).alias("bit")).join(broadcast_if_small(placed), ["block", "bit"]).select("start", "node").filter("start <> node")


def _members(hits: DataFrame, keys: list[str], min_len: int = 0, stop: list[str] | None = None) -> DataFrame:
    """(keys, member): lower-cased entities, persons and words of each hit."""
    words = F.filter(tx.word_set(F.col("content")), lambda w: (F.length(w) >= min_len) & ~w.isin(stop or [""]))
    parts = [F.transform(c, F.lower) for c in ("entities", "persons") if c in hits.columns]
    return hits.select(*keys, F.explode(F.array_distinct(F.concat(*parts, words))).alias("member"))


def entity_recall(hits: DataFrame, asked: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Of the nearest rows, the first ``k`` that name a graph neighbour of the asked entity.

    ``hits``: (query_id, fact_id, rank, content, entities), ``3 * k`` per query;
    ``asked``: (query_id, entity).
    """
    starts = asked.select(tx.slug(F.col("entity")).alias("start"), "query_id", "entity")
    near = related(edges.join(starts, F.col("src") == F.col("start"), "left_semi"), starts.select("start").distinct())
    wanted = starts.join(near, "start").select("query_id", "entity", F.col("node").alias("member")).distinct()
    match = _members(hits, ["query_id", "fact_id", "rank"]).join(wanted, ["query_id", "member"]).select("query_id", "entity", "fact_id", "rank").distinct()
    return top_per_group(match, ["query_id", "entity"], [F.asc("rank")], k, "pos")


def bridges(hits: DataFrame, edges: DataFrame, k: int = 3, n_terminals: int = 5, max_entities: int = 6) -> DataFrame:
    """Rows that connect the first hits of a query: (query_id, fact_id, rank, coverage).

    ``hits``: (query_id, fact_id, rank, content, entities). The first
    ``n_terminals`` are the terminals, the rest up to ``8 * k`` the candidates.
    """
    terminals = hits.filter(F.col("rank") <= n_terminals)
    others = hits.filter(F.col("rank") <= 8 * k).join(terminals.select("query_id", "content"), ["query_id", "content"], "left_anti")
    term_words = _members(terminals, ["query_id", "fact_id"], 4, BRIDGE_STOP)
    # Entities of any length count, words only from four letters.
    named = terminals.select("query_id", "fact_id", F.explode(F.transform("entities", F.lower)).alias("member"))
    term_set = term_words.unionByName(named).distinct().withColumnRenamed("fact_id", "terminal")
    first = top_per_group(named.select("query_id", "member").distinct(), ["query_id"], [F.asc("member")], max_entities, "_r")
    asked = first.select("query_id", tx.slug(F.col("member")).alias("start"))
    near = related(edges.join(asked, F.col("src") == F.col("start"), "left_semi"), asked.select("start").distinct())
    around = asked.join(near, "start").select("query_id", F.col("node").alias("member")).distinct()
    cand_set = _members(others, ["query_id", "fact_id", "rank"])
    cover = cand_set.join(term_set, ["query_id", "member"]).groupBy("query_id", "fact_id", "rank").agg(
        F.count_distinct("terminal").alias("coverage")
    )
    cand_ents = others.select("query_id", "fact_id", F.explode(F.transform("entities", F.lower)).alias("member"))
    touching = cand_ents.join(around, ["query_id", "member"], "left_semi").select("query_id", "fact_id").distinct().withColumn("_near", F.lit(True))
    good = cover.join(touching, ["query_id", "fact_id"], "left").filter((F.col("coverage") >= 2) | F.coalesce("_near", F.lit(False)))
    return top_per_group(good, ["query_id"], [F.asc("rank")], k, "pos").select("query_id", "fact_id", "rank", "coverage")


def stats(edges: DataFrame) -> DataFrame:
    """Nodes with outgoing edges, directed edges, and half of those."""
    return edges.agg(F.count_distinct("src").alias("nodes"), F.count(F.lit(1)).alias("directed")).withColumn(
        "undirected", F.floor(F.col("directed") / 2)
    )


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def top_nodes(edges: DataFrame, n: int = 60) -> tuple[DataFrame, DataFrame]:
    """The ``n`` nodes of most edges, and their edges, once per unordered pair."""
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(n)
    marked = edges.join(F.broadcast(top.select(F.col("node").alias("src"))), "src", "left_semi")  # at most n rows
    pair = marked.withColumn("low", F.least("src", "dst")).withColumn("high", F.greatest("src", "dst"))
    once = pair.groupBy("low", "high").agg(F.min_by(F.struct("src", "dst", "type"), "src").alias("e"))
    return top, once.select("e.src", "e.dst", "e.type")


def neighbours(edges: DataFrame) -> DataFrame:
    """Each edge with the degree of its target."""
    deg = degrees(edges).withColumnRenamed("node", "dst").withColumnRenamed("degree", "connections")
    return edges.join(deg, "dst", "left").select(
        "src", "dst", F.coalesce("connections", F.lit(0)).alias("connections"), "type", "confidence", "source_count"
    )
