"""Life cycle of facts: reviews, deletes, reinforcement, feedback, merge and statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import decay
from keepsake.operators.components import components
from keepsake.operators.ordering import top_per_group
from keepsake.operators.ranking import days_between
from keepsake.session import cut


def reviews_due(facts: DataFrame, as_of: Column) -> DataFrame:
    """One row per review step of a fact that is due at ``as_of``."""
    steps = F.array(
        *[F.struct(F.lit(p).alias("priority"), F.lit(r).alias("ratio")) for p, r in decay.REVIEW_RATIOS.items()]
    )
    s = decay.report_stability(F.col("category"))
    return (
        facts.withColumn("_step", F.explode(steps))
        .withColumn("when_days", F.round(s * F.col("_step.ratio"), 1))
        .filter(days_between(as_of, F.col("last_confirmed_ts")) >= F.col("when_days"))
        .select("fact_id", F.col("_step.priority").alias("priority"), "when_days", decay.half_life(F.col("category")).alias("half_life"))
    )


def soft_delete(facts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Apply (fact_id, by, reason, at). The first delete of a fact counts; later ones change nothing."""
    first = tombstones.groupBy("fact_id").agg(
        F.min_by(F.struct("by", "reason", "at"), F.struct("at", "by")).alias("_t")
    )
    fresh = F.col("superseded_by").isNull() & F.col("_t").isNotNull()
    have_reason = F.col("superseded_reason") if "superseded_reason" in facts.columns else F.lit(None).cast("string")
    have_at = F.col("superseded_at") if "superseded_at" in facts.columns else F.lit(None).cast("timestamp")
    return (
        facts.join(first, "fact_id", "left")
        .withColumn("superseded_reason", F.when(fresh, F.col("_t.reason")).otherwise(have_reason))
        .withColumn("superseded_at", F.when(fresh, F.col("_t.at")).otherwise(have_at))
        .withColumn("superseded_by", F.coalesce("superseded_by", "_t.by"))
        .drop("_t")
    )


def is_hard_pruned(as_of: Column, tier: str, age_from: str = "ts") -> Column:
    """Rows to drop for good: superseded over 7 days ago, and episodes of 180 days never accessed."""
    age = days_between(as_of, F.col(age_from))
    gone = F.col("superseded_by").isNotNull() & (age > 7)
    if tier == "episodes":
        gone = gone | ((days_between(as_of, F.col("ts")) > 180) & (F.coalesce("access_count", F.lit(0)) == 0))
    return gone


def reinforce(facts: DataFrame, events: DataFrame, max_sources: int = 10) -> DataFrame:
    """Apply (fact_id, source, at) to active facts.

    Counts are combined before the shuffle, and only the newest distinct sources
    of a fact are gathered, so a fact with very many events stays a small row.
    """
    counts = events.groupBy("fact_id").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    seen = events.filter("source <> ''").groupBy("fact_id", "source").agg(F.min("at").alias("_first"))
    newest = top_per_group(seen, ["fact_id"], [F.desc("_first"), F.desc("source")], max_sources, "_r")
    lists = newest.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("_first", "source"))).alias("_s"))
    active = F.col("superseded_by").isNull() & F.col("_n").isNotNull()
    have = F.col("sources") if "sources" in facts.columns else F.array().cast("array<string>")
    version = F.col("version") if "version" in facts.columns else F.lit(1)
    new = F.array_distinct(F.concat(F.coalesce(have, F.array().cast("array<string>")), F.coalesce(F.col("_s.source"), F.array().cast("array<string>"))))
    last = F.slice(new, F.greatest(F.lit(1), F.size(new) - max_sources + 1), max_sources)
    return (
        facts.join(counts, "fact_id", "left")
        .join(lists, "fact_id", "left")
        .withColumn("sources", F.when(active, last).otherwise(have))
        .withColumn("version", version + F.when(active, F.col("_n")).otherwise(0))
        .withColumn("source_count", F.col("source_count") + F.when(active, F.col("_n")).otherwise(0))
        .withColumn("last_confirmed_ts", F.when(active, F.col("_at")).otherwise(F.col("last_confirmed_ts")))
        .drop("_n", "_at", "_s")
    )


INF = float("inf")


def _then(f: Column, g: Column) -> Column:
    """Composition of two clamped scalings x -> min(hi, max(lo, a*x)): again one."""
    bound = lambda v: F.least(g["hi"], F.greatest(g["lo"], g["a"] * v))
    return F.struct((f["a"] * g["a"]).alias("a"), bound(f["lo"]).alias("lo"), bound(f["hi"]).alias("hi"))


def _identity() -> Column:
    return F.struct(F.lit(1.0).alias("a"), F.lit(-INF).alias("lo"), F.lit(INF).alias("hi"))


def apply_feedback(facts: DataFrame, ratings: DataFrame, chunk: Column) -> DataFrame:
    """Apply (fact_id, rating, at, rating_id) in time order.

    A rating of 4 or 5 raises importance by a fifth up to 1 and reinforces; 1 or 2
    lowers it by 0.3 down to 0.05 and asks for review. The clamps make the order
    matter, but clamped scalings compose into one clamped scaling, so a long
    history is folded per (fact, ``chunk``) first and then over the chunks.
    """
    step = (
        F.when(F.col("rating") >= 4, F.struct(F.lit(1.2).alias("a"), F.lit(-INF).alias("lo"), F.lit(1.0).alias("hi")))
        .when(F.col("rating") <= 2, F.struct(F.lit(0.7).alias("a"), F.lit(0.05).alias("lo"), F.lit(INF).alias("hi")))
        .otherwise(_identity())
    )
    order = F.struct("at", "rating_id")
    parts = (
        ratings.withColumn("_chunk", chunk)
        .groupBy("fact_id", "_chunk")
        .agg(
            F.sort_array(F.collect_list(F.struct(order.alias("o"), step.alias("s")))).alias("_steps"),
            F.max_by("rating", order).alias("_rating"),
            F.max("at").alias("_at"),
            F.sum((F.col("rating") >= 4).cast("bigint")).alias("_up"),
            F.max(F.when(F.col("rating") >= 4, F.col("at"))).alias("_up_at"),
            F.max(F.col("rating") <= 2).alias("_low"),
        )
        .withColumn("_f", F.aggregate("_steps", _identity(), lambda acc, x: _then(acc, x["s"])))
    )
    whole = (
        parts.groupBy("fact_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("_chunk", "_f"))).alias("_fs"),
            F.max_by("_rating", "_at").alias("user_rating"),
            F.sum("_up").alias("_up"),
            F.max("_up_at").alias("_up_at"),
            F.max("_low").alias("needs_review"),
        )
        .withColumn("_all", F.aggregate("_fs", _identity(), lambda acc, x: _then(acc, x["_f"])))
    )
    scaled = F.least(F.col("_all.hi"), F.greatest(F.col("_all.lo"), F.col("_all.a") * F.col("importance")))
    lifted = F.col("superseded_by").isNull() & (F.col("_up") > 0)
    return (
        facts.join(whole, "fact_id", "left")
        .withColumn("importance", F.coalesce(scaled, "importance"))
        .withColumn("source_count", F.col("source_count") + F.when(lifted, F.col("_up")).otherwise(0))
        .withColumn("last_confirmed_ts", F.when(lifted, F.col("_up_at")).otherwise(F.col("last_confirmed_ts")))
        .withColumn("needs_review", F.coalesce("needs_review", F.lit(False)))
        .drop("_fs", "_all", "_up", "_up_at")
    )


def pin(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Pinned facts get importance 1 and are never pruned."""
    marks = ids.select("fact_id").distinct().withColumn("_p", F.lit(True))
    return (
        facts.join(marks, "fact_id", "left")
        .withColumn("pinned", F.coalesce("_p", F.lit(False)))
        .withColumn("importance", F.when(F.col("_p"), 1.0).otherwise(F.col("importance")))
        .drop("_p")
    )


def lifecycle_stats(facts: DataFrame, as_of: Column) -> DataFrame:
    """Totals, confidence bands and reasons, and counts and means per category, in one pass.

    ``facts`` may hold ``superseded_reason``; a missing reason is told from ``superseded_by``.
    """
    by = F.col("superseded_by").cast("string")
    given = F.col("superseded_reason") if "superseded_reason" in facts.columns else F.lit(None).cast("string")
    reason = F.when(by.isNotNull(), F.coalesce(given, F.when(by == "pruned", "pruned").otherwise("merged")))
    c = decay.effective_confidence(as_of)
    band = F.when(c >= 0.7, "high").when(c >= 0.4, "medium").when(c >= 0.1, "low").otherwise("expired")
    status = F.when(by.isNull(), "active").otherwise("superseded")
    rows = facts.select(
        status.alias("status"),
        F.when(by.isNull(), band).alias("band"),
        reason.alias("reason"),
        F.when(by.isNull(), F.coalesce("category", F.lit("general"))).alias("category"),
        c.alias("confidence"),
    )
    sets = [[], ["status"], ["band"], ["reason"], ["category"]]
    keys = ["status", "band", "reason", "category"]
    grouped = rows.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence")
    )
    kind = (
        F.when(F.col("g") == 15, "total").when(F.col("g") == 7, "status").when(F.col("g") == 11, "band")
        .when(F.col("g") == 13, "reason").otherwise("category")
    )
    value = F.coalesce(*keys)
    return (
        grouped.select(
            kind.alias("kind"),
            F.when(F.col("g") == 15, "all").otherwise(value).alias("value"),
            "n",
            F.when(F.col("g") == 14, F.col("mean_confidence")).alias("mean_confidence"),
        ).filter(F.col("value").isNotNull())
    )


def _dated(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    if "ts_a" in pairs.columns:
        return pairs
    ts = lambda side: facts.select(F.col("fact_id").alias(side), F.col("ts").alias(f"ts_{side}"))
    return pairs.join(ts("a"), "a").join(ts("b"), "b")


def affinity_value(per_day: float = 0.03):
    """The affinity of ``merge_candidates`` over arrays, times in microseconds."""
    return lambda cosine, a, b: cosine * np.exp(-per_day * np.abs(a - b) / 86_400_000_000)


def age_value(as_of_micros: int):
    """The combined score of ``merge_candidates_by_age`` over arrays, times in microseconds."""

    def value(cosine, a, b):
        a, b = (as_of_micros - a) / 1_000_000.0, (as_of_micros - b) / 1_000_000.0
        return cosine * (0.5 + np.minimum(a, b) / np.maximum(np.maximum(a, b), 1.0) * 0.5)

    return value


def merge_candidates(pairs: DataFrame, facts: DataFrame, threshold: float = 0.85, per_day: float = 0.03) -> DataFrame:
    """Pairs (a, b, cosine) whose affinity ``cosine * exp(-per_day * days apart)`` reaches the threshold.

    Pairs may bring their times (``similarity.dated_pairs``); else these are looked up in ``facts``.
    """
    dated = _dated(pairs, facts)
    apart = F.abs(days_between(F.col("ts_a"), F.col("ts_b")))
    return dated.withColumn("affinity", F.col("cosine") * F.exp(-per_day * apart)).filter(F.col("affinity") >= threshold).select(
        "a", "b", "cosine", "affinity"
    )


def merge_candidates_by_age(pairs: DataFrame, facts: DataFrame, as_of: Column, threshold: float = 0.95, similarity: str = "cosine") -> DataFrame:
    """Variant: similarity times ``0.5 + 0.5 * younger age / older age``, ages in seconds."""
    age = lambda side: (F.unix_micros(as_of) - F.unix_micros(f"ts_{side}")) / 1_000_000.0
    both = _dated(pairs, facts).withColumn("age_a", age("a")).withColumn("age_b", age("b"))
    older = F.greatest("age_a", "age_b", F.lit(1.0))
    factor = 0.5 + F.least("age_a", "age_b") / older * 0.5
    return both.withColumn("combined", F.col(similarity) * factor).filter(F.col("combined") >= threshold).select("a", "b", similarity, "combined")


# A component of at most so many pairs is decided in one task.
COMPONENT_PAIRS = 200_000


def _decided(batches):
    """(id, keeper_id) of all nodes of whole components; rows are (component, id, turn, o_id, o_turn), better neighbours only.

    Nodes have their turns within their component. In that order a node without a keeper
    among its better neighbours keeps itself, any other goes to the first keeper of them.
    """

    def solve(rows: pa.Table) -> pa.RecordBatch:
        columns = {c: rows.column(c).to_numpy() for c in ("component", "id", "turn", "o_id", "o_turn")}
        order = np.lexsort((columns["o_turn"], columns["turn"], columns["component"]))
        keeper: dict[int, int] = {}
        for i, o in zip(columns["id"][order].tolist(), columns["o_id"][order].tolist()):
            # A node that had its turn has a keeper; one without better neighbours never had one and keeps itself.
            if keeper.setdefault(o, o) == o and keeper.get(i, i) == i and i != o:
                keeper[i] = o
            else:
                keeper.setdefault(i, i)
        return pa.RecordBatch.from_arrays([pa.array(list(keeper), pa.int64()), pa.array(list(keeper.values()), pa.int64())], names=["id", "keeper_id"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < COMPONENT_PAIRS:
            continue
        rows = pa.Table.from_batches(held)
        # The last component may go on in the next batch.
        names = rows.column("component").to_numpy()
        whole = int(np.searchsorted(names, names[-1]))
        if whole:
            yield solve(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
    if held:
        yield solve(pa.Table.from_batches(held))


def choose_keepers(nodes: DataFrame, pairs: DataFrame, priority: list[str]) -> DataFrame:
    """(id, keeper_id): the result of one pass in priority order over the pair graph.

    A node without a keeper among its better neighbours keeps itself; a loser goes to its
    best adjacent keeper. ``nodes`` holds ``id`` and the priority columns, all
    larger-is-better; equal priorities are decided by the smaller id.

    Components of at most ``COMPONENT_PAIRS`` pairs are decided in order in one task
    each, however long their chains. In a larger one, every undecided node without an
    undecided better neighbour becomes a keeper and its undecided neighbours losers;
    what is left falls into components anew.
    """
    rank = lambda p: F.struct(*[F.col(c) for c in priority], (-F.col("id")).alias("neg_id")).alias(p)
    once = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("a <> b").distinct()
    end = lambda name: nodes.select(F.col("id").alias(name), rank(f"{name}_rank"))
    ranked = once.join(end("x"), "x").join(end("y"), "y")
    # Every edge leads from a node to its better neighbour.
    turned = lambda lose, win: F.when(F.col("y_rank") > F.col("x_rank"), F.col(lose)).otherwise(F.col(win))
    edges = cut(ranked.select(turned("x", "y").alias("id"), turned("y", "x").alias("o_id"), turned("x_rank", "y_rank").alias("rank"), turned("y_rank", "x_rank").alias("o_rank")))
    chosen, open_edges = [], edges
    while True:
        found = components(open_edges.select(F.col("id").alias("a"), F.col("o_id").alias("b")))
        placed = cut(open_edges.join(found, "id"))
        sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        large = cut(sizes.where(F.col("n") > COMPONENT_PAIRS).select("component"))
        chosen.append(_in_turn(placed.join(large, "component", "left_anti")))
        if large.isEmpty():
            break
        # One round over what is too large: the best of every neighbourhood.
        inside = placed.join(large, "component", "left_semi")
        ids = inside.select(F.explode(F.array("id", "o_id")).alias("id")).distinct()
        new = cut(ids.join(inside.select("id").distinct(), "id", "left_anti"))
        losers = cut(inside.join(new.withColumnRenamed("id", "o_id"), "o_id", "left_semi").select("id").distinct())
        chosen.append(losers.select("id", F.lit(None).cast("bigint").alias("keeper_id")))
        gone = new.unionByName(losers)
        open_edges = cut(inside.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "o_id"), "o_id", "left_anti").drop("component"))
    to_keeper = reduce(DataFrame.unionByName, chosen)
    if len(chosen) > 1:
        # Keepers of a later round, and those that lost all neighbours, may be better ones of an earlier loser.
        every = edges.select(F.explode(F.array("id", "o_id")).alias("id")).distinct()
        keepers = cut(every.join(to_keeper.where("keeper_id is null or id <> keeper_id"), "id", "left_anti"))
        better = edges.join(keepers, "id", "left_anti").join(keepers.withColumnRenamed("id", "o_id"), "o_id", "left_semi")
        to_keeper = better.groupBy("id").agg(F.max_by("o_id", "o_rank").alias("keeper_id"))
    return nodes.select("id").join(to_keeper, "id", "left").select("id", F.coalesce("keeper_id", "id").alias("keeper_id"))


def choose_keepers_by_vector(rows: DataFrame, priority: list[str], pairs_of: Callable[[DataFrame], DataFrame], also: list[str] | None = None) -> DataFrame:
    """``choose_keepers`` of ``rows`` (id, vec, priority, ``also``) that pair by vectors: (id, keeper_id), a row each.

    Rows of equal vector and ``also`` must pair with one another and with the same others. Then only the best of them
    can be a keeper and all go where it goes, so one stands for all: ``pairs_of`` gets the (id, vec, ``also``) that do.
    Rows without a vector, or of no length, pair with nothing and keep themselves.
    """
    also = also or []
    length = F.aggregate("vec", F.lit(0.0), lambda n, v: n + v.cast("double") * v.cast("double"))
    linked = rows.where((length > 0) & ~F.isnan(length) & F.col("id").isNotNull()).dropna(subset=also)
    best = F.max(F.struct(*priority, (-F.col("id")).alias("neg_id"))).alias("_best")
    groups = linked.groupBy("vec", *also).agg(best)
    groups = cut(groups.select("vec", *[c for c in also if c not in priority], *[F.col(f"_best.{c}").alias(c) for c in priority], (-F.col("_best.neg_id")).alias("id")))
    chosen = choose_keepers(groups.select("id", *priority), pairs_of(groups.select("id", "vec", *also)), priority)
    members = linked.select("id", "vec", *also).join(groups.select("vec", *also, F.col("id").alias("rep")), ["vec", *also])
    keepers = members.join(chosen.withColumnRenamed("id", "rep"), "rep").select("id", "keeper_id").dropDuplicates(["id"])
    return rows.select("id").join(keepers, "id", "left").select("id", F.coalesce("keeper_id", "id").alias("keeper_id"))


def _in_turn(edges: DataFrame) -> DataFrame:
    """(id, keeper_id) of the nodes of small components; ``edges`` lead from nodes to better ones."""
    ranked = edges.select("component", "id", "rank").unionByName(edges.select("component", F.col("o_id").alias("id"), F.col("o_rank").alias("rank"))).distinct()
    turns = ranked.select("component", "id", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("rank"))).alias("turn"))
    own = edges.select("component", "id", "o_id").join(turns.drop("component"), "id")
    both = own.join(turns.select(F.col("id").alias("o_id"), F.col("turn").alias("o_turn")), "o_id")
    rows = both.select("component", "id", "turn", "o_id", "o_turn").repartition("component").sortWithinPartitions("component")
    return cut(rows.mapInArrow(_decided, "id bigint, keeper_id bigint"))


# Caps of the lists of a merged row.
LIST_CAPS = {"keywords": 10, "persons": 5, "entities": 5}


def merged_rows(facts: DataFrame, keepers: DataFrame, as_of: Column) -> DataFrame:
    """One row per keeper that took in others: longest content and its vector, maxima, sums, united lists, the next version.

    Every value is combined before the shuffle; distinct list members are counted
    per keeper first and cut to the cap, so a keeper of very many rows stays small.
    """
    joined = facts.join(keepers.withColumnRenamed("id", "fact_id"), "fact_id")
    longest = F.struct(F.length("content"), -F.col("fact_id"))
    version = F.max(F.coalesce("version", F.lit(1))) if "version" in facts.columns else F.lit(1)
    main = joined.groupBy("keeper_id").agg(
        F.count(F.lit(1)).alias("consolidated_from"),
        # The content and what belongs to it come from one row.
        F.max_by("content", longest).alias("content"),
        *([F.max_by("embedding", longest).alias("embedding")] if "embedding" in facts.columns else []),
        F.max("access_count").alias("access_count"),
        F.max("importance").alias("importance"),
        F.sum("source_count").alias("source_count"),
        (version + 1).cast("bigint").alias("version"),
    )
    out = main.filter("consolidated_from > 1").withColumn("last_confirmed_ts", as_of)
    for name, cap in LIST_CAPS.items():
        if name in facts.columns:
            members = joined.select("keeper_id", F.explode(name).alias("_m")).distinct()
            top = top_per_group(members, ["keeper_id"], [F.asc("_m")], cap, "_r")
            lists = top.groupBy("keeper_id").agg(F.sort_array(F.collect_list("_m")).alias(name))
            out = out.join(lists, "keeper_id", "left")
    return out
