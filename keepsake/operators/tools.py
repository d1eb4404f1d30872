"""Tools, their transitions and outcomes, procedures, and environment state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import scene
from keepsake.functions import text as tx
from keepsake.operators.ordering import top_per_group, with_previous

# --- fixed values ---
ENV_ORDER = [
    "os", "os_version", "shell", "cwd", "git_repo", "git_branch", "active_mcps", "active_plugins", "active_skills",
    "agent_model", "agent_version", "session_id",
]
HINT_SHARE = 0.15
CHAIN_THRESHOLD = 5
MIN_OUTCOMES = 5
# --- end of fixed values ---


def register(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by key. New descriptions win; counters and summary of a known tool stay.

    ``new``: (name, description, category, source); ``stored`` adds tool_key,
    use_count, success_count, fail_count and capability_summary.
    """
    latest = new.withColumn("tool_key", tx.tool_key(F.col("name"))).groupBy("tool_key").agg(
        F.max_by(F.struct("name", "description", "category", "source"), F.struct("name", "description")).alias("n")
    )
    category = F.when(F.coalesce("n.category", F.lit("")) != "", F.col("n.category")).otherwise(
        scene.tool_category(F.col("n.name"), F.col("n.description"))
    )
    take = lambda c, fresh: F.when(F.col("n").isNotNull(), fresh).otherwise(F.col(c)).alias(c)
    kept = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return stored.join(latest, "tool_key", "full_outer").select(
        "tool_key",
        take("name", F.col("n.name")),
        take("description", F.substring("n.description", 1, 400)),
        take("category", category),
        take("source", F.coalesce("n.source", F.lit("builtin"))),
        kept("use_count"), kept("success_count"), kept("fail_count"),
        "capability_summary",
    )


def transitions(calls: DataFrame, chunk: Column, order: list[str] | None = None) -> DataFrame:
    """Counts of neighbouring tool pairs per session order: (src, dst, n). Repeats of a tool are skipped.

    ``calls``: (session_id, ts, event_id, tool). Counted on the map side.
    """
    named = calls.withColumn("tool", F.substring(F.translate(F.lower(F.trim("tool")), " ", "_"), 1, 64)).filter("tool <> ''")
    seen = with_previous(named, ["session_id"], order or ["ts", "event_id"], chunk, ["tool"])
    return (
        seen.filter(F.col("previous.tool") != F.col("tool"))
        .groupBy(F.col("previous.tool").alias("src"), F.col("tool").alias("dst"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def next_tools(graph: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent next tools with their share of the outgoing count."""
    total = F.sum("n").over(Window.partitionBy("src"))
    ranked = top_per_group(graph.withColumn("total", total), ["src"], [F.desc("n"), F.asc("dst")], k)
    return ranked.withColumn("share", F.round(F.col("n") / F.col("total"), 2))


def next_tool_hints(graph: DataFrame) -> DataFrame:
    """One text per tool: up to three next tools of at least 15 % share."""
    rows = next_tools(graph, 3).filter(F.col("n") / F.col("total") >= HINT_SHARE)
    text = F.concat("dst", F.lit(" ("), F.round(F.col("n") / F.col("total") * 100).cast("int"), F.lit("%)"))
    return rows.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))).alias("_h")).select(
        "src", F.array_join("_h.t", ", ").alias("hint")
    )


def chains(graph: DataFrame, threshold: int = CHAIN_THRESHOLD) -> DataFrame:
    """Two-hop chains of frequent transitions: (a, b, c, ab, bc, strength)."""
    often = graph.filter(F.col("n") >= threshold)
    first = often.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("n").alias("ab"))
    second = often.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("n").alias("bc"))
    return first.join(second, "b").filter("a <> c").withColumn("strength", F.least("ab", "bc")).select("a", "b", "c", "ab", "bc", "strength")


def chain_procedures(found: DataFrame, limit: int = 20) -> DataFrame:
    """The strongest chains as procedures."""
    best = found.orderBy(F.desc("strength"), "a", "b", "c").limit(limit)
    arrow = F.concat_ws(" → ", "a", "b", "c")
    ab = F.concat("a", F.lit("→"), "b", F.lit("="), "ab")
    bc = F.concat("b", F.lit("→"), "c", F.lit("="), "bc")
    body = F.concat(
        F.lit("High-frequency tool chain discovered by AWO analysis (TIG count: "), ab, F.lit(", "), bc, F.lit(").\n1. Use "), "a",
        F.lit("\n2. Use "), "b", F.lit("\n3. Use "), "c",
    )
    return best.select(
        F.concat(F.lit("[meta-tool] "), arrow, F.lit(" workflow")).alias("task"), body.alias("procedure"),
        F.array("a", "b", "c").alias("tools_used"), F.lit("meta").alias("domain"), "strength",
    )


def reliability(success: Column, fail: Column) -> Column:
    total = success + fail
    rate = success / total
    label = F.when(rate >= 0.85, "reliable").when(rate >= 0.60, "mostly reliable").when(rate >= 0.40, "mixed").otherwise("often fails")
    return F.when(total >= MIN_OUTCOMES, F.concat(label, F.lit(" ("), success, F.lit("/"), total, F.lit("✓)")))


def tool_outcomes(calls: DataFrame) -> DataFrame:
    """Counters and label per tool; works on a stream in update mode as well."""
    counts = calls.groupBy(tx.tool_key(F.col("tool")).alias("tool_key")).agg(
        F.count(F.lit(1)).alias("use_count"),
        F.count(F.when(F.col("success"), 1)).alias("success_count"),
        F.count(F.when(~F.col("success"), 1)).alias("fail_count"),
    )
    return counts.withColumn("capability_summary", reliability(F.col("success_count"), F.col("fail_count")))


def manifest(tools: DataFrame) -> DataFrame:
    """Tools and uses per category."""
    return tools.groupBy("category").agg(F.count(F.lit(1)).alias("tools"), F.sum("use_count").alias("uses"), F.min("name").alias("first_name"))


def names_by_category(tools: DataFrame, per_row: int = 1000) -> DataFrame:
    """Tool names per category, in rows of at most ``per_row`` names."""
    w = Window.partitionBy("category", "_slice").orderBy("name")
    sliced = tools.withColumn("_slice", F.pmod(F.xxhash64("name"), F.lit(64)))
    rows = sliced.withColumn("part", F.floor((F.row_number().over(w) - 1) / per_row))
    return rows.groupBy("category", "_slice", "part").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names")).drop("_slice", "part")


def latest_state(writes: DataFrame) -> DataFrame:
    """Last write per agent and field, from (agent, field, value, ts, write_id)."""
    return writes.groupBy("agent", "field").agg(F.max_by("value", F.struct("ts", "write_id")).alias("value"))


def state_text(state: DataFrame) -> DataFrame:
    """Environment lines per agent: known fields in fixed order, then the others. One value per field."""
    place = F.array_position(F.array(*[F.lit(f) for f in ENV_ORDER]), F.col("field"))
    order = F.when(place == 0, len(ENV_ORDER) + 1).otherwise(place)
    line = F.concat(F.lit("- "), "field", F.lit(": "), "value")
    rows = state.filter("field <> 'last_updated' AND value <> ''")
    return rows.groupBy("agent").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "field", line.alias("l")))).alias("_l")).select(
        "agent", F.concat(F.lit("## Agent Environment\n"), F.array_join("_l.l", "\n")).alias("text")
    )


def procedures_by_tool(procedures: DataFrame) -> DataFrame:
    """Reverse index (tool, proc_id)."""
    return procedures.select(F.explode("tools_used").alias("tool"), "proc_id").select(F.lower("tool").alias("tool"), "proc_id").filter("tool <> ''").distinct()


def store_procedures(stored: DataFrame, new: DataFrame, near: DataFrame, skip: float = 0.90) -> DataFrame:
    """New procedures: one near a stored one adds to its success count, others are inserted.

    ``near``: (new_id, proc_id, score), the nearest stored procedure of each new one.
    """
    hit = near.filter(F.col("score") > skip)
    more = hit.groupBy("proc_id").agg(F.count(F.lit(1)).alias("_more"))
    known = stored.join(more, "proc_id", "left").withColumn("success_count", F.col("success_count") + F.coalesce("_more", F.lit(0))).drop("_more")
    fresh = new.join(hit.select("new_id"), "new_id", "left_anti").withColumn("success_count", F.lit(1).cast("bigint")).withColumn("fail_count", F.lit(0).cast("bigint"))
    return known.unionByName(fresh.withColumn("proc_id", F.col("new_id")).drop("new_id"), allowMissingColumns=True)


def procedure_feedback(stored: DataFrame, near: DataFrame, min_score: float = 0.50) -> DataFrame:
    """Outcomes (proc_id, score, success) of the nearest procedure added to its counts."""
    counts = near.filter(F.col("score") >= min_score).groupBy("proc_id").agg(
        F.count(F.when(F.col("success"), 1)).alias("_s"), F.count(F.when(~F.col("success"), 1)).alias("_f")
    )
    return (
        stored.join(counts, "proc_id", "left")
        .withColumn("success_count", F.col("success_count") + F.coalesce("_s", F.lit(0)))
        .withColumn("fail_count", F.col("fail_count") + F.coalesce("_f", F.lit(0)))
        .drop("_s", "_f")
    )
