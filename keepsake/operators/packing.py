"""Lines of recalled memory packed into a token budget, one text per query.

A query has a few dozen lines at most (the limits of the recall plan), so they
meet in one array and a fold walks over it; queries spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import text as tx

# --- fixed values: section order, headings and wrapper ---
SECTIONS = ["persona", "summary", "digests", "environment", "tools", "skills", "session", "facts", "episodes"]
HEADINGS = {
    "summary": "## Last Session Summary",
    "digests": "## Lessons Learned",
    "skills": "## Relevant Skills",
    "session": "## Current Session Context",
    "facts": "## Long-Term Memory (Facts)",
    "episodes": "## Recent Relevant Episodes",
}
WRAP_HEAD = (
    "<cross_session_memory>\nThe following is relevant context from long-term memory.\n"
    "Use it to inform your responses but do not repeat it verbatim.\n\n"
)
WRAP_TAIL = "\n</cross_session_memory>"
DEFAULT_BUDGET = 1500
# --- end of fixed values ---

HEAD, ITEM, END = "head", "item", "end"
LAST_LINE = 1_000_000


def section(rows: DataFrame, name: str, line_no: str | int, text: Column) -> DataFrame:
    """Lines of one section from rows of queries: heading (if the section has one), items, end mark."""
    number = SECTIONS.index(name)
    order = F.col(line_no) if isinstance(line_no, str) else F.lit(line_no)
    kind = ITEM if name in HEADINGS else HEAD  # a section without heading is a block that must fit itself
    make = lambda df, no, k, t: df.select(
        "query_id", F.lit(number).alias("section"), no.cast("int").alias("line_no"), F.lit(k).alias("kind"), t.alias("text")
    )
    items = make(rows.filter(text.isNotNull() & (text != "")), order, kind, text)
    has = items.select("query_id").distinct()
    parts = [items, make(has, F.lit(LAST_LINE), END, F.lit(""))]
    if name in HEADINGS:
        parts.append(make(has, F.lit(-1), HEAD, F.lit(HEADINGS[name])))
    return reduce(DataFrame.unionByName, parts)


def pack(lines: DataFrame, budgets: DataFrame, wrap: bool = True) -> DataFrame:
    """(query_id, context, tokens, items).

    ``lines``: (query_id, section, line_no, kind, text); ``budgets``: (query_id,
    token_budget). A line is taken if it fits; the first item that does not fit
    ends its section; a heading that does not fit drops its section.
    """
    safe = lines.withColumn("text", tx.redact(F.col("text"))).withColumn("cost", tx.word_count(F.col("text")))
    arrays = safe.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("section", "line_no", "kind", "text", "cost"))).alias("_l")
    )
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        zero.alias("used"), zero.alias("items"), F.lit(False).alias("begun"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("out")
    )

    def step(s, x):
        fits = s["used"] + x["cost"] <= F.col("_b")
        head, item = x["kind"] == HEAD, x["kind"] == ITEM
        take = (head & fits) | (item & s["open"] & fits)
        blank = (x["kind"] == END) & s["begun"]
        return F.struct(
            F.when(take, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"),
            F.when(take & item, s["items"] + 1).otherwise(s["items"]).alias("items"),
            F.when(head, fits).when(x["kind"] == END, False).otherwise(s["begun"]).alias("begun"),
            F.when(head, fits).when(item, s["open"] & fits).otherwise(False).alias("open"),
            F.when(take | blank, F.concat(s["out"], F.array(x["text"]))).otherwise(s["out"]).alias("out"),
        )

    budget = F.coalesce(F.col("token_budget"), F.lit(DEFAULT_BUDGET))
    done = budgets.select("query_id", budget.alias("_b")).join(arrays, "query_id", "left").withColumn(
        "_s", F.aggregate(F.coalesce("_l", F.array().cast("array<struct<section:int,line_no:int,kind:string,text:string,cost:bigint>>")), start, step)
    )
    body = tx.strip(F.array_join("_s.out", "\n"))
    text = F.when(body != "", F.concat(F.lit(WRAP_HEAD), body, F.lit(WRAP_TAIL)) if wrap else body).otherwise("")
    return done.select("query_id", text.alias("context"), F.col("_s.used").alias("tokens"), F.col("_s.items").alias("items"))


def fact_line(rank: Column, category: Column, content: Column, persons: Column, entities: Column, topic: Column, triple: Column) -> Column:
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ",")))
    plain = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    meta = F.concat_ws("; ", listed("who:", persons), listed("re:", entities), plain("topic:", topic), plain("triple:", triple))
    tag = F.when(F.coalesce(category, F.lit("")) != "", category).otherwise("?")
    return F.concat(rank, F.lit(". ["), tag, F.lit("]"), F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(""), F.lit(" "), content)


def episode_line(rank: Column, ep_type: Column, content: Column) -> Column:
    tag = F.when(F.coalesce(ep_type, F.lit("general")).isin("", "general"), "").otherwise(F.concat(F.lit("["), ep_type, F.lit("] ")))
    return F.concat(rank, F.lit(". "), tag, F.substring(content, 1, 300))


def skill_line(task: Column, procedure: Column) -> Column:
    shown = F.when(task.startswith("[skill:"), F.regexp_replace(task, r"(?s)^.*?\] ", "")).otherwise(task)
    hint = tx.strip(F.regexp_replace(F.substring(F.coalesce(procedure, F.lit("")), 1, 200), "\n", " "))
    return F.concat(F.lit("- **"), shown, F.lit("**"), F.when(hint != "", F.concat(F.lit(": "), hint)).otherwise(""))


def tool_line(name: Column, category: Column, source: Column, description: Column, summary: Column) -> Column:
    tag = F.when(F.coalesce(source, F.lit("")).isin("", "builtin"), category).otherwise(F.concat_ws("/", category, source))
    more = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit(" ⟨"), summary, F.lit("⟩"))).otherwise("")
    return F.concat(F.lit("- **"), name, F.lit("** ["), tag, F.lit("]: "), F.substring(description, 1, 120), more)


def digest_line(fact_count: Column, summary: Column) -> Column:
    return F.concat(F.lit("- **Completed Session** ("), fact_count, F.lit(" facts): "), summary)


def pack_by_quota(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Variant: session up to 30 %, persona up to 20 %, facts until one does not fit, graph text if it fits.

    ``requests``: (query_id, budget, session_ctx, persona_ctx, graph_ctx);
    ``facts``: (query_id, rank, content). Returns tokens, facts and utilisation.
    """
    cost = lambda c: tx.word_count(F.coalesce(F.col(c), F.lit("")))
    s, p, g = cost("session_ctx"), cost("persona_ctx"), cost("graph_ctx")
    base = requests.withColumn("_s", F.when(s <= F.col("budget") * 0.3, s).otherwise(0))
    base = base.withColumn("_p", F.when(F.col("_s") + p <= F.col("budget") * 0.2, p).otherwise(0)).withColumn("_g", g)
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    costs = facts.withColumn("_sum", F.sum(tx.word_count(F.col("content"))).over(run))
    fit = costs.join(base.select("query_id", (F.col("budget") - F.col("_s") - F.col("_p")).alias("_left")), "query_id").filter("_sum <= _left")
    taken = fit.groupBy("query_id").agg(F.count(F.lit(1)).alias("fact_count"), F.max("_sum").alias("_f"))
    out = base.join(taken, "query_id", "left")
    used = F.col("_s") + F.col("_p") + F.coalesce("_f", F.lit(0))
    total = used + F.when(used + F.col("_g") <= F.col("budget"), F.col("_g")).otherwise(0)
    return out.select(
        "query_id", F.coalesce("fact_count", F.lit(0)).alias("fact_count"), total.alias("total_tokens"),
        F.round(total / F.col("budget"), 4).alias("utilization"),
    )
