"""Retrieval measures over tables of (pair_id, context, answer), and service statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.session import broadcast_if_small, cut

# --- fixed values ---
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~。，！？；：“”‘’（）【】、…—～·《》〈〉「」『』]"""
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}"
ARTICLES = ["a", "an", "the"]
WINDOW = 10
# --- end of fixed values ---


def tokens(text: Column) -> Column:
    """Lower-cased tokens without marks and articles; each CJK letter is one."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    found = tx.all_matches(bare, rf"[{CJK}]|[^{CJK}\s]+")
    return F.filter(found, lambda t: ~t.isin(ARTICLES))


def unwrap(context: Column) -> Column:
    """Recalled text without its wrapper: from the first section heading on, tags removed."""
    start = F.regexp_instr(context, F.lit(r"##\s+\w"))
    body = F.when(start > 0, F.substr(context, start)).otherwise(
        F.regexp_replace(context, r"(?s)The following is relevant context.*?verbatim\.\s*", "")
    )
    return tx.strip(F.regexp_replace(body, "</?cross_session_memory>", ""))


def f1(shared: Column, n_pred: Column, n_gold: Column) -> Column:
    p, r = shared / n_pred, shared / n_gold
    return F.when(shared > 0, 2 * p * r / (p + r)).otherwise(0.0)


def token_f1(pairs: DataFrame, pred: str = "context", gold: str = "answer") -> DataFrame:
    """(pair_id, f1) by multiset overlap. Token counts meet per (pair, token), so long texts spread over tasks."""
    side = lambda c, n: pairs.select("pair_id", F.explode(tokens(F.col(c))).alias("t"), F.lit(n).alias("s"))
    counts = side(pred, 0).unionByName(side(gold, 1)).groupBy("pair_id", "t").agg(
        F.count(F.when(F.col("s") == 0, 1)).alias("p"), F.count(F.when(F.col("s") == 1, 1)).alias("g")
    )
    sums = counts.groupBy("pair_id").agg(F.sum(F.least("p", "g")).alias("shared"), F.sum("p").alias("np"), F.sum("g").alias("ng"))
    score = f1(F.col("shared"), F.col("np"), F.col("ng"))
    return pairs.select("pair_id").join(sums, "pair_id", "left").select("pair_id", F.coalesce(score, F.lit(0.0)).alias("f1"))


def windowed_f1(pairs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(pair_id, f1): the best of any ``window`` tokens of the unwrapped context, or of the whole.

    Only tokens that occur in the answer are placed into windows.
    """
    bare = pairs.withColumn("context", unwrap(F.coalesce("context", F.lit(""))))
    toks = bare.select("pair_id", tokens(F.col("context")).alias("ct"), tokens(F.col("answer")).alias("gt"))
    sizes = toks.select("pair_id", F.size("ct").alias("nc"), F.size("gt").alias("ng"))
    gold = toks.select("pair_id", F.explode("gt").alias("t")).groupBy("pair_id", "t").agg(F.count(F.lit(1)).alias("g"))
    hits = toks.select("pair_id", F.posexplode("ct").alias("at", "t")).join(gold, ["pair_id", "t"])
    placed = hits.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - window + 1), F.col("at"))))
    per_token = placed.groupBy("pair_id", "start", "t", "g").agg(F.count(F.lit(1)).alias("c"))
    per_window = per_token.groupBy("pair_id", "start").agg(F.sum(F.least("c", "g")).alias("shared")).join(sizes, "pair_id")
    length = F.least(F.lit(window), F.col("nc") - F.col("start"))
    best = per_window.groupBy("pair_id").agg(F.max(f1(F.col("shared"), length, F.col("ng"))).alias("w"))
    whole = token_f1(bare)
    return whole.join(best, "pair_id", "left").select("pair_id", F.greatest("f1", F.coalesce("w", F.lit(0.0))).alias("f1"))


def answer_in_context(context: Column, answer: Column) -> Column:
    gold = F.array_join(tokens(answer), " ")
    return (gold != "") & F.array_join(tokens(context), " ").contains(gold)


def system_table(scores: DataFrame) -> DataFrame:
    """Means per system of (system, f1, found, tokens)."""
    return scores.groupBy("system").agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg("f1"), 4).alias("mean_f1"),
        F.round(F.avg(F.col("found").cast("double")), 4).alias("answer_rate"),
        F.round(F.avg((F.col("f1") > 0).cast("double")), 4).alias("recall_at_1"),
        F.round(F.avg("tokens"), 4).alias("mean_tokens"),
    )


def rank_metrics(hits: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Recall, precision, NDCG at ``k`` and reciprocal rank per query, from (query_id, id, rank) and (query_id, id)."""
    size = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    good = hits.filter(F.col("rank") <= k).join(truth, ["query_id", "id"])
    sums = good.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return size.join(sums, "query_id", "left").select(
        "query_id",
        F.round(zero(F.col("found") / F.col("relevant")), 4).alias("recall"),
        F.round(zero(F.col("found") / F.lit(k)), 4).alias("precision"),
        F.round(zero(F.col("dcg") / ideal), 4).alias("ndcg"),
        F.round(zero(1 / F.col("first")), 4).alias("reciprocal_rank"),
    )


def full_context(messages: DataFrame, part_turns: int = 1024) -> DataFrame:
    """All turns of a session as text, in parts of bounded size: (session_id, part, text, tokens)."""
    line = F.concat_ws(": ", "role", "content")
    rows = messages.withColumn("part", F.floor(F.col("seq") / part_turns))
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("seq", line.alias("l"))))["l"], " ")
    return rows.groupBy("session_id", "part").agg(joined.alias("text")).withColumn("tokens", F.size(tokens(F.col("text"))))


# Groups of at most so many values are their own bracket.
WHOLE_GROUP = 10_000
# Ranks to both sides of a percentile that a bracket takes in, as a share; the sketch errs by far less.
BRACKET = 0.02


def percentiles(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group, n and ``p0``, ``p1``, .. : exact percentiles, between ranks by proportion.

    A mergeable sketch per group (KLL) gives a bracket around each percentile. One more
    pass counts what lies below the bracket, and the distinct values inside; both are
    combined before the shuffle, and no group's values meet in one buffer.
    """
    own = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    sketch = F.kll_sketch_agg_double("v", 2000)
    known = cut(own.groupBy("g").agg(F.count(F.lit(1)).alias("n"), sketch.alias("s"), F.min("v").alias("least"), F.max("v").alias("most")))
    at = lambda share: F.kll_sketch_get_quantile_double("s", F.lit(float(min(1.0, max(0.0, share)))))
    whole = F.col("n") <= WHOLE_GROUP
    bracket = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.when(whole, F.col("least")).otherwise(at(p - BRACKET)).alias("lo"), F.when(whole, F.col("most")).otherwise(at(p + BRACKET)).alias("hi"))
            for i, p in enumerate(shares)
        ]
    )
    brackets = known.select("g", "n", F.explode(bracket).alias("b")).select("g", "n", "b.*")
    met = own.join(broadcast_if_small(brackets.withColumnRenamed("g", "bg")), F.col("g").eqNullSafe(F.col("bg"))).where("v <= hi")
    # What lies below the bracket counts as one value, before all of it.
    place = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    counts = met.groupBy("g", "n", "i", "p", place.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("g", "i").orderBy(F.col("v").asc_nulls_first())
    placed = counts.withColumn("upto", F.sum("c").over(order))
    rank = F.col("p") * (F.col("n") - 1)
    from_rank = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    low, high = from_rank(F.floor(rank)), from_rank(F.ceil(rank))
    found = placed.groupBy("g", "n", "i").agg((low + (high - low) * F.max(rank - F.floor(rank))).alias("x"))
    wide = found.groupBy("g", "n").agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"p{i}") for i in range(len(shares))])
    return wide.withColumnRenamed("g", group)


def latency(log: DataFrame, group: str, value: str) -> DataFrame:
    return percentiles(log, group, value, [0.5, 0.95]).withColumnsRenamed({"p0": "p50", "p1": "p95"})


def writer_stats(log: DataFrame) -> DataFrame:
    """From an ingest log (outcome, ms): counts, success rate of completed writes, mean time."""
    of = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    done = of("success") + of("error")
    return log.agg(
        F.count(F.lit(1)).alias("attempts"), of("success").alias("successes"), of("skip").alias("skips"), of("error").alias("errors"),
        F.round(of("success") / done, 3).alias("success_rate"), F.round(F.sum("ms") / F.count(F.lit(1))).alias("avg_ms"),
    )


def tier_counts(tiers: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tiers.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tier"), "n")
        out = row if out is None else out.unionByName(row)
    return out
