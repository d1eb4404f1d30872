"""Heat, rank fusion, boosts and diversity, each over all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.operators.ordering import top_per_group

RRF_K = 60


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def heat(ts: Column, access_count: Column, as_of: Column) -> Column:
    """Recency times access frequency, never under 0.01."""
    days = days_between(as_of, F.coalesce(ts, as_of))
    boost = 1 + F.log1p(F.coalesce(access_count, F.lit(0))) * 0.25
    return F.greatest(F.lit(0.01), F.exp(-days / 30) * boost)


def heat_rank(hits: DataFrame, as_of: Column, id_col: str = "fact_id", score: str = "score") -> DataFrame:
    """Adds ``heat_score`` and its rank per query."""
    warm = hits.withColumn(
        "heat_score", F.greatest(F.lit(0.0), F.col(score)) * heat(F.col("ts"), F.col("access_count"), as_of)
    )
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("heat_score", 12)), F.asc(id_col))
    return warm.withColumn("heat_rank", F.row_number().over(w))


def bump_access(facts: DataFrame, hits: DataFrame, id_col: str = "fact_id") -> DataFrame:
    """Apply hits (id, hit_ts): counts go up, last access and confirmation move to the latest hit."""
    use = hits.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.max("hit_ts").alias("_last"))
    return (
        facts.join(use, id_col, "left")
        .withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0)))
        .withColumn("last_accessed", F.col("_last"))
        .withColumn("last_confirmed_ts", F.coalesce("_last", "last_confirmed_ts"))
        .drop("_n", "_last")
    )


def fuse(lists: DataFrame, limit: int, key: str = "content", weight: str = "weight", id_col: str = "fact_id") -> DataFrame:
    """Weighted reciprocal rank fusion.

    ``lists`` holds (query_id, list_no, rank, key, id, weight). The row kept for
    a key is the one of the first list that holds it.
    """
    share = F.col(weight) / (RRF_K + F.col("rank"))
    fused = (
        lists.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
        .groupBy("query_id", key)
        .agg(
            F.sum(share).alias("rrf"),
            F.min_by(id_col, F.struct("list_no", "rank")).alias(id_col),
        )
    )
    return top_per_group(fused, ["query_id"], [F.desc(F.round("rrf", 12)), F.asc(id_col)], limit)


def fusion_weights(has_entities: Column, has_time: Column) -> Column:
    """Weights of the scene, global, symbolic and lexical lists."""
    # fixed values
    both = F.array(*[F.lit(v) for v in (0.8, 0.8, 1.4, 1.2)])
    entity = F.array(*[F.lit(v) for v in (0.9, 0.9, 1.2, 1.1)])
    time = F.array(*[F.lit(v) for v in (0.9, 0.9, 1.2, 0.8)])
    plain = F.array(*[F.lit(v) for v in (1.0, 1.0, 0.6, 0.9)])
    return F.when(has_entities & has_time, both).when(has_entities, entity).when(has_time, time).otherwise(plain)


def importance_boost(score: Column, importance: Column, weight: float = 0.15) -> Column:
    return score + weight * F.coalesce(importance, F.lit(0.5))


def diversify(hits: DataFrame, max_per_session: int, order: list[Column]) -> DataFrame:
    """At most so many rows per session and query, in rank order; rows without a session stay."""
    w = Window.partitionBy("query_id", "session_id").orderBy(*order)
    free = F.col("session_id").isNull() | (F.col("session_id").cast("string") == "")
    return hits.withColumn("_s", F.row_number().over(w)).filter(free | (F.col("_s") <= max_per_session)).drop("_s")


def beta_score(cosine: Column, success: Column, fail: Column) -> Column:
    """Cosine times the posterior mean of success once there are three outcomes."""
    total = success + fail
    return F.when(total >= 3, cosine * (success + 1) / (total + 2)).otherwise(cosine)


def append_extra(ranked: DataFrame, extra: DataFrame, slack: int) -> DataFrame:
    """Append hits whose content a query does not hold yet, then cut at its limit + ``slack``.

    ``ranked``: (query_id, fact_id, content, rank, n_limit); ``extra``: (query_id,
    fact_id, content, extra_rank). Extra rows rank after all present ones.
    """
    fresh = extra.join(ranked.select("query_id", "content"), ["query_id", "content"], "left_anti")
    first = top_per_group(fresh, ["query_id", "content"], [F.asc("extra_rank"), F.asc("fact_id")], 1, "_one")
    size = ranked.groupBy("query_id").agg(F.max("rank").alias("_last"), F.max("n_limit").alias("n_limit"))
    w = Window.partitionBy("query_id").orderBy("extra_rank", "fact_id")
    tail = (
        first.join(size, "query_id")
        .withColumn("rank", F.col("_last") + F.row_number().over(w))
        .select("query_id", "fact_id", "content", "rank", "n_limit")
    )
    return (
        ranked.select("query_id", "fact_id", "content", "rank", "n_limit")
        .unionByName(tail)
        .filter(F.col("rank") <= F.col("n_limit") + slack)
    )
