"""Export and import of memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import text as tx


def export(facts: DataFrame, episodes: DataFrame, path: str, fmt: str = "json") -> None:
    """All facts and episodes with all columns, one folder per kind."""
    for kind, df in (("facts", facts), ("episodes", episodes)):
        df.write.mode("errorifexists").format(fmt).save(f"{path}/kind={kind}")


def read_export(spark: SparkSession, path: str, kind: str, schema, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(f"{path}/kind={kind}")


def _default(df: DataFrame, name: str, value, kind: str):
    if name in df.columns:
        return F.coalesce(F.col(name), F.lit(value)).cast(kind)
    return F.lit(value).cast(kind)


def import_facts(rows: DataFrame) -> DataFrame:
    """Rows with content; missing columns and values get the import defaults."""
    keep = rows.filter(F.col("content").isNotNull() & (F.col("content") != ""))
    return (
        keep.withColumn("category", _default(keep, "category", "fact", "string"))
        .withColumn("confidence", _default(keep, "confidence", 0.7, "double"))
        .withColumn("importance", _default(keep, "importance", 0.5, "double"))
        .withColumn("language", _default(keep, "language", "en", "string"))
        .withColumn("domain", _default(keep, "domain", "general", "string"))
    )


def import_episodes(rows: DataFrame) -> DataFrame:
    keep = rows.filter(F.col("content").isNotNull() & (F.col("content") != ""))
    by_category = F.col("category") if "category" in rows.columns else F.lit(None).cast("string")
    kind = F.coalesce(F.col("ep_type") if "ep_type" in rows.columns else F.lit(None).cast("string"), by_category)
    return keep.withColumn("ep_type", F.coalesce(kind, F.lit("general"))).withColumn(
        "session_id", _default(keep, "session_id", "", "string")
    )


def remembered(rows: DataFrame) -> DataFrame:
    """Facts given in so many words: (content, type, concepts) -> fact columns."""
    words = F.filter(F.transform(F.split("concepts", ","), lambda w: tx.strip(w)), lambda w: w != "")
    return rows.select(
        *[c for c in rows.columns if c not in ("type", "concepts")],
        F.coalesce(F.when(F.col("type") != "", F.col("type")), F.lit("fact")).alias("category"),
        F.lit(0.8).alias("confidence"),
        F.lit(0.8).alias("importance"),
        words.alias("keywords"),
    )


def given_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (text, category, importance) rows into facts and rows that cannot be stored."""
    bad = F.col("text").isNull()
    facts = rows.filter(~bad).select(
        *[c for c in rows.columns if c not in ("text", "category", "importance")],
        F.col("text").alias("content"),
        F.coalesce("category", F.lit("general")).alias("category"),
        F.coalesce("importance", F.lit(0.5)).alias("confidence"),
    )
    return facts, rows.filter(bad).withColumn("error", F.lit("missing text"))


def tier_facts(rows: DataFrame) -> DataFrame:
    """Caps and defaults of the fact schema; the triple text only if all three parts exist."""
    s, p, o = (F.coalesce(c, F.lit("")) for c in ("triple_s", "triple_p", "triple_o"))
    whole = (s != "") & (p != "") & (o != "")
    cut_text = lambda c, n: F.when(F.col(c) != "", F.substring(c, 1, n))
    cut_list = lambda c, n: F.when(F.size(c) > 0, F.slice(c, 1, n))
    return rows.select(
        "fact_id",
        F.substring("content", 1, 500).alias("content"),
        "category",
        "confidence",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.5)))).alias("importance"),
        cut_list("keywords", 10).alias("keywords"),
        cut_list("persons", 5).alias("persons"),
        cut_list("entities", 5).alias("entities"),
        cut_text("topic", 100).alias("topic"),
        cut_text("location", 100).alias("location"),
        F.when(whole, F.substring("triple_s", 1, 100)).alias("triple_s"),
        F.when(whole, F.substring("triple_p", 1, 100)).alias("triple_p"),
        F.when(whole, F.substring("triple_o", 1, 200)).alias("triple_o"),
        F.when(whole, F.concat_ws(" | ", "triple_s", "triple_p", "triple_o")).alias("triple_str"),
        F.lit(0).cast("bigint").alias("access_count"),
        F.lit(1).cast("bigint").alias("source_count"),
        F.lit(1).cast("bigint").alias("version"),
    )


def write_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append rows, one folder per day, so that time ranges prune folders."""
    day = F.to_date(ts)
    df.withColumn("day", day).repartition("day", F.pmod(F.xxhash64(ts), F.lit(8))).write.mode("append").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str, past: str) -> DataFrame:
    """Rows of the days from ``first`` up to, not with, ``past``; other days' folders are not opened."""
    return spark.read.parquet(path).where((F.col("day") >= F.lit(first).cast("date")) & (F.col("day") < F.lit(past).cast("date"))).drop("day")
