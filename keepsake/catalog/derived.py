"""The memory tables derived from the given parquet tables, once for Spark and once as SQL.

Every value follows from the given rows by integer arithmetic or from their
text, so that Spark and a second engine compute the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.session import spread

AS_OF = "2024-02-01 00:00:00"
CATEGORIES = ["identity", "rule", "preference", "decision", "procedure", "context", "warning", "general"]
DOMAINS = ["trading", "coding", "devops", "ai", "finance", "general"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """The ``facts`` tier: one row per document."""
    d = F.col("doc_id")
    created = F.lit("2023-07-01").cast("timestamp") + F.make_dt_interval((d * 3 % 210).cast("int"))
    return (
        table(spark, sf, "documents")
        .select(
            d.alias("fact_id"),
            F.col("text").alias("content"),
            F.col("lang").alias("language"),
            pick(DOMAINS, d % 6).alias("domain"),
            F.col("source").alias("session_id"),
            pick(CATEGORIES, d % 8).alias("category"),
            ((d * 37 % 100) / 100.0).alias("importance"),
            (0.5 + (d * 13 % 50) / 100.0).alias("confidence"),
            (1 + d % 4).alias("source_count"),
            (d * 7 % 23).alias("access_count"),
            created.alias("ts"),
            F.when((d % 29 == 0) & (d > 0), d - 1).alias("superseded_by"),
        )
        .withColumn(
            "last_confirmed_ts", F.col("ts") + F.make_dt_interval((F.col("fact_id") % 15).cast("int"))
        )
    )


FACTS = f"""facts AS (
  SELECT doc_id AS fact_id, text AS content, lang AS language, source AS session_id,
    list_extract({DOMAINS}, (doc_id % 6 + 1)::INT) AS domain,
    list_extract({CATEGORIES}, (doc_id % 8 + 1)::INT) AS category,
    (doc_id * 37 % 100) / 100.0::DOUBLE AS importance,
    0.5::DOUBLE + (doc_id * 13 % 50) / 100.0::DOUBLE AS confidence,
    1 + doc_id % 4 AS source_count, doc_id * 7 % 23 AS access_count,
    TIMESTAMP '2023-07-01' + to_days((doc_id * 3 % 210)::INT) AS ts,
    TIMESTAMP '2023-07-01' + to_days((doc_id * 3 % 210 + doc_id % 15)::INT) AS last_confirmed_ts,
    CASE WHEN doc_id % 29 = 0 AND doc_id > 0 THEN doc_id - 1 END AS superseded_by
  FROM documents)"""


def fact_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with the paired embedding."""
    emb = embeddings(spark, sf)
    n = emb.count()
    return (
        facts(spark, sf)
        .withColumn("vec_id", F.col("fact_id") % n)
        .join(emb.select("vec_id", "embedding"), "vec_id")
        .drop("vec_id")
    )


FACT_VECTORS = (
    FACTS
    + """, n_vec AS (SELECT count(*) AS n FROM embeddings),
fact_vectors AS (
  SELECT f.*, e.embedding::DOUBLE[] AS embedding
  FROM facts f JOIN embeddings e ON e.vec_id = f.fact_id % (SELECT n FROM n_vec))"""
)


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Recall requests: one per benchmark item."""
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        i.alias("query_id"),
        F.col("text"),
        pick(["en", "en", "fr", "de", "es"], i % 5).alias("language"),
        pick(DOMAINS, i % 6).alias("domain"),
        F.concat(F.lit("src"), i % 20).alias("session_id"),
        (4 + i % 5).alias("memory_limit"),
    )


QUERIES = f"""queries AS (
  SELECT item_id AS query_id, text,
    list_extract(['en','en','fr','de','es'], (item_id % 5 + 1)::INT) AS language,
    list_extract({DOMAINS}, (item_id % 6 + 1)::INT) AS domain,
    'src' || (item_id % 20) AS session_id, 4 + item_id % 5 AS memory_limit
  FROM benchmark)"""


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    emb = embeddings(spark, sf)
    n = emb.count()
    return (
        queries(spark, sf)
        .withColumn("vec_id", (F.col("query_id") * 3 + 1) % n)
        .join(emb.select("vec_id", "embedding"), "vec_id")
        .drop("vec_id")
    )


QUERY_VECTORS = (
    QUERIES
    + """,
query_vectors AS (
  SELECT q.*, e.embedding::DOUBLE[] AS embedding
  FROM queries q JOIN embeddings e ON e.vec_id = (q.query_id * 3 + 1) % (SELECT count(*) FROM embeddings))"""
)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chat messages: one row per turn."""
    c = table(spark, sf, "conversations")
    start = F.lit("2024-01-01").cast("timestamp")
    return c.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        "role",
        F.col("text").alias("content"),
        (start + F.make_dt_interval(F.lit(0), (F.col("conv_id") % 500).cast("int"), (F.col("turn") * 5).cast("int"))).alias("ts"),
    )


MESSAGES = """messages AS (
  SELECT conv_id AS session_id, turn AS seq, role, text AS content,
    TIMESTAMP '2024-01-01' + to_hours((conv_id % 500)::INT) + to_minutes((turn * 5)::INT) AS ts
  FROM conversations)"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes: one per message of a user or an assistant."""
    return (
        messages(spark, sf)
        .filter(F.col("role") != "system")
        .select(
            (F.col("session_id") * 1000 + F.col("seq")).alias("episode_id"),
            "session_id",
            "content",
            "ts",
            (F.col("seq") % 3).alias("access_count"),
            F.lit(0.5).alias("importance"),
        )
    )


EPISODES = (
    MESSAGES
    + """, episodes AS (
  SELECT session_id * 1000 + seq AS episode_id, session_id, content, ts, seq % 3 AS access_count,
    0.5::DOUBLE AS importance
  FROM messages WHERE role <> 'system')"""
)


def episode_vectors(spark: SparkSession, sf: str) -> DataFrame:
    emb = embeddings(spark, sf)
    n = emb.count()
    return (
        episodes(spark, sf)
        .withColumn("vec_id", F.col("episode_id") * 7 % n)
        .join(emb.select("vec_id", "embedding"), "vec_id")
        .drop("vec_id")
    )


EPISODE_VECTORS = (
    EPISODES
    + """, episode_vectors AS (
  SELECT p.*, e.embedding::DOUBLE[] AS embedding
  FROM episodes p JOIN embeddings e ON e.vec_id = p.episode_id * 7 % (SELECT count(*) FROM embeddings))"""
)


def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Tool-call log: one row per event."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("session_id"),
        F.concat(F.lit("tool_"), k % 12).alias("tool"),
        k.alias("k"),
        (F.col("event_type") != "error").alias("success"),
        "event_type",
        "value",
    )


TOOL_CALLS = """calls AS (
  SELECT event_id, ts, user_id AS session_id, 'tool_' || ((props->>'$.k')::BIGINT % 12) AS tool,
    (props->>'$.k')::BIGINT AS k, event_type <> 'error' AS success, event_type, value
  FROM events)"""


def procedures(spark: SparkSession, sf: str) -> DataFrame:
    """Procedures: one per part, with up to three tools."""
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        p.alias("proc_id"),
        F.concat_ws(" ", F.lit("assemble"), "p_name", "p_type").alias("task"),
        F.concat_ws(" ", F.lit("step"), F.col("p_size"), F.lit("of"), "p_brand").alias("procedure"),
        F.array_distinct(
            F.array(*[F.concat(F.lit("Tool_"), (p * m + m) % 12) for m in (1, 5, 7)])
        ).alias("tools_used"),
        (p * 3 % 11).alias("success_count"),
        (p * 5 % 7).alias("fail_count"),
    )


PROCEDURES = """procedures AS (
  SELECT p_partkey AS proc_id, 'assemble ' || p_name || ' ' || p_type AS task,
    'step ' || p_size || ' of ' || p_brand AS procedure,
    list_distinct(['Tool_' || ((p_partkey * 1 + 1) % 12), 'Tool_' || ((p_partkey * 5 + 5) % 12),
      'Tool_' || ((p_partkey * 7 + 7) % 12)]) AS tools_used,
    p_partkey * 3 % 11 AS success_count, p_partkey * 5 % 7 AS fail_count
  FROM part)"""


def procedure_vectors(spark: SparkSession, sf: str) -> DataFrame:
    emb = embeddings(spark, sf)
    n = emb.count()
    return (
        procedures(spark, sf)
        .withColumn("vec_id", F.col("proc_id") * 11 % n)
        .join(emb.select("vec_id", "embedding"), "vec_id")
        .drop("vec_id")
    )


PROCEDURE_VECTORS = (
    PROCEDURES
    + """, procedure_vectors AS (
  SELECT p.*, e.embedding::DOUBLE[] AS embedding
  FROM procedures p JOIN embeddings e ON e.vec_id = p.proc_id * 11 % (SELECT count(*) FROM embeddings))"""
)


def tools(spark: SparkSession, sf: str) -> DataFrame:
    """Tool registry: one per supplier."""
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        tx.tool_key(F.col("s_name")).alias("tool_key"),
        F.col("s_name").alias("name"),
        F.concat_ws(
            " ",
            F.lit("Tool to"),
            pick(["read and edit files", "search the web", "run shell commands", "query a database", "commit and push"], s % 5),
        ).alias("description"),
        pick(["builtin", "mcp", "plugin", "skill"], s % 4).alias("source"),
        (s % 9).alias("use_count"),
        s.alias("suppkey"),
    )


TOOLS = """tools AS (
  SELECT replace(replace(lower(s_name), ' ', '_'), '/', '_')[1:64] AS tool_key, s_name AS name,
    'Tool to ' || list_extract(['read and edit files', 'search the web', 'run shell commands',
      'query a database', 'commit and push'], (s_suppkey % 5 + 1)::INT) AS description,
    list_extract(['builtin','mcp','plugin','skill'], (s_suppkey % 4 + 1)::INT) AS source,
    s_suppkey % 9 AS use_count, s_suppkey AS suppkey
  FROM supplier)"""


# Non-ASCII letters become "_" and other non-ASCII marks a blank, so that the
# ASCII word boundary of RE2 falls where the Unicode one does.
def fold_sql(expr: str) -> str:
    return (
        f"regexp_replace(regexp_replace({expr}, '[^\\p{{L}}\\p{{N}}\\x00-\\x7F]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
    )


def entities_sql(expr: str) -> str:
    folded = fold_sql(expr)
    return (
        f"list_concat(regexp_extract_all({folded}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b'), "
        f"regexp_extract_all({folded}, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b'))"
    )


def distinct_in_order_sql(expr: str) -> str:
    """Distinct list in order of first appearance; ``expr`` must be a column name."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


FACT_ENTITIES = (
    FACTS
    + f""", fact_raw AS (SELECT *, {entities_sql('content')} AS ents FROM facts),
fact_entities AS (SELECT * EXCLUDE (ents), ({distinct_in_order_sql('ents')})[1:5] AS entities FROM fact_raw)"""
)


def fact_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with at most five entities, the cap of the fact schema."""
    return facts(spark, sf).withColumn(
        "entities", F.slice(tx.capitalised_entities(F.col("content")), 1, 5)
    )


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Short first-person turns, one per order: (session_id, turn_id, ts, text)."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name")
    tail = pick(
        [
            "remember: pack it twice. The deadline 2024-03-01 stands",
            "To fix a late order, use grep. We switched to air freight",
            "I'm a buyer at Acme, my brother Tom knows",
            "nothing else",
            "I used bash to count boxes. installed the label tool",
        ],
        k % 5,
    )
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_custkey").alias("session_id"),
            k.alias("turn_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.concat(
                F.lit("I live in "), "n_name", F.lit(". I like "), F.lower("c_mktsegment"), F.lit(", always use "),
                "o_orderpriority", F.lit(". "), tail, F.lit("."),
            ).alias("text"),
        )
    )


STATEMENTS = """statements AS (
  SELECT o_custkey AS session_id, o_orderkey AS turn_id, o_orderdate AS ts,
    'I live in ' || n_name || '. I like ' || lower(c_mktsegment) || ', always use ' || o_orderpriority || '. ' ||
    list_extract(['remember: pack it twice. The deadline 2024-03-01 stands', 'To fix a late order, use grep. We switched to air freight',
      'I''m a buyer at Acme, my brother Tom knows', 'nothing else', 'I used bash to count boxes. installed the label tool'],
      (o_orderkey % 5 + 1)::INT) || '.' AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
