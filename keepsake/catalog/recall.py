"""Registered queries: vector, lexical and fused retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keepsake.catalog import derived as d
from keepsake.catalog.registry import query
from keepsake.functions import depth
from keepsake.functions import text as tx
from keepsake.operators import lexical, ranking, vectors
from keepsake.operators.ordering import top_per_group
from keepsake.operators.vectors import Match
from keepsake.session import ensure_checkpoint_dir
from keepsake.sources import exchange

COSINE = "list_cosine_similarity(q.embedding, f.embedding)"


def active_vectors(spark, sf):
    return d.fact_vectors(spark, sf).filter("superseded_by IS NULL")


def knn_sql(k: int, where: str = "TRUE", name: str = "hits") -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT q.query_id, f.fact_id, {COSINE} AS cosine,
      row_number() OVER (PARTITION BY q.query_id ORDER BY {COSINE} DESC, f.fact_id) AS rank
    FROM query_vectors q JOIN fact_vectors f ON f.superseded_by IS NULL AND ({where})
  ) WHERE rank <= {k})"""


BASE = f"WITH {d.FACT_VECTORS}, {d.QUERY_VECTORS}"


@query("knn_topk", "VEC1 SEL5 SEL1", f"{BASE}, {knn_sql(10)} SELECT query_id, fact_id, round(cosine, 4) AS cosine, round((1 + cosine) / 2, 4) AS score, rank FROM hits")
def knn_topk(spark, sf):
    hits = vectors.knn(active_vectors(spark, sf), d.query_vectors(spark, sf), 10)
    return hits.select(
        "query_id", "fact_id", F.round("cosine", 4).alias("cosine"), F.round("score", 4).alias("score"),
        F.col("rank").cast("bigint").alias("rank"),
    )


SCENE = [Match("language", "language"), Match("domain", "domain", wildcard="general")]
SCENE_SQL = "f.language = q.language AND (q.domain = 'general' OR f.domain = q.domain)"


@query("knn_filtered", "VEC1 SEL6 SEL9", f"{BASE}, {knn_sql(5, SCENE_SQL + ' AND f.session_id <> q.session_id')} SELECT query_id, fact_id, round(cosine, 4) AS cosine, rank FROM hits")
def knn_filtered(spark, sf):
    rules = [*SCENE, Match("session_id", "session_id", "differ")]
    hits = vectors.knn(active_vectors(spark, sf), d.query_vectors(spark, sf), 5, rules=rules)
    return hits.select(
        "query_id", "fact_id", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("bigint").alias("rank")
    )


RANGE_SQL = "f.ts >= TIMESTAMP '2023-08-01' + to_days(q.query_id::INT % 20) AND f.ts <= TIMESTAMP '2023-12-01' + to_days(q.query_id::INT % 20)"


@query("knn_time_range", "VEC1 SEL7", f"{BASE}, {knn_sql(5, RANGE_SQL)} SELECT query_id, fact_id, round(cosine, 4) AS cosine, rank FROM hits")
def knn_time_range(spark, sf):
    shift = F.make_dt_interval((F.col("query_id") % 20).cast("int"))
    q = d.query_vectors(spark, sf)
    q = q.withColumn("time_from", F.unix_millis(F.lit("2023-08-01").cast("timestamp") + shift)).withColumn(
        "time_to", F.unix_millis(F.lit("2023-12-01").cast("timestamp") + shift)
    )
    corpus = active_vectors(spark, sf).withColumn("ts_ms", F.unix_millis("ts"))
    rules = [Match("time_from", "ts_ms", "at_least"), Match("time_to", "ts_ms", "at_most")]
    hits = vectors.knn(corpus, q, 5, rules=rules)
    return hits.select(
        "query_id", "fact_id", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("bigint").alias("rank")
    )


DAYS_SQL = "f.ts >= TIMESTAMP '2023-09-01' AND f.ts < TIMESTAMP '2023-10-01'"


@query("knn_stored_days", "VEC1 SEL7 SRC13", f"{BASE}, {knn_sql(5, DAYS_SQL)} SELECT query_id, fact_id, round(cosine, 4) AS cosine, rank FROM hits")
def knn_stored_days(spark, sf):
    """Facts written one folder per day; a search in a month reads that month's folders."""
    path = f"{ensure_checkpoint_dir(spark)}/days-{uuid.uuid4().hex}"
    exchange.write_by_day(active_vectors(spark, sf).select("fact_id", "ts", "embedding"), path)
    month = exchange.read_days(spark, path, "2023-09-01", "2023-10-01")
    hits = vectors.knn(month, d.query_vectors(spark, sf), 5)
    return hits.select("query_id", "fact_id", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


SCENE_GLOBAL = f"""{BASE}, {knn_sql(10, SCENE_SQL, 'scene')}, {knn_sql(10, 'TRUE', 'world')},
found AS (SELECT q.query_id, count(s.fact_id) AS n FROM query_vectors q LEFT JOIN scene s USING (query_id) GROUP BY ALL)
SELECT query_id, fact_id, round(cosine, 4) AS cosine, 'scene' AS source FROM scene
UNION ALL SELECT g.query_id, g.fact_id, round(g.cosine, 4), 'global' FROM world g JOIN found USING (query_id) WHERE g.rank <= 10 - n"""


@query("knn_scene_then_global", "VEC3 SEL6", SCENE_GLOBAL)
def knn_scene_then_global(spark, sf):
    hits = vectors.scene_then_global(active_vectors(spark, sf), d.query_vectors(spark, sf), 10, SCENE)
    return hits.select("query_id", "fact_id", F.round("cosine", 4).alias("cosine"), "source")


BLEND = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM v)),
m AS (SELECT vec_id, list_transform(list_zip(a, b), lambda z: z[1] * 0.5 + z[2] * 0.5) AS m FROM p),
n AS (SELECT vec_id, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS norm FROM m)
SELECT vec_id, round(m[1] / norm, 4) AS first_value, round(m[64] / norm, 4) AS last_value,
  round(list_sum(list_transform(m, lambda x: x * x / norm / norm)), 4) AS length FROM n"""


@query("vector_blend", "VEC4", BLEND)
def vector_blend(spark, sf):
    e = d.embeddings(spark, sf).select("vec_id", "embedding")
    n = e.count()
    other = e.select((F.col("vec_id") + n - 1).alias("_v"), F.col("embedding").alias("hyde")).withColumn(
        "vec_id", F.col("_v") % n
    )
    mixed = e.join(other, "vec_id").select("vec_id", vectors.blend("embedding", "hyde").alias("m"))
    length = F.aggregate("m", F.lit(0.0), lambda a, v: a + v * v)
    return mixed.select(
        "vec_id",
        F.round(F.element_at("m", 1), 4).alias("first_value"),
        F.round(F.element_at("m", 64), 4).alias("last_value"),
        F.round(length, 4).alias("length"),
    )


FAN = f"""{BASE},
sub AS (SELECT q.query_id, p.part, e.embedding::DOUBLE[] AS embedding FROM queries q, (VALUES (0), (1), (2)) p(part)
  JOIN embeddings e ON e.vec_id = (q.query_id * 3 + 1 + p.part * 17) % (SELECT n FROM n_vec)),
h AS (SELECT * FROM (SELECT s.query_id, s.part, f.fact_id, f.content, list_cosine_similarity(s.embedding, f.embedding) AS c,
    row_number() OVER (PARTITION BY s.query_id, s.part ORDER BY list_cosine_similarity(s.embedding, f.embedding) DESC, f.fact_id) AS r
  FROM sub s JOIN fact_vectors f ON f.superseded_by IS NULL) WHERE r <= 3)
SELECT query_id, fact_id, part, round(c, 4) AS cosine FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY part, c DESC, fact_id) AS one FROM h) WHERE one = 1"""


@query("fan_out_search", "VEC5", FAN)
def fan_out_search(spark, sf):
    e = d.embeddings(spark, sf).select("vec_id", "embedding")
    n = e.count()
    sub = (
        d.queries(spark, sf)
        .select("query_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part"))
        .withColumn("vec_id", (F.col("query_id") * 3 + 1 + F.col("part") * 17) % n)
        .join(e, "vec_id")
    )
    hits = vectors.fan_out(d.queries(spark, sf), sub, active_vectors(spark, sf), 3)
    return hits.select("query_id", "fact_id", "part", F.round("cosine", 4).alias("cosine"))


@query("category_profile", "VEC8", f"{BASE}, {knn_sql(20)} SELECT query_id, category, count(*) AS n FROM hits JOIN facts USING (fact_id) GROUP BY ALL")
def category_profile(spark, sf):
    corpus = active_vectors(spark, sf)
    hits = vectors.knn(corpus, d.query_vectors(spark, sf), 20)
    return vectors.category_profile(vectors.attach(hits, corpus, ["category"]))


# ---------------------------------------------------------------- lexical

WORDS = r"[\p{L}\p{N}_]+"


def tokens_sql(expr: str) -> str:
    return f"list_filter(regexp_extract_all(lower({expr}), '{WORDS}'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"


BM25 = f"""toks AS (SELECT fact_id AS doc_id, CASE WHEN superseded_by IS NULL THEN {tokens_sql('content')} ELSE [] END AS t FROM facts),
lens AS (SELECT doc_id, len(t) AS doc_len FROM toks),
stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln((SELECT n_docs FROM stats) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""

BM_SEARCH = f"""qt AS (SELECT query_id, term, count(*) AS rep FROM (SELECT query_id, unnest({tokens_sql('text')}) AS term FROM queries) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum(rep * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL),
bm_hits AS (SELECT * FROM (SELECT query_id, doc_id AS fact_id, score,
   row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 10)"""


@query("bm25_index_stats", "BM1 BM2", f"""WITH {d.FACTS}, {BM25}
SELECT 'documents' AS item, (SELECT n_docs FROM stats)::DOUBLE AS value UNION ALL SELECT 'average_length', round((SELECT avg_len FROM stats), 4)
UNION ALL SELECT 'terms', (SELECT count(*) FROM idf)::DOUBLE UNION ALL SELECT 'postings', (SELECT count(*) FROM post)::DOUBLE
UNION ALL SELECT 'mean_idf', round((SELECT avg(idf) FROM idf), 4)""")
def bm25_index_stats(spark, sf):
    ix = lexical.build_index(d.facts(spark, sf))
    row = lambda df, name, value: df.select(F.lit(name).alias("item"), value.cast("double").alias("value"))
    return (
        row(ix.stats, "documents", F.col("n_docs"))
        .unionByName(row(ix.stats, "average_length", F.round("avg_len", 4)))
        .unionByName(row(ix.idf, "terms", F.count(F.lit(1))))
        .unionByName(row(ix.postings, "postings", F.count(F.lit(1))))
        .unionByName(row(ix.idf, "mean_idf", F.round(F.avg("idf"), 4)))
    )


@query("bm25_term_weights", "BM2", f"WITH {d.FACTS}, {BM25} SELECT term, df, round(idf, 4) AS idf FROM idf")
def bm25_term_weights(spark, sf):
    ix = lexical.build_index(d.facts(spark, sf))
    return ix.idf.select("term", "df", F.round("idf", 4).alias("idf"))


@query("bm25_topk", "BM3", f"WITH {d.FACTS}, {d.QUERIES}, {BM25}, {BM_SEARCH} SELECT query_id, fact_id, round(score, 4) AS score, rank FROM bm_hits")
def bm25_topk(spark, sf):
    ix = lexical.build_index(d.facts(spark, sf))
    hits = lexical.search(ix, d.queries(spark, sf), 10)
    return hits.select(
        "query_id", F.col("doc_id").alias("fact_id"), F.round("score", 4).alias("score"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query("bm25_stored_topk", "BM2 BM3", f"WITH {d.FACTS}, {d.QUERIES}, {BM25}, {BM_SEARCH} SELECT query_id, fact_id, round(score, 4) AS score, rank FROM bm_hits")
def bm25_stored_topk(spark, sf):
    """The index written by term bucket, and a search that reads the buckets and ranges it needs."""
    path = f"{ensure_checkpoint_dir(spark)}/bm25-{uuid.uuid4().hex}"
    lexical.write_index(lexical.build_index(d.facts(spark, sf)), path)
    hits = lexical.search_stored(spark, path, d.queries(spark, sf), 10)
    return hits.select("query_id", F.col("doc_id").alias("fact_id"), F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


HALF_FACTS = d.FACTS.replace("facts AS", "every_fact AS")


@query("bm25_upkeep", "BM4", f"""WITH {HALF_FACTS}, facts AS (SELECT * FROM every_fact WHERE category <> 'warning'), {BM25}
SELECT term, df, round(idf, 4) AS idf, (SELECT n_docs FROM stats) AS n_docs FROM idf""")
def bm25_upkeep(spark, sf):
    """Start from the preferences' complement, add the preferences, remove the warnings."""
    every = d.facts(spark, sf)
    ix = lexical.build_index(every.filter("category <> 'preference'"))
    ix = lexical.add_documents(ix, every.filter("category = 'preference'"))
    gone = every.filter("category = 'warning'").select(F.col("fact_id").alias("doc_id"))
    ix = lexical.remove_documents(ix, gone)
    return ix.idf.select("term", "df", F.round("idf", 4).alias("idf"), ix.stats.select("n_docs").scalar().alias("n_docs"))


def boost_sql(text: str, content: str) -> str:
    stops = ", ".join(f"'{w}'" for w in lexical.STOP_WORDS)
    return (
        f"len(list_filter(list_distinct({tokens_sql(text)}), "
        f"lambda t: NOT list_contains([{stops}], t) AND contains(lower({content}), t))) * 0.3"
    )


@query("keyword_boost", "BM5", f"""{BASE}, {knn_sql(10)}
SELECT query_id, fact_id, round((1 + cosine) / 2 + 0.06 * {boost_sql('q.text', 'f.content')}, 4) AS score
FROM hits JOIN queries q USING (query_id) JOIN facts f USING (fact_id)""")
def keyword_boost(spark, sf):
    corpus = active_vectors(spark, sf)
    q = d.query_vectors(spark, sf)
    hits = vectors.attach(vectors.knn(corpus, q, 10), corpus, ["content"])
    full = hits.join(q.select("query_id", lexical.boost_tokens(F.col("text")).alias("tokens")), "query_id")
    return full.select(
        "query_id", "fact_id",
        F.round(F.col("score") + lexical.keyword_boost(F.col("tokens"), F.col("content")), 4).alias("score"),
    )


# ---------------------------------------------------------------- ranking

HEAT = f"""greatest(0.01, exp(-(epoch_us(TIMESTAMP '{d.AS_OF}') - epoch_us(f.ts)) / 86400000000.0 / 30) * (1 + 0.25 * ln(1 + f.access_count)))"""


@query("heat_score", "HEAT1", f"WITH {d.FACTS} SELECT fact_id, round({HEAT}, 6) AS heat FROM facts f")
def heat_score(spark, sf):
    return d.facts(spark, sf).select(
        "fact_id", F.round(ranking.heat(F.col("ts"), F.col("access_count"), d.as_of()), 6).alias("heat")
    )


WARM = f"""warm AS (SELECT query_id, fact_id, greatest(0, (1 + cosine) / 2) * {HEAT} AS heat_score FROM hits JOIN facts f USING (fact_id)),
warm_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(heat_score, 12) DESC, fact_id) AS heat_rank FROM warm)"""


@query("heat_rerank", "HEAT2", f"{BASE}, {knn_sql(10)}, {WARM} SELECT query_id, fact_id, round(heat_score, 4) AS heat_score, heat_rank FROM warm_ranked")
def heat_rerank(spark, sf):
    corpus = active_vectors(spark, sf)
    hits = vectors.attach(vectors.knn(corpus, d.query_vectors(spark, sf), 10), corpus, ["ts", "access_count"])
    return ranking.heat_rank(hits, d.as_of()).select(
        "query_id", "fact_id", F.round("heat_score", 4).alias("heat_score"), F.col("heat_rank").cast("bigint").alias("heat_rank")
    )


@query("access_bump", "HEAT3", f"""{BASE}, {knn_sql(10)}, use AS (SELECT fact_id, count(*) AS n FROM hits GROUP BY ALL)
SELECT fact_id, access_count + coalesce(n, 0) AS access_count,
  CASE WHEN n IS NULL THEN strftime(last_confirmed_ts, '%Y-%m-%d') ELSE '2024-02-01' END AS confirmed FROM facts LEFT JOIN use USING (fact_id)""")
def access_bump(spark, sf):
    hits = vectors.knn(active_vectors(spark, sf), d.query_vectors(spark, sf), 10)
    bumped = ranking.bump_access(d.facts(spark, sf), hits.withColumn("hit_ts", d.as_of()))
    return bumped.select("fact_id", "access_count", F.date_format("last_confirmed_ts", "yyyy-MM-dd").alias("confirmed"))


def two_lists(spark, sf):
    """Vector hits in heat order (list 1) and BM25 hits (list 4) with content."""
    corpus = active_vectors(spark, sf)
    q = d.query_vectors(spark, sf)
    vec = ranking.heat_rank(
        vectors.attach(vectors.knn(corpus, q, 10), corpus, ["ts", "access_count", "content"]), d.as_of()
    ).select("query_id", F.lit(1).alias("list_no"), F.col("heat_rank").alias("rank"), "fact_id", "content")
    bm = lexical.search(lexical.build_index(d.facts(spark, sf)), q, 10).withColumnRenamed("doc_id", "fact_id")
    bm = vectors.attach(bm, corpus, ["content"]).select(
        "query_id", F.lit(4).alias("list_no"), "rank", "fact_id", "content"
    )
    return vec.unionByName(bm)


LISTS = f"""{BASE}, {BM25}, {BM_SEARCH}, {knn_sql(10)}, {WARM},
lists AS (SELECT query_id, 1 AS list_no, heat_rank AS rank, fact_id, content FROM warm_ranked JOIN facts USING (fact_id)
  UNION ALL SELECT query_id, 4, rank, fact_id, content FROM bm_hits JOIN facts USING (fact_id))"""


def fuse_sql(weight: str, limit: int, key: str = "content", source: str = "lists", out: str = "fused") -> str:
    return f"""{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, fact_id) AS rank FROM (
    SELECT query_id, {key}, sum({weight} / (60 + rank)) AS rrf, arg_min(fact_id, list_no * 1000000 + rank) AS fact_id
    FROM {source} WHERE {key} IS NOT NULL GROUP BY query_id, {key})) WHERE rank <= {limit})"""


WEIGHT = "(CASE list_no WHEN 1 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END)"


@query("rrf_two_lists", "FUS1", f"{LISTS}, {fuse_sql(WEIGHT, 10)} SELECT query_id, fact_id, round(rrf, 6) AS rrf, rank FROM fused")
def rrf_two_lists(spark, sf):
    lists = two_lists(spark, sf).withColumn("weight", F.when(F.col("list_no") == 1, 1.0).otherwise(0.9))
    return ranking.fuse(lists, 10).select(
        "query_id", "fact_id", F.round("rrf", 6).alias("rrf"), F.col("rank").cast("bigint").alias("rank")
    )


@query("rrf_by_id", "FUS3", f"{LISTS}, {fuse_sql('1.0::DOUBLE', 50, 'fact_key', '(SELECT *, fact_id AS fact_key FROM lists)')} SELECT query_id, fact_id, round(rrf, 6) AS rrf, rank FROM fused")
def rrf_by_id(spark, sf):
    lists = two_lists(spark, sf).withColumn("weight", F.lit(1.0)).withColumn("fact_key", F.col("fact_id"))
    return ranking.fuse(lists, 50, key="fact_key").select(
        "query_id", "fact_id", F.round("rrf", 6).alias("rrf"), F.col("rank").cast("bigint").alias("rank")
    )


QW = f"""qw AS (SELECT query_id, CASE WHEN e AND t THEN [0.8, 0.8, 1.4, 1.2] WHEN e THEN [0.9, 0.9, 1.2, 1.1] WHEN t THEN [0.9, 0.9, 1.2, 0.8]
  ELSE [1.0, 1.0, 0.6, 0.9] END::DOUBLE[] AS w FROM (SELECT query_id, len({d.entities_sql('text')}) > 3 AS e, query_id % 3 = 0 AS t FROM queries))"""


@query("rrf_query_weights", "FUS2 EXT8", f"""{LISTS}, {QW}, wl AS (SELECT l.*, w[list_no] AS weight FROM lists l JOIN qw USING (query_id)),
{fuse_sql('weight', 10, source='wl')} SELECT query_id, fact_id, round(rrf, 6) AS rrf, rank FROM fused""")
def rrf_query_weights(spark, sf):
    named = F.size(tx.all_matches(F.col("text"), tx.CAPITALISED)) > 3
    w = d.queries(spark, sf).select(
        "query_id", ranking.fusion_weights(named, F.col("query_id") % 3 == 0).alias("w")
    )
    lists = two_lists(spark, sf).join(w, "query_id").withColumn("weight", F.element_at("w", F.col("list_no")))
    return ranking.fuse(lists, 10).select(
        "query_id", "fact_id", F.round("rrf", 6).alias("rrf"), F.col("rank").cast("bigint").alias("rank")
    )


@query("importance_boost", "FUS4", f"""{BASE}, {knn_sql(10)} SELECT query_id, fact_id, round((1 + cosine) / 2 + 0.15 * importance, 4) AS score
FROM hits JOIN facts USING (fact_id)""")
def importance_boost(spark, sf):
    corpus = active_vectors(spark, sf)
    hits = vectors.attach(vectors.knn(corpus, d.query_vectors(spark, sf), 10), corpus, ["importance"])
    return hits.select(
        "query_id", "fact_id", F.round(ranking.importance_boost(F.col("score"), F.col("importance")), 4).alias("score")
    )


@query("session_diversity", "FUS5", f"""{BASE}, {knn_sql(60)} SELECT query_id, fact_id, session_id, rank FROM (
  SELECT h.query_id, h.fact_id, f.session_id, h.rank, row_number() OVER (PARTITION BY h.query_id, f.session_id ORDER BY h.rank) AS s
  FROM hits h JOIN facts f USING (fact_id)) WHERE s <= 3""")
def session_diversity(spark, sf):
    corpus = active_vectors(spark, sf)
    hits = vectors.attach(vectors.knn(corpus, d.query_vectors(spark, sf), 60), corpus, ["session_id"])
    return ranking.diversify(hits, 3, [F.asc("rank")]).select(
        "query_id", "fact_id", "session_id", F.col("rank").cast("bigint").alias("rank")
    )


@query("query_depth", "EXT9", f"""WITH {d.QUERIES}, c AS (SELECT query_id, memory_limit, least(1.0::DOUBLE,
   len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 30.0::DOUBLE
   + len(list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda w: regexp_full_match(w, '{tx.COMPLEX_SIGNALS}'))) * 0.2::DOUBLE) AS c FROM queries)
SELECT query_id, round(c, 4) AS complexity, greatest(1, floor(greatest(1, memory_limit // 2) * (1 + 0.8 * c)))::BIGINT AS n_facts,
  greatest(2, floor(memory_limit * (1 + 0.8 * c * 0.5)))::BIGINT AS n_episodes FROM c""")
def query_depth(spark, sf):
    t, limit = F.col("text"), F.col("memory_limit")
    return d.queries(spark, sf).select(
        "query_id",
        F.round(depth.complexity(t), 4).alias("complexity"),
        depth.facts_wanted(t, limit).alias("n_facts"),
        depth.episodes_wanted(t, limit).alias("n_episodes"),
    )


# ---------------------------------------------------------------- two tiers

EP = f"WITH {d.FACT_VECTORS}, {d.QUERY_VECTORS}, {d.EPISODE_VECTORS}, {knn_sql(10)}, " + """ep_hits AS (SELECT * FROM (
    SELECT q.query_id, f.episode_id, f.content, list_cosine_similarity(q.embedding, f.embedding) AS cosine,
      row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.embedding, f.embedding) DESC, f.episode_id) AS rank
    FROM query_vectors q JOIN episode_vectors f ON TRUE) WHERE rank <= 10),
both_lists AS (SELECT query_id, 1 AS list_no, 1.0::DOUBLE AS weight, rank, fact_id, content FROM hits JOIN facts USING (fact_id)
  UNION ALL SELECT query_id, 2, 0.8::DOUBLE, rank, -episode_id - 1, content FROM ep_hits)"""


def both_tiers(spark, sf, k_facts=10, k_episodes=10):
    """Hits of both tiers in one table; episode ids are negative."""
    corpus, eps, q = active_vectors(spark, sf), d.episode_vectors(spark, sf), d.query_vectors(spark, sf)
    f = vectors.attach(vectors.knn(corpus, q, k_facts), corpus, ["content", "category"]).select(
        "query_id", F.lit(1).alias("list_no"), F.lit(1.0).alias("weight"), "rank", "fact_id", "content", "category", "score"
    )
    e = vectors.attach(vectors.knn(eps, q, k_episodes, "episode_id"), eps, ["content"], "episode_id").select(
        "query_id", F.lit(2).alias("list_no"), F.lit(0.8).alias("weight"), "rank",
        (-F.col("episode_id") - 1).alias("fact_id"), "content", F.lit("episode").alias("category"), "score",
    )
    return f.unionByName(e)


@query("smart_search", "VEC9", f"{EP}, {fuse_sql('weight', 10, source='both_lists')} SELECT query_id, fact_id, round(rrf, 6) AS rrf, rank FROM fused")
def smart_search(spark, sf):
    return ranking.fuse(both_tiers(spark, sf), 10).select(
        "query_id", "fact_id", F.round("rrf", 6).alias("rrf"), F.col("rank").cast("bigint").alias("rank")
    )


@query("plain_search", "VEC11", f"""{EP} SELECT query_id, fact_id, content[1:200] AS content, category, round((1 + cosine) / 2, 3) AS score
FROM hits JOIN facts USING (fact_id) UNION ALL SELECT query_id, -episode_id - 1, content[1:200], 'episode', round((1 + cosine) / 2, 3) FROM ep_hits""")
def plain_search(spark, sf):
    return both_tiers(spark, sf).select(
        "query_id", "fact_id", F.substring("content", 1, 200).alias("content"), "category", F.round("score", 3).alias("score")
    )


@query("batch_search", "VEC10", f"""{EP}, {fuse_sql('weight', 5, source='both_lists')},
b AS (SELECT query_id // 5 AS batch, query_id, content, fact_id, rrf, rank FROM fused),
one AS (SELECT *, row_number() OVER (PARTITION BY batch, content[1:60] ORDER BY query_id, rank) AS o FROM b)
SELECT batch, fact_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY query_id, rank) AS pos FROM one WHERE o = 1) WHERE pos <= 30""")
def batch_search(spark, sf):
    """Five queries to a batch; the first hit of each 60-character prefix stays, 30 per batch."""
    hits = ranking.fuse(both_tiers(spark, sf), 5).withColumn("batch", F.floor(F.col("query_id") / 5))
    one = top_per_group(
        hits.withColumn("_head", F.substring("content", 1, 60)), ["batch", "_head"], [F.asc("query_id"), F.asc("rank")], 1, "_o"
    )
    best = top_per_group(one, ["batch"], [F.asc("query_id"), F.asc("rank")], 30, "pos")
    return best.select("batch", "fact_id", F.col("pos").cast("bigint").alias("pos"))


PROC = f"""WITH {d.PROCEDURE_VECTORS}, {d.QUERY_VECTORS},
ph AS (SELECT * FROM (SELECT q.query_id, p.proc_id, p.success_count AS s, p.fail_count AS f, list_cosine_similarity(q.embedding, p.embedding) AS c,
  row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.embedding, p.embedding) DESC, p.proc_id) AS r
  FROM query_vectors q JOIN procedure_vectors p ON TRUE) WHERE r <= 6)"""


@query("beta_rerank", "FUS6 PR2", f"""{PROC}, b AS (SELECT *, CASE WHEN s + f >= 3 THEN (1 + c) / 2 * (s + 1) / (s + f + 2) ELSE (1 + c) / 2 END AS a FROM ph)
SELECT query_id, proc_id, round(a, 4) AS adjusted, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 12) DESC, proc_id) AS pos FROM b) WHERE pos <= 2""")
def beta_rerank(spark, sf):
    """Six nearest procedures, two kept after weighing by their outcomes."""
    procs = d.procedure_vectors(spark, sf)
    hits = vectors.attach(
        vectors.knn(procs, d.query_vectors(spark, sf), 6, "proc_id"), procs, ["success_count", "fail_count"], "proc_id"
    )
    adjusted = hits.withColumn(
        "adjusted", ranking.beta_score(F.col("score"), F.col("success_count"), F.col("fail_count"))
    )
    best = top_per_group(adjusted, ["query_id"], [F.desc(F.round("adjusted", 12)), F.asc("proc_id")], 2, "pos")
    return best.select("query_id", "proc_id", F.round("adjusted", 4).alias("adjusted"), F.col("pos").cast("bigint").alias("pos"))


@query("procedure_recall", "PR2 REC2", f"{PROC} SELECT query_id, proc_id, round((1 + c) / 2, 4) AS score, r AS rank FROM ph")
def procedure_recall(spark, sf):
    hits = vectors.knn(d.procedure_vectors(spark, sf), d.query_vectors(spark, sf), 6, "proc_id")
    return hits.select("query_id", "proc_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))
