"""Registered queries: the life cycle of facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.catalog import derived as d
from keepsake.catalog.registry import query
from keepsake.functions import decay
from keepsake.functions import text as tx
from keepsake.operators import lifecycle, similarity
from keepsake.operators.ranking import days_between
from keepsake.plans.consolidate import consolidate
from keepsake.session import cut

NOW = f"TIMESTAMP '{d.AS_OF}'"


def days_sql(col: str) -> str:
    return f"((epoch_us({NOW}) - epoch_us({col})) / 86400000000.0)"


def case_sql(col: str, values: dict, default) -> str:
    return f"(CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END)"


S1 = case_sql("category", decay.STABILITY_DAYS, 90)
S2 = case_sql("category", decay.REPORT_STABILITY_DAYS, 90)
CONF = f"""(CASE WHEN superseded_by IS NOT NULL THEN 0.0::DOUBLE ELSE round(confidence * exp(-greatest(0, {days_sql('last_confirmed_ts')}) / {S1})
  * (CASE WHEN source_count >= 3 THEN 1.0::DOUBLE WHEN source_count = 2 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END), 4) END)"""
AGED = f"(CASE WHEN {days_sql('ts')} > 90 THEN round(importance * 0.9, 4) ELSE importance END)"


@query("effective_confidence", "LIF1 SEL18", f"WITH {d.FACTS} SELECT fact_id, category, {CONF} AS effective_confidence FROM facts")
def effective_confidence(spark, sf):
    return d.facts(spark, sf).select(
        "fact_id", "category", decay.effective_confidence(d.as_of()).alias("effective_confidence")
    )


@query("fact_metadata", "SEL18", f"""WITH {d.FACTS} SELECT fact_id, content[1:500] AS content, category, importance, confidence, {CONF} AS effective_confidence,
  source_count, access_count, epoch_ms(ts) AS created_at, epoch_ms(last_confirmed_ts) AS last_confirmed, 1 AS version,
  coalesce(superseded_by::VARCHAR, '') AS superseded_by FROM facts""")
def fact_metadata(spark, sf):
    return d.facts(spark, sf).select(
        "fact_id", F.substring("content", 1, 500).alias("content"), "category", "importance", "confidence",
        decay.effective_confidence(d.as_of()).alias("effective_confidence"), "source_count", "access_count",
        F.unix_millis("ts").alias("created_at"), F.unix_millis("last_confirmed_ts").alias("last_confirmed"),
        F.lit(1).alias("version"), F.coalesce(F.col("superseded_by").cast("string"), F.lit("")).alias("superseded_by"),
    )


@query("importance_decay", "LIF2", f"WITH {d.FACTS} SELECT fact_id, {AGED} AS importance FROM facts")
def importance_decay(spark, sf):
    return d.facts(spark, sf).select("fact_id", decay.aged_importance(d.as_of()).alias("importance"))


SINCE = f"(CASE WHEN access_count > 10 THEN greatest(0, {days_sql('ts')} - fact_id % 40) END)"
DECAYED = f"greatest(0, least(1, importance * exp(-coalesce({SINCE}, {days_sql('ts')}) / {S2}) * least(1 + source_count * 0.1, 2.0)))"


@query("decay_report", "LIF3", f"""WITH {d.FACTS} SELECT fact_id, round({DECAYED}, 4) AS decayed, round(exp(-coalesce({SINCE}, {days_sql('ts')}) / {S2}), 4) AS factor,
  ({DECAYED}) < 0.05 AS should_prune FROM facts""")
def decay_report(spark, sf):
    age = days_between(d.as_of(), F.col("ts"))
    since = F.when(F.col("access_count") > 10, F.greatest(F.lit(0.0), age - F.col("fact_id") % 40))
    value = decay.decayed_importance(F.col("importance"), F.col("category"), age, since, F.col("source_count"))
    return d.facts(spark, sf).select(
        "fact_id",
        F.round(value, 4).alias("decayed"),
        F.round(F.exp(-F.coalesce(since, age) / decay.report_stability(F.col("category"))), 4).alias("factor"),
        (value < decay.PRUNE_IMPORTANCE).alias("should_prune"),
    )


@query("aged_confidence", "LIF4", f"""WITH {d.FACTS} SELECT fact_id, round(greatest(0, least(1, confidence * exp(-{days_sql('ts')} / {S2}) + least(access_count * 0.02, 0.2))), 4) AS confidence FROM facts""")
def aged_confidence(spark, sf):
    age = days_between(d.as_of(), F.col("ts"))
    return d.facts(spark, sf).select(
        "fact_id",
        F.round(decay.aged_confidence(F.col("confidence"), F.col("category"), age, F.col("access_count")), 4).alias("confidence"),
    )


@query("review_due", "LIF5", f"""WITH {d.FACTS}, steps(priority, ratio) AS (VALUES ('high', 0.5), ('medium', 0.75), ('low', 0.9))
SELECT fact_id, priority, round(({S2} * ratio)::DOUBLE, 1) AS when_days, round({S2} * ln(2), 1) AS half_life FROM facts, steps
WHERE {days_sql('last_confirmed_ts')} >= round(({S2} * ratio)::DOUBLE, 1)""")
def review_due(spark, sf):
    return lifecycle.reviews_due(d.facts(spark, sf), d.as_of())


@query("prune_flags", "LIF10", f"""WITH {d.FACTS}, p AS (SELECT DISTINCT doc_id AS fact_id FROM labels WHERE quality = 1)
SELECT fact_id, CASE WHEN fact_id IN (SELECT fact_id FROM p) THEN NULL WHEN {AGED} < 0.05 THEN 'pruned' WHEN {CONF} < 0.1 THEN 'confidence_expired' END AS reason
FROM facts WHERE superseded_by IS NULL""")
def prune_flags(spark, sf):
    pins = d.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("fact_id")).distinct()
    rows = d.facts(spark, sf).filter("superseded_by IS NULL").join(
        pins.withColumn("pinned", F.lit(True)), "fact_id", "left"
    )
    reason = decay.prune_reason(
        decay.aged_importance(d.as_of()), decay.effective_confidence(d.as_of()), F.coalesce("pinned", F.lit(False))
    )
    return rows.select("fact_id", reason.alias("reason"))


TOMB = f"""tomb AS (SELECT doc_id AS fact_id, doc_id + 1 AS b, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low_quality' END AS reason, 2 AS tm FROM labels WHERE toxic = 1 OR quality = 0
  UNION ALL SELECT doc_id, doc_id + 2, 'contradicted', 1 FROM labels WHERE toxic = 1),
t AS (SELECT fact_id, arg_min(b, tm * 100000000 + b) AS b, arg_min(reason, tm * 100000000 + b) AS reason FROM tomb GROUP BY ALL)"""


def tombstones(spark, sf):
    lab = d.table(spark, sf, "labels")
    at = lambda n: F.lit(d.AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(n))
    one = lab.filter("toxic = 1 OR quality = 0").select(
        F.col("doc_id").alias("fact_id"), (F.col("doc_id") + 1).alias("by"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("low_quality").alias("reason"), at(2).alias("at"),
    )
    two = lab.filter("toxic = 1").select(
        F.col("doc_id").alias("fact_id"), (F.col("doc_id") + 2).alias("by"), F.lit("contradicted").alias("reason"), at(1).alias("at")
    )
    return one.unionByName(two)


@query("soft_delete_once", "LIF11", f"""WITH {d.FACTS}, {TOMB} SELECT fact_id, coalesce(superseded_by, b) AS superseded_by,
  CASE WHEN superseded_by IS NULL THEN reason END AS superseded_reason FROM facts LEFT JOIN t USING (fact_id)""")
def soft_delete_once(spark, sf):
    """Deletes are applied, then applied again: the second time changes nothing."""
    stones = tombstones(spark, sf)
    once = lifecycle.soft_delete(d.facts(spark, sf), stones)
    twice = lifecycle.soft_delete(once, stones.withColumn("reason", F.lit("again")))
    return twice.select("fact_id", "superseded_by", "superseded_reason")


@query("hard_prune", "LIF12", f"""WITH {d.FACTS}, {d.EPISODES}
SELECT 'facts' AS tier, fact_id AS id FROM facts WHERE superseded_by IS NOT NULL AND {days_sql('ts')} > 7
UNION ALL SELECT 'episodes', episode_id FROM episodes WHERE (epoch_us(TIMESTAMP '2024-07-15') - epoch_us(ts)) / 86400000000.0 > 180 AND access_count = 0""")
def hard_prune(spark, sf):
    """The removed rows of both tiers; episodes are judged at a later date."""
    gone = d.facts(spark, sf).filter(lifecycle.is_hard_pruned(d.as_of(), "facts")).select(
        F.lit("facts").alias("tier"), F.col("fact_id").alias("id")
    )
    later = F.lit("2024-07-15").cast("timestamp")
    eps = d.episodes(spark, sf).withColumn("superseded_by", F.lit(None).cast("bigint"))
    old = eps.filter(lifecycle.is_hard_pruned(later, "episodes")).select(
        F.lit("episodes").alias("tier"), F.col("episode_id").alias("id")
    )
    return gone.unionByName(old)


def touches(spark, sf):
    """Confirmations of facts, one per event."""
    n = d.table(spark, sf, "documents").count()
    return d.tool_calls(spark, sf).select(
        (F.col("event_id") * 7 % n).alias("fact_id"), F.col("tool").alias("source"), F.col("ts").alias("at"),
        F.col("event_id").alias("rating_id"), (1 + F.col("k") % 5).alias("rating"),
    )


TOUCH = f"""{d.TOOL_CALLS}, touch AS (SELECT event_id * 7 % (SELECT count(*) FROM documents) AS fact_id, tool AS source, ts AS tm, event_id AS rating_id, 1 + k % 5 AS rating FROM calls)"""


@query("reinforce", "LIF13", f"""WITH {d.FACTS}, {TOUCH}, c AS (SELECT fact_id, count(*) AS n, max(tm) AS tm FROM touch GROUP BY ALL),
s AS (SELECT fact_id, source, min(tm) AS f FROM touch GROUP BY ALL),
l AS (SELECT fact_id, string_agg(source, ',' ORDER BY f) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY f DESC) AS r FROM s) WHERE r <= 10 GROUP BY ALL)
SELECT fact_id, CASE WHEN superseded_by IS NULL THEN coalesce(sources, '') ELSE '' END AS sources, source_count + CASE WHEN superseded_by IS NULL THEN coalesce(n, 0) ELSE 0 END AS source_count,
  1 + CASE WHEN superseded_by IS NULL THEN coalesce(n, 0) ELSE 0 END AS version,
  epoch_us(CASE WHEN superseded_by IS NULL AND n IS NOT NULL THEN c.tm ELSE last_confirmed_ts END) AS confirmed
FROM facts LEFT JOIN c USING (fact_id) LEFT JOIN l USING (fact_id)""")
def reinforce(spark, sf):
    out = lifecycle.reinforce(d.facts(spark, sf), touches(spark, sf))
    return out.select(
        "fact_id", F.array_join("sources", ",").alias("sources"), "source_count", F.col("version").cast("bigint").alias("version"),
        F.unix_micros("last_confirmed_ts").alias("confirmed"),
    )


@query("feedback_apply", "LIF14", f"""WITH {d.FACTS}, {TOUCH},
h AS (SELECT fact_id, list(rating::DOUBLE ORDER BY tm, rating_id) AS r, arg_max(rating, tm) AS user_rating, max(CASE WHEN rating >= 4 THEN tm END) AS up_at,
  count(*) FILTER (rating >= 4) AS up, bool_or(rating <= 2) AS low FROM touch GROUP BY ALL)
SELECT fact_id, round(coalesce(list_reduce(list_prepend(importance, r), lambda x, y: CASE WHEN y >= 4 THEN least(1.0, x * 1.2) WHEN y <= 2 THEN greatest(0.05, x * 0.7) ELSE x END), importance), 6) AS importance,
  user_rating, coalesce(low, false) AS needs_review, source_count + CASE WHEN superseded_by IS NULL THEN coalesce(up, 0) ELSE 0 END AS source_count
FROM facts LEFT JOIN h USING (fact_id)""")
def feedback_apply(spark, sf):
    out = lifecycle.apply_feedback(d.facts(spark, sf), touches(spark, sf), F.date_trunc("day", "at"))
    return out.select("fact_id", F.round("importance", 6).alias("importance"), "user_rating", "needs_review", "source_count")


@query("feedback_variant", "LIF15", f"""WITH {d.FACTS}, {TOUCH} SELECT rating_id, fact_id, round(greatest(0, least(1, importance *
  CASE rating_id % 4 WHEN 0 THEN 0.5 + rating / 5.0 WHEN 1 THEN 1.2 WHEN 2 THEN 0.7 ELSE 1.0 END)), 4) AS importance FROM touch JOIN facts USING (fact_id)""")
def feedback_variant(spark, sf):
    kind = F.element_at(F.array(*[F.lit(v) for v in ("rating", "useful", "not_useful", "other")]), (F.col("rating_id") % 4 + 1).cast("int"))
    rows = touches(spark, sf).join(d.facts(spark, sf), "fact_id")
    return rows.select(
        "rating_id", "fact_id", F.round(decay.rated_importance(F.col("importance"), F.col("rating"), kind), 4).alias("importance")
    )


@query("pin", "LIF16", f"""WITH {d.FACTS} SELECT fact_id, fact_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS pinned,
  CASE WHEN fact_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1.0 ELSE importance END AS importance FROM facts""")
def pin(spark, sf):
    ids = d.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("fact_id"))
    return lifecycle.pin(d.facts(spark, sf), ids).select("fact_id", "pinned", "importance")


STATS = f"""r AS (SELECT superseded_by, category, {CONF} AS c FROM facts),
k AS (SELECT CASE WHEN superseded_by IS NULL THEN 'active' ELSE 'superseded' END AS status,
  CASE WHEN superseded_by IS NULL THEN CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' WHEN c >= 0.1 THEN 'low' ELSE 'expired' END END AS band,
  CASE WHEN superseded_by IS NOT NULL THEN 'merged' END AS reason, CASE WHEN superseded_by IS NULL THEN category END AS category, c FROM r)
SELECT 'total' AS kind, 'all' AS value, count(*) AS n, NULL::DOUBLE AS mean_confidence FROM k
UNION ALL SELECT 'status', status, count(*), NULL FROM k GROUP BY 2
UNION ALL SELECT 'band', band, count(*), NULL FROM k WHERE band IS NOT NULL GROUP BY 2
UNION ALL SELECT 'reason', reason, count(*), NULL FROM k WHERE reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'category', category, count(*), round(avg(c), 4) FROM k WHERE category IS NOT NULL GROUP BY 2"""


@query("lifecycle_stats", "LIF17", f"WITH {d.FACTS}, {STATS}")
def lifecycle_stats(spark, sf):
    return lifecycle.lifecycle_stats(d.facts(spark, sf), d.as_of())


PAIRS = """vecs AS (SELECT min(vec_id) AS id, count(*) AS copies, embedding FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings) GROUP BY embedding),
pairs AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.embedding, b.embedding) AS cosine, a.copies AS copies_a, b.copies AS copies_b
  FROM vecs a JOIN vecs b ON a.id < b.id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.35)"""


@query("similar_pairs", "SIM1", f"WITH {PAIRS} SELECT a, b, round(cosine, 4) AS cosine, copies_a, copies_b FROM pairs")
def similar_pairs(spark, sf):
    """Pairs of distinct vectors, with the number of rows that hold each."""
    e = d.embeddings(spark, sf)
    pairs = similarity.similar_pairs(e, 0.35, "vec_id", distinct=True)
    copies = similarity.fold_equal(e, "vec_id", "embedding").select("id", "copies")
    a = copies.select(F.col("id").alias("a"), F.col("copies").alias("copies_a"))
    b = copies.select(F.col("id").alias("b"), F.col("copies").alias("copies_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.round("cosine", 4).alias("cosine"), "copies_a", "copies_b")


NEAR = """near AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL
  SELECT vec_id + 1000000, list_transform(embedding::DOUBLE[], lambda x, i: x + (vec_id % 5 + 1) * 0.125 * embedding[(i + 6) % len(embedding) + 1]) FROM embeddings)"""


@query("banded_pairs_recall", "SIM1", f"""WITH {NEAR} SELECT count(*) AS exact_pairs, true AS recall_reached, true AS all_exact
FROM near a JOIN near b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.85""")
def banded_pairs_recall(spark, sf):
    """The join by bands against the exact one, over vectors and mixtures of each with its own shifted self."""
    e = d.embeddings(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    own = e.select(F.col("vec_id").alias("id"), "v")
    shifted = F.transform("v", lambda x, i: x + (F.col("vec_id") % 5 + 1) * 0.125 * F.get("v", (i + 7) % F.size("v")))
    near = cut(own.unionByName(e.select((F.col("vec_id") + 1_000_000).alias("id"), shifted.alias("v"))))
    exact = cut(similarity.similar_pairs(near, 0.85, "id", "v").select("a", "b"))
    found = cut(similarity.banded_pairs(near, 0.85, "id", "v").select("a", "b"))
    counts = exact.agg(F.count(F.lit(1)).alias("exact_pairs"))
    share = found.join(exact, ["a", "b"], "left_semi").agg(F.count(F.lit(1)).alias("n"))
    wrong = found.join(exact, ["a", "b"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("exact_pairs", (share.scalar() >= 0.95 * F.col("exact_pairs")).alias("recall_reached"), (wrong.scalar() == 0).alias("all_exact"))


FACT_PAIRS = f"""{d.FACT_VECTORS}, act AS MATERIALIZED (SELECT * FROM fact_vectors WHERE superseded_by IS NULL),
cand AS MATERIALIZED (SELECT a.fact_id AS a, b.fact_id AS b, list_cosine_similarity(a.embedding, b.embedding) AS cosine, a.ts AS ta, b.ts AS tb
  FROM act a JOIN act b ON a.fact_id < b.fact_id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.35)"""
AFF = "cosine * exp(-0.03 * abs(epoch_us(ta) - epoch_us(tb)) / 86400000000.0)"


def active(spark, sf):
    return d.fact_vectors(spark, sf).filter("superseded_by IS NULL")


@query("merge_candidates", "LIF6", f"WITH {FACT_PAIRS} SELECT a, b, round(cosine, 4) AS cosine, round({AFF}, 4) AS affinity FROM cand WHERE {AFF} >= 0.35")
def merge_candidates(spark, sf):
    rows = active(spark, sf)
    out = lifecycle.merge_candidates(similarity.dated_pairs(rows, 0.35, lifecycle.affinity_value()), rows, threshold=0.35)
    return out.select("a", "b", F.round("cosine", 4).alias("cosine"), F.round("affinity", 4).alias("affinity"))


AGE_F = f"(0.5 + least({days_sql('ta')}, {days_sql('tb')}) * 86400 / greatest({days_sql('ta')} * 86400, {days_sql('tb')} * 86400, 1) * 0.5)"


@query("merge_candidates_by_age", "LIF7", f"WITH {FACT_PAIRS} SELECT a, b, round(cosine * {AGE_F}, 4) AS combined FROM cand WHERE cosine * {AGE_F} >= 0.35")
def merge_candidates_by_age(spark, sf):
    rows = active(spark, sf)
    now = spark.range(1).select(F.unix_micros(d.as_of())).first()[0]
    out = lifecycle.merge_candidates_by_age(similarity.dated_pairs(rows, 0.35, lifecycle.age_value(now)), rows, d.as_of(), threshold=0.35)
    return out.select("a", "b", F.round("combined", 4).alias("combined"))


def greedy_sql(nodes: str, pairs: str, order: str) -> str:
    """One sequential pass in priority order, as a recursive query over ``nodes`` (id) and ``pairs`` (a, b)."""
    return f"""adj AS MATERIALIZED (SELECT id, list(o) AS near FROM (SELECT a AS id, b AS o FROM {pairs} UNION ALL SELECT b, a FROM {pairs}) GROUP BY id),
ord AS MATERIALIZED (SELECT n.id, row_number() OVER (ORDER BY {order}) AS pos, coalesce(near, []) AS near FROM {nodes} n LEFT JOIN adj ON adj.id = n.id),
run(pos, keepers) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT o.pos, CASE WHEN list_has_any(o.near, r.keepers) THEN r.keepers ELSE list_append(r.keepers, o.id) END FROM run r JOIN ord o ON o.pos = r.pos + 1),
kept AS (SELECT unnest(keepers) AS id FROM run WHERE pos = (SELECT max(pos) FROM ord)),
chosen AS (SELECT o.id, CASE WHEN o.id IN (SELECT id FROM kept) THEN o.id ELSE
  (SELECT arg_min(k.id, k.pos) FROM ord k WHERE k.id IN (SELECT id FROM kept) AND list_contains(o.near, k.id)) END AS keeper_id FROM ord o)"""


CLUSTER = f"""WITH RECURSIVE {FACT_PAIRS}, edge AS MATERIALIZED (SELECT a, b FROM cand WHERE {AFF} >= 0.35), nodes AS (SELECT fact_id AS id, importance, ts FROM act),
{greedy_sql('nodes', 'edge', 'importance DESC, ts DESC, n.id')}"""


@query("merge_clusters", "LIF8", f"{CLUSTER} SELECT id, keeper_id FROM chosen")
def merge_clusters(spark, sf):
    rows = cut(active(spark, sf).select(F.col("fact_id").alias("id"), "importance", "ts", F.col("embedding").alias("vec")))

    def pairs(one_each):
        return lifecycle.merge_candidates(similarity.dated_pairs(one_each, 0.35, lifecycle.affinity_value(), "id", "vec"), one_each, threshold=0.35)

    return lifecycle.choose_keepers_by_vector(rows, ["importance", "ts"], pairs, ["ts"])


@query("merged_rows", "LIF9", f"""{CLUSTER} SELECT keeper_id, count(*) AS consolidated_from, max(access_count) AS access_count, max(importance) AS importance,
  sum(source_count)::BIGINT AS source_count, arg_min(content, -length(content) * 100000000 + fact_id) AS content FROM chosen JOIN facts ON fact_id = id GROUP BY keeper_id HAVING count(*) > 1""")
def merged_rows(spark, sf):
    keepers = merge_clusters(spark, sf)
    return lifecycle.merged_rows(d.facts(spark, sf), keepers, d.as_of()).select(
        "keeper_id", "consolidated_from", "access_count", "importance", "source_count", "content"
    )


AGED_CLUSTER = f"""WITH RECURSIVE {FACT_PAIRS}, edge AS MATERIALIZED (SELECT a, b FROM cand WHERE {AFF} >= 0.35),
nodes AS (SELECT fact_id AS id, {AGED} AS importance, ts FROM act),
{greedy_sql('nodes', 'edge', 'importance DESC, ts DESC, n.id')},
res AS (SELECT c.id, c.keeper_id, {AGED} AS imp, importance AS own, {CONF} AS conf FROM chosen c JOIN act f ON f.fact_id = c.id)"""


@query("consolidation_report", "LIF18", f"""{AGED_CLUSTER} SELECT count(*) AS total_before, count(*) FILTER (imp <> own) AS decayed,
  (SELECT count(*) FROM (SELECT keeper_id FROM res GROUP BY 1 HAVING count(*) > 1)) AS merged,
  count(*) FILTER (id <> keeper_id) AS superseded, count(*) FILTER (id = keeper_id AND (imp < 0.05 OR conf < 0.1)) AS pruned,
  count(*) FILTER (id = keeper_id AND NOT (imp < 0.05 OR conf < 0.1)) AS total_after FROM res""")
def consolidation_report(spark, sf):
    return consolidate(d.fact_vectors(spark, sf), d.as_of(), threshold=0.35).report


CONSOLIDATED = f"""{AGED_CLUSTER}, every AS (SELECT f.*, e.entities, 1 + f.fact_id % 3 AS version FROM fact_vectors f JOIN fact_entities e USING (fact_id)),
own AS (SELECT e.*, r.keeper_id, r.imp, r.conf FROM every e JOIN res r ON r.id = e.fact_id),
taken AS (SELECT keeper_id, count(*) AS consolidated_from, arg_min(content, -length(content) * 100000000 + fact_id) AS content, arg_min(embedding, -length(content) * 100000000 + fact_id) AS embedding,
  max(access_count) AS access_count, max(imp) AS importance, sum(source_count)::BIGINT AS source_count, max(version) + 1 AS version FROM own GROUP BY keeper_id HAVING count(*) > 1),
united AS (SELECT keeper_id, list_sort(list_distinct(flatten(list(entities))))[1:5] AS entities FROM own GROUP BY keeper_id)
SELECT o.fact_id, coalesce(t.version, o.version) AS version, sha256(coalesce(t.content, o.content)) AS content, round(coalesce(t.embedding, o.embedding)[1], 4) AS first_coordinate,
  coalesce(t.access_count, o.access_count) AS access_count, round(coalesce(t.importance, o.imp), 4) AS importance, coalesce(t.source_count, o.source_count) AS source_count,
  t.consolidated_from, CASE WHEN t.keeper_id IS NULL THEN epoch_ms(o.last_confirmed_ts) ELSE epoch_ms(TIMESTAMP '{d.AS_OF}') END AS last_confirmed, array_to_string(CASE WHEN t.keeper_id IS NULL THEN o.entities ELSE u.entities END, '|') AS entities,
  CASE WHEN o.keeper_id <> o.fact_id THEN o.keeper_id::VARCHAR WHEN o.imp < 0.05 OR o.conf < 0.1 THEN 'pruned' END AS superseded_by,
  CASE WHEN o.keeper_id <> o.fact_id THEN 'merged' WHEN o.imp < 0.05 THEN 'pruned' WHEN o.conf < 0.1 THEN 'confidence_expired' END AS superseded_reason
FROM own o LEFT JOIN taken t ON t.keeper_id = o.fact_id LEFT JOIN united u ON u.keeper_id = o.fact_id
UNION ALL SELECT fact_id, version, sha256(content), round(embedding[1], 4), access_count, round(importance, 4), source_count, NULL, epoch_ms(last_confirmed_ts), array_to_string(entities, '|'), superseded_by::VARCHAR, NULL FROM every WHERE superseded_by IS NOT NULL"""


@query("consolidated_facts", "LIF18 LIF9 LIF10", CONSOLIDATED.replace(f"WITH RECURSIVE {d.FACT_VECTORS}", f"WITH RECURSIVE {d.FACT_ENTITIES}, {d.FACT_VECTORS.removeprefix(d.FACTS).removeprefix(', ')}"))
def consolidated_facts(spark, sf):
    """All rows of the version that a consolidation pass writes."""
    rows = d.fact_vectors(spark, sf).withColumn("version", 1 + F.col("fact_id") % 3).join(d.fact_entities(spark, sf).select("fact_id", "entities"), "fact_id")
    return consolidate(rows, d.as_of(), threshold=0.35).facts.select(
        "fact_id", "version", F.sha2("content", 256).alias("content"), F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first_coordinate"),
        "access_count", F.round("importance", 4).alias("importance"), "source_count", "consolidated_from", F.unix_millis("last_confirmed_ts").alias("last_confirmed"),
        F.array_join("entities", "|").alias("entities"), "superseded_by", "superseded_reason",
    )


PROC_PAIRS = f"""{d.PROCEDURE_VECTORS}, edge AS MATERIALIZED (SELECT a.proc_id AS a, b.proc_id AS b FROM procedure_vectors a JOIN procedure_vectors b
  ON a.proc_id < b.proc_id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.92), nodes AS (SELECT proc_id AS id, success_count FROM procedures)"""


@query("procedure_dedup", "LIF19", f"WITH RECURSIVE {PROC_PAIRS}, {greedy_sql('nodes', 'edge', 'success_count DESC, n.id')} SELECT id AS proc_id, keeper_id FROM chosen")
def procedure_dedup(spark, sf):
    rows = cut(d.procedure_vectors(spark, sf).select(F.col("proc_id").alias("id"), "success_count", F.col("embedding").alias("vec")))
    pairs = lambda one_each: similarity.similar_pairs(one_each, 0.92, "id", "vec")
    return lifecycle.choose_keepers_by_vector(rows, ["success_count"], pairs).withColumnRenamed("id", "proc_id")


@query("approximate_knn_recall", "VEC2", None)
def approximate_knn_recall(spark, sf):
    """Share of the exact ten nearest that the cell search finds, per query."""
    from keepsake.operators import vectors

    corpus, q = active(spark, sf), d.query_vectors(spark, sf)
    exact = vectors.knn(corpus, q, 10).select("query_id", "fact_id")
    near = similarity.approximate_knn(corpus, q, 10, probe=12, n_cells=24).select("query_id", "fact_id")
    found = near.join(exact, ["query_id", "fact_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(found, "query_id", "left").select(
        "query_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall")
    )


# ---------------------------------------------------------------- selections


@query("point_lookup", "SEL3", f"""WITH {d.FACTS}, {d.EPISODES}, ids AS (SELECT doc_id AS id FROM labels UNION SELECT conv_id * 1000 FROM conversations),
u AS (SELECT fact_id AS id, 1 AS tier, content FROM facts UNION ALL SELECT episode_id, 2, content FROM episodes)
SELECT id, min(tier) AS tier, arg_min(length(content), tier) AS chars FROM u WHERE id IN (SELECT id FROM ids) GROUP BY id""")
def point_lookup(spark, sf):
    """Ids looked up in the facts, else in the episodes."""
    ids = d.table(spark, sf, "labels").select(F.col("doc_id").alias("id")).union(
        d.table(spark, sf, "conversations").select((F.col("conv_id") * 1000).alias("id"))
    ).distinct()
    both = d.facts(spark, sf).select(F.col("fact_id").alias("id"), F.lit(1).alias("tier"), "content").unionByName(
        d.episodes(spark, sf).select(F.col("episode_id").alias("id"), F.lit(2).alias("tier"), "content")
    )
    hit = both.join(ids, "id", "left_semi")
    return hit.groupBy("id").agg(
        F.min("tier").alias("tier"), F.min_by(F.length("content").cast("bigint"), "tier").alias("chars")
    )


@query("list_memories", "SEL4", f"WITH {d.FACTS} SELECT fact_id, category, epoch_ms(ts) AS ts FROM facts WHERE category = 'decision' ORDER BY ts DESC, fact_id LIMIT 50")
def list_memories(spark, sf):
    """The newest fifty of one category."""
    rows = d.facts(spark, sf).filter("category = 'decision'")
    return rows.orderBy(F.desc("ts"), "fact_id").limit(50).select("fact_id", "category", F.unix_millis("ts").alias("ts"))


@query("delete_by_content", "SEL10", f"WITH {d.FACTS} SELECT fact_id, contains(lower(content), 'license') AS deleted FROM facts")
def delete_by_content(spark, sf):
    """Each fact with the mark whether the content pattern removes it."""
    return d.facts(spark, sf).select("fact_id", F.lower("content").contains("license").alias("deleted"))


@query("delete_by_similarity", "SEL11", f"""WITH {d.FACT_VECTORS}, {d.QUERY_VECTORS}, hits AS (SELECT * FROM (SELECT q.query_id, f.fact_id,
   row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.embedding, f.embedding) DESC, f.fact_id) AS r
   FROM query_vectors q JOIN fact_vectors f ON f.superseded_by IS NULL) WHERE r <= 3)
SELECT fact_id FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM hits)""")
def delete_by_similarity(spark, sf):
    """Facts that remain after the three nearest of every query are removed."""
    from keepsake.operators import vectors

    hits = vectors.knn(active(spark, sf), d.query_vectors(spark, sf), 3)
    return d.facts(spark, sf).join(hits, "fact_id", "left_anti").select("fact_id")


@query("memory_import", "SRC10", """SELECT doc_id AS fact_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'fact') AS category,
  0.7::DOUBLE AS confidence, 0.5::DOUBLE AS importance FROM documents WHERE length(text) > 0""")
def memory_import(spark, sf):
    from keepsake.sources.exchange import import_facts

    rows = d.table(spark, sf, "documents").select(
        F.col("doc_id").alias("fact_id"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("category"),
    )
    return import_facts(rows).select("fact_id", "category", "confidence", "importance")


JACCARD = """w AS (SELECT min(doc_id) AS id, words FROM (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS words FROM documents)
  WHERE len(words) > 0 GROUP BY words),
t AS (SELECT id, len(words) AS n, unnest(words) AS word FROM w),
c AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM t a JOIN t b ON a.word = b.word AND a.id < b.id GROUP BY ALL)"""


@query("jaccard_pairs", "SIM2", f"WITH {JACCARD} SELECT a, b, round(shared / (na + nb - shared), 4) AS jaccard FROM c WHERE shared / (na + nb - shared) >= 0.6")
def jaccard_pairs(spark, sf):
    from keepsake.operators.wordsets import jaccard_pairs as run

    docs = d.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tx.word_set(F.col("text")).alias("words"))
    return run(docs, 0.6).select("a", "b", F.round("jaccard", 4).alias("jaccard"))
