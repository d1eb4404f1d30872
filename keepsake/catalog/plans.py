"""Registered queries: the recall plan, packing and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.catalog import derived as d
from keepsake.catalog import recall as rc
from keepsake.catalog.graph_tools import edges_of
from keepsake.catalog.messages import redact_sql
from keepsake.catalog.registry import query
from keepsake.functions import text as tx
from keepsake.operators import lexical, packing, ranking, tools, vectors
from keepsake.plans import recall as plan
from keepsake.session import cut


def requests(spark, sf):
    """Recall requests with named-entity and time marks."""
    named = F.size(tx.all_matches(F.col("text"), tx.CAPITALISED)) > 3
    return d.query_vectors(spark, sf).withColumn("has_entities", named).withColumn("has_time", F.col("query_id") % 3 == 0)


WANT = rf"""want AS (SELECT query_id, text, language, domain, embedding, greatest(1, floor(greatest(1, memory_limit // 2) * (1 + 0.8 * c)))::BIGINT AS n_facts FROM (SELECT *, least(1.0::DOUBLE,
   len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 30.0::DOUBLE + len(list_filter(regexp_extract_all(lower(text), '{rc.WORDS}'), lambda w: regexp_full_match(w, '{tx.COMPLEX_SIGNALS}'))) * 0.2::DOUBLE) AS c FROM query_vectors))"""

RANKED = f"""{rc.BASE}, {rc.BM25}, {rc.BM_SEARCH}, {WANT}, {rc.QW.replace('qw AS', 'qw0 AS')}, qw AS (SELECT * FROM qw0),
sc0 AS (SELECT q.query_id, f.fact_id, {rc.COSINE} AS cosine, n_facts, row_number() OVER (PARTITION BY q.query_id ORDER BY {rc.COSINE} DESC, f.fact_id) AS r FROM want q JOIN fact_vectors f ON f.superseded_by IS NULL AND {rc.SCENE_SQL}),
sc AS (SELECT * FROM sc0 WHERE r <= n_facts), cnt AS (SELECT w.query_id, w.n_facts - count(s.fact_id) AS gap FROM want w LEFT JOIN sc s USING (query_id) GROUP BY w.query_id, w.n_facts),
gl0 AS (SELECT q.query_id, f.fact_id, {rc.COSINE} AS cosine, row_number() OVER (PARTITION BY q.query_id ORDER BY {rc.COSINE} DESC, f.fact_id) AS r FROM want q JOIN fact_vectors f ON f.superseded_by IS NULL),
gl AS (SELECT gl0.* FROM gl0 JOIN cnt USING (query_id) WHERE r <= gap),
vl AS (SELECT query_id, fact_id, cosine, 1 AS list_no FROM sc UNION ALL SELECT query_id, fact_id, cosine, 2 FROM gl),
vh AS (SELECT query_id, list_no, fact_id, f.content, greatest(0, (1 + cosine) / 2) * {rc.HEAT} AS h FROM vl JOIN facts f USING (fact_id)),
ls AS (SELECT query_id, list_no, fact_id, content, row_number() OVER (PARTITION BY query_id, list_no ORDER BY round(h, 12) DESC, fact_id) AS rank FROM vh
  UNION ALL SELECT b.query_id, 4, b.fact_id, f.content, b.rank FROM bm_hits b JOIN facts f USING (fact_id) JOIN want USING (query_id) WHERE b.rank <= n_facts),
wl AS (SELECT l.*, w[list_no] AS weight FROM ls l JOIN qw USING (query_id)), {rc.fuse_sql('weight', 1000, source='wl')},
fz AS (SELECT z.query_id, z.fact_id, z.content, rrf, n_facts, text FROM fused z JOIN want USING (query_id) WHERE rank <= n_facts),
bo AS (SELECT z.query_id, z.fact_id, f.session_id, n_facts, z.content, rrf + 0.06::DOUBLE * {rc.boost_sql('z.text', 'z.content')} + 0.15::DOUBLE * f.importance AS score FROM fz z JOIN facts f USING (fact_id)),
dv AS (SELECT *, row_number() OVER (PARTITION BY query_id, session_id ORDER BY round(score, 12) DESC, fact_id) AS s FROM bo),
final AS (SELECT query_id, fact_id, content, score, n_facts, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, fact_id) AS rank FROM dv WHERE s <= 3)"""


@query("hybrid_recall", "REC1 REC2 FUS1 FUS2 BM5 FUS4 FUS5", f"{RANKED} SELECT query_id, fact_id, round(score * 1e9)::BIGINT AS score_e9, rank FROM final")
def hybrid_recall(spark, sf):
    """Fused and boosted facts for every request, scene first."""
    facts = cut(d.fact_vectors(spark, sf))
    memory = plan.Memory(facts, index=lexical.build_index(d.facts(spark, sf)))
    q = cut(plan.prepare(requests(spark, sf)))
    return plan.rank_facts(memory, q, d.as_of()).select(
        "query_id", "fact_id", F.round(F.col("score") * 1e9).cast("bigint").alias("score_e9"), F.col("rank").cast("bigint").alias("rank")
    )


@query("recall_context", "REC1 PCK1 GR7 GR8 FUS7 TL3", None)
def recall_context(spark, sf):
    """The whole recall: ranked facts and episodes, graph and bridge facts, tools, skills, packed into the budget."""
    facts = d.fact_vectors(spark, sf).join(d.fact_entities(spark, sf).select("fact_id", "entities"), "fact_id")
    e = d.embeddings(spark, sf).select("vec_id", "embedding")
    n = e.count()
    registry = d.tools(spark, sf).withColumn("vec_id", F.col("suppkey") * 13 % n).join(e, "vec_id").withColumn(
        "category", F.lit("general")
    ).withColumn("capability_summary", F.lit(""))
    memory = plan.Memory(
        facts=cut(facts),
        episodes=cut(d.episode_vectors(spark, sf)),
        index=lexical.build_index(d.facts(spark, sf)),
        edges=cut(edges_of(spark, sf)),
        persona="## User Profile\n- name: owner",
        pinned="Closed the last open order.",
        contexts=d.messages(spark, sf).select(F.concat(F.lit("src"), F.col("session_id") % 10).alias("session_id"), "seq", "content").groupBy("session_id").agg(F.max_by("content", F.struct("seq", "content")).alias("context")),
        tools=registry,
        tool_graph=tools.transitions(d.tool_calls(spark, sf), F.date_trunc("day", "ts")),
        procedures=d.procedure_vectors(spark, sf),
    )
    return plan.recall(memory, requests(spark, sf), d.as_of()).context


@query("append_extra_hits", "FUS7", f"""{rc.BASE}, {rc.BM25}, {rc.BM_SEARCH}, {rc.knn_sql(5)}, rk AS (SELECT query_id, fact_id, content, rank FROM hits JOIN facts USING (fact_id)),
ex AS (SELECT b.query_id, b.fact_id, content, b.rank AS er FROM bm_hits b JOIN facts f USING (fact_id)),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY er, fact_id) AS o FROM ex WHERE (query_id, content) NOT IN (SELECT query_id, content FROM rk)) WHERE o = 1)
SELECT query_id, fact_id, rank FROM rk UNION ALL SELECT query_id, fact_id, rank FROM (SELECT query_id, fact_id, 5 + row_number() OVER (PARTITION BY query_id ORDER BY er, fact_id) AS rank FROM fr) WHERE rank <= 8""")
def append_extra_hits(spark, sf):
    corpus, q = rc.active_vectors(spark, sf), d.query_vectors(spark, sf)
    ranked = vectors.attach(vectors.knn(corpus, q, 5), corpus, ["content"]).withColumn("n_limit", F.lit(5))
    bm = lexical.search(lexical.build_index(d.facts(spark, sf)), q, 10).withColumnRenamed("doc_id", "fact_id")
    extra = vectors.attach(bm, corpus, ["content"]).select("query_id", "fact_id", "content", F.col("rank").alias("extra_rank"))
    out = ranking.append_extra(ranked, extra, 3)
    return out.select("query_id", "fact_id", F.col("rank").cast("bigint").alias("rank"))


def words_sql(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


LINES = f"""{rc.BASE}, {rc.knn_sql(10)},
raw AS (SELECT query_id, 0 AS section, 0 AS line_no, 'head' AS kind, '## User Profile' || chr(10) || '- domain: ' || domain AS text FROM queries UNION ALL SELECT query_id, 0, 1000000, 'end', '' FROM queries
  UNION ALL SELECT query_id, 6, -1, 'head', '## Current Session Context' FROM queries UNION ALL SELECT query_id, 6, 0, 'item', text FROM queries UNION ALL SELECT query_id, 6, 1000000, 'end', '' FROM queries
  UNION ALL SELECT query_id, 7, -1, 'head', '## Long-Term Memory (Facts)' FROM queries UNION ALL SELECT query_id, 7, 1000000, 'end', '' FROM queries
  UNION ALL SELECT query_id, 7, rank, 'item', rank || '. [' || category || '] (topic:' || domain || ') ' || content FROM hits JOIN facts USING (fact_id)),
red AS (SELECT * EXCLUDE (text), {redact_sql('text')} AS text FROM raw),
ln AS (SELECT *, {words_sql('text')} AS cost, row_number() OVER (PARTITION BY query_id ORDER BY section, line_no) AS i FROM red),
run(query_id, i, used, items, begun, open, body) AS (SELECT query_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, false, []::VARCHAR[] FROM queries UNION ALL
  SELECT r.query_id, l.i, CASE WHEN (kind = 'head' AND fits) OR (kind = 'item' AND open AND fits) THEN used + cost ELSE used END, CASE WHEN kind = 'item' AND open AND fits THEN items + 1 ELSE items END,
    CASE kind WHEN 'head' THEN fits WHEN 'end' THEN false ELSE begun END, CASE kind WHEN 'head' THEN fits WHEN 'item' THEN open AND fits ELSE false END,
    CASE WHEN (kind = 'head' AND fits) OR (kind = 'item' AND open AND fits) OR (kind = 'end' AND begun) THEN list_append(body, text) ELSE body END
  FROM (SELECT r.*, l.i AS li, l.kind, l.text, l.cost, r.used + l.cost <= 60 + 40 * (r.query_id % 10) AS fits FROM run r JOIN ln l ON l.query_id = r.query_id AND l.i = r.i + 1) r, LATERAL (SELECT r.li AS i) l)"""


@query("budget_pack", "PCK1 MSG10", LINES.replace("WITH ", "WITH RECURSIVE ", 1) + r""" SELECT query_id, used AS tokens, items, CASE WHEN b <> '' THEN '<cross_session_memory>' || chr(10) || 'The following is relevant context from long-term memory.' || chr(10)
  || 'Use it to inform your responses but do not repeat it verbatim.' || chr(10) || chr(10) || b || chr(10) || '</cross_session_memory>' ELSE '' END AS context
FROM (SELECT *, regexp_replace(array_to_string(body, chr(10)), '^\s+|\s+$', '', 'g') AS b FROM run WHERE i = (SELECT max(i) FROM ln WHERE ln.query_id = run.query_id))""")
def budget_pack(spark, sf):
    """Profile, session text and the ten nearest facts under budgets of 60 to 420 tokens."""
    q, corpus = d.query_vectors(spark, sf), rc.active_vectors(spark, sf)
    hits = vectors.attach(vectors.knn(corpus, q, 10), corpus, ["content", "category", "domain"])
    blank = F.array().cast("array<string>")
    fact = packing.fact_line(F.col("rank"), F.col("category"), F.col("content"), blank, blank, F.col("domain"), F.lit(""))
    lines = (
        packing.section(q, "persona", 0, F.concat(F.lit("## User Profile\n- domain: "), "domain"))
        .unionByName(packing.section(q, "session", 0, F.col("text")))
        .unionByName(packing.section(hits, "facts", "rank", fact))
    )
    return packing.pack(lines, q.select("query_id", (60 + 40 * (F.col("query_id") % 10)).alias("token_budget")))


QUOTA = f"""{rc.BASE}, {rc.knn_sql(10)}, rq AS (SELECT query_id, 200 + 300 * (query_id % 8) AS budget, {words_sql('text')} AS s0, 4 AS p0, 6 AS g0 FROM queries),
b AS (SELECT *, CASE WHEN s0 <= budget * 0.3 THEN s0 ELSE 0 END AS s FROM rq), b2 AS (SELECT *, CASE WHEN s + p0 <= budget * 0.2 THEN p0 ELSE 0 END AS p FROM b),
fs AS (SELECT query_id, sum({words_sql('content')}) OVER (PARTITION BY query_id ORDER BY rank) AS c FROM hits JOIN facts USING (fact_id)),
t AS (SELECT query_id, count(c) AS fact_count, coalesce(max(c), 0)::BIGINT AS f FROM b2 LEFT JOIN fs USING (query_id) WHERE c <= budget - s - p GROUP BY 1)"""


@query("quota_pack", "PCK2", f"""{QUOTA} SELECT query_id, coalesce(fact_count, 0) AS fact_count, s + p + coalesce(f, 0) + CASE WHEN s + p + coalesce(f, 0) + g0 <= budget THEN g0 ELSE 0 END AS total_tokens,
  round((s + p + coalesce(f, 0) + CASE WHEN s + p + coalesce(f, 0) + g0 <= budget THEN g0 ELSE 0 END) / budget, 4) AS utilization FROM b2 LEFT JOIN t USING (query_id)""")
def quota_pack(spark, sf):
    q, corpus = d.query_vectors(spark, sf), rc.active_vectors(spark, sf)
    hits = vectors.attach(vectors.knn(corpus, q, 10), corpus, ["content"])
    reqs = q.select(
        "query_id", (200 + 300 * (F.col("query_id") % 8)).alias("budget"), F.col("text").alias("session_ctx"),
        F.lit("the owner sells parts").alias("persona_ctx"), F.lit("one two three four five six").alias("graph_ctx"),
    )
    return packing.pack_by_quota(reqs, hits)


# ---------------------------------------------------------------- ingest

from keepsake.catalog import messages as mc  # noqa: E402
from keepsake.operators import admission  # noqa: E402
from keepsake.plans import ingest  # noqa: E402


def gate_sql(source: str) -> str:
    """Admission without stored episodes, for rows (key, text) of ``source``: the factors of the messages catalogue."""
    body = mc.FACTORS.replace("session_id, seq, 1 - best AS novelty", "key, 1.0::DOUBLE AS novelty").replace("FROM best)", f"FROM {source})")
    return body


WINDOW_TURNS = f"""{d.MESSAGES}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS pos FROM messages WHERE regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> ''),
wt AS (SELECT session_id || ':w' || (pos // 4) AS key, coalesce(string_agg(content, ' ' ORDER BY pos) FILTER (role = 'user'), '') AS text FROM p GROUP BY session_id, pos // 4 HAVING count(*) >= 2)"""


@query("ingest_outcomes", "SRC11 MSG9 ADM1", f"""WITH {WINDOW_TURNS}, {gate_sql('wt')}
SELECT key AS chunk_id, CASE WHEN text = '' THEN 'no_user_text' WHEN length(text) < 15 THEN 'trivial' WHEN score < 0.4 THEN 'gate' ELSE 'admitted' END AS outcome FROM wt JOIN adm USING (key)""")
def ingest_outcomes(spark, sf):
    """What becomes of each turn window when nothing is stored yet."""
    turns = ingest.turns(d.messages(spark, sf).withColumn("content", tx.strip(F.col("content"))))
    return ingest.gate(turns.withColumn("best", F.lit(None).cast("double"))).select("chunk_id", "outcome")


@query("ingest_run", "SRC11 ADM2 EXT5 EXT7 STR1", None)
def ingest_run(spark, sf):
    """The whole ingest of statements as messages: rows written per tier."""
    m = d.statements(spark, sf).select(
        "session_id", F.col("turn_id").alias("seq"), F.lit("user").alias("role"), F.col("text").alias("content"), "ts"
    )
    out = ingest.run(m, dims=64, min_messages=1)
    row = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tier"), "n")
    return (
        row(out.episodes, "episodes").unionByName(row(out.facts, "facts")).unionByName(row(out.procedures, "procedures")).unionByName(row(out.log, "log"))
    )


OBS = f"""ob AS (SELECT doc_id AS key, {redact_sql("'Tool: tool_' || (doc_id % 12) || chr(10) || 'Input: ' || source || chr(10) || 'Output: ' || text[1:4000]")} AS text FROM documents)"""


@query("observation_rows", "SRC12", f"""WITH {OBS}, {gate_sql('ob')} SELECT key AS observation_id, CASE WHEN score < 0.4 THEN 'skipped_gate' ELSE 'observed' END AS action, text AS content FROM ob JOIN adm USING (key)""")
def observation_rows(spark, sf):
    """Documents as tool outputs."""
    rows = d.table(spark, sf, "documents").select(
        F.col("doc_id").alias("observation_id"), F.concat(F.lit("tool_"), F.col("doc_id") % 12).alias("tool_name"),
        F.col("source").alias("tool_input"), F.col("text").alias("tool_output"), F.lit("post_tool_use").alias("hook_type"),
        F.lit(None).cast("double").alias("best"),
    )
    return ingest.observe(rows).select("observation_id", "action", "content")


@query("export_roundtrip", "SRC9 SRC10", f"""WITH {d.FACTS}, {d.EPISODES} SELECT 'facts' AS kind, fact_id AS id, length(content)::BIGINT AS chars FROM facts
UNION ALL SELECT 'episodes', episode_id, length(content)::BIGINT FROM episodes""")
def export_roundtrip(spark, sf):
    """Facts and episodes written as JSON, one folder per kind, and read back."""
    import uuid

    from keepsake.session import ensure_checkpoint_dir
    from keepsake.sources import exchange

    path = f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    facts, eps = d.facts(spark, sf), d.episodes(spark, sf)
    exchange.export(facts, eps, path)
    size = F.length("content").cast("bigint").alias("chars")
    back = lambda kind, df, key: exchange.read_export(spark, path, kind, df.schema).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), size)
    return back("facts", facts, "fact_id").unionByName(back("episodes", eps, "episode_id"))
