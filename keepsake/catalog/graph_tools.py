"""Registered queries: entity graph, tools and procedures."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.catalog import derived as d
from keepsake.catalog.messages import label_sql
from keepsake.catalog.recall import COSINE
from keepsake.catalog.registry import query
from keepsake.functions import scene
from keepsake.functions import text as tx
from keepsake.operators import graph, tools, vectors
from keepsake.session import cut


def slug_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '\s+', '_', 'g'), '[^\p{{L}}\p{{N}}_]', '', 'g')"


CO = f"""{d.FACT_ENTITIES}, ent AS (SELECT fact_id, ts, unnest(list_transform(entities, lambda x, i: {{'i': i, 's': {slug_sql('x')}}}), recursive := true) FROM fact_entities),
half AS (SELECT a.fact_id, a.ts, a.s AS x, b.s AS y FROM ent a JOIN ent b ON a.fact_id = b.fact_id AND a.i < b.i AND a.s <> b.s),
ev AS (SELECT x AS src, y AS dst, ts, fact_id::VARCHAR AS source FROM half UNION ALL SELECT y, x, ts, fact_id::VARCHAR FROM half),
edges AS (SELECT src, dst, 'related_to' AS type, 0.8::DOUBLE AS confidence, count(*) AS source_count, max(ts) AS last_seen FROM ev GROUP BY src, dst)"""


def events_of(spark, sf):
    return graph.cooccurrences(d.fact_entities(spark, sf))


def edges_of(spark, sf):
    return graph.upsert(events_of(spark, sf), with_sources=False)


@query("cooccur_edges", "GR3 GR2", f"WITH {CO} SELECT src, dst, source_count, epoch_ms(last_seen) AS last_seen FROM edges")
def cooccur_edges(spark, sf):
    return edges_of(spark, sf).select("src", "dst", "source_count", F.unix_millis("last_seen").alias("last_seen"))


PERSON_CO = CO.replace("FROM fact_entities)", "FROM (SELECT fact_id, ts, list_concat(['Person ' || (fact_id % 7), 'Person ' || (fact_id % 3)], entities) AS every, list_filter(every, lambda x, i: list_position(every, x) = i) AS entities FROM (SELECT fact_id, ts, entities FROM fact_entities)))", 1)


@query("cooccur_persons", "GR3", f"WITH {PERSON_CO} SELECT src, dst, source_count FROM edges")
def cooccur_persons(spark, sf):
    """Co-occurrence of the persons and entities of a fact."""
    named = lambda m: F.concat(F.lit("Person "), F.col("fact_id") % m)
    rows = d.fact_entities(spark, sf).withColumn("persons", F.array(named(7), named(3)))
    return graph.upsert(graph.cooccurrences(rows, persons="persons"), with_sources=False).select("src", "dst", "source_count")


@query("edge_upsert", "GR1", f"""WITH {CO}, s AS (SELECT src, dst, source, min(ts) AS a FROM ev GROUP BY ALL),
l AS (SELECT src, dst, string_agg(source, ',' ORDER BY a, source) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY a DESC, source DESC) AS r FROM s) WHERE r <= 5 GROUP BY ALL)
SELECT src, dst, type, source_count + (SELECT CASE WHEN src < dst THEN 2 ELSE 0 END) AS source_count, CASE WHEN src < dst THEN 'uses' ELSE type END AS first_type, sources FROM edges JOIN l USING (src, dst)""")
def edge_upsert(spark, sf):
    """New events merged into stored edges; half of the pairs were stored before as ``uses`` with count two."""
    ev = events_of(spark, sf)
    new = graph.upsert(ev)
    stored = ev.filter("src < dst").select("src", "dst").distinct().select(
        "src", "dst", F.lit("uses").alias("type"), F.lit(0.1).alias("confidence"), F.lit(2).cast("bigint").alias("source_count"),
        F.lit("2020-01-01").cast("timestamp").alias("last_seen"), F.array().cast("array<string>").alias("sources"),
    )
    merged = graph.upsert(ev, stored)
    return merged.join(new.select("src", "dst", F.col("type").alias("_t")), ["src", "dst"]).select(
        "src", "dst", F.col("_t").alias("type"), "source_count", F.col("type").alias("first_type"), F.array_join("sources", ",").alias("sources")
    )


TYPED = f"""t AS (SELECT c_name AS a, n_name AS b, 'uses' AS type, 0.9::DOUBLE AS conf, false AS both_ways FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_name, r_name, 'depends_on', 0.7, true FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, c_mktsegment, 'prefers', 0.6, false FROM customer),
d AS (SELECT a, b, type, conf FROM t UNION ALL SELECT b, a, type, conf FROM t WHERE both_ways),
te AS (SELECT {slug_sql('a')} AS src, {slug_sql('b')} AS dst,
  CASE WHEN type = 'prefers' THEN 'related_to' ELSE type END AS type, conf AS confidence FROM d)"""


def typed(spark, sf):
    c, n, r = (d.table(spark, sf, t) for t in ("customer", "nation", "region"))
    row = lambda df, a, b, kind, conf, both: df.select(
        F.col(a).alias("source_entity"), F.col(b).alias("target_entity"), F.lit(kind).alias("type"), F.lit(conf).alias("confidence"),
        d.as_of().alias("ts"), F.lit("load").alias("source"), F.lit(both).alias("bidirectional"),
    )
    rows = (
        row(c.join(n, c.c_nationkey == n.n_nationkey), "c_name", "n_name", "uses", 0.9, False)
        .unionByName(row(n.join(r, n.n_regionkey == r.r_regionkey), "n_name", "r_name", "depends_on", 0.7, True))
        .unionByName(row(c, "c_name", "c_mktsegment", "prefers", 0.6, False))
    )
    return graph.upsert(graph.typed_edges(rows), with_sources=False)


@query("typed_edges", "GR4", f"WITH {TYPED} SELECT src, dst, type, confidence, 1::BIGINT AS source_count FROM te")
def typed_edges(spark, sf):
    return typed(spark, sf).select("src", "dst", "type", "confidence", "source_count")


HOPS = f"""{TYPED}, u AS (SELECT * FROM te WHERE type IN ('uses', 'depends_on')), s AS (SELECT DISTINCT regexp_replace(lower(c_name), '[^a-z0-9_]', '', 'g') AS start FROM customer),
h1 AS (SELECT start, dst AS node, type AS edge_type, confidence, start || ' → ' || type || ' → ' || dst AS path FROM s JOIN u ON src = start),
c2 AS (SELECT start, dst AS node, u.type AS edge_type, least(h1.confidence, u.confidence) AS confidence, path || ' → ' || u.type || ' → ' || dst AS path FROM h1 JOIN u ON src = node),
h2 AS (SELECT start, node, arg_min(edge_type, path) AS edge_type, arg_min(confidence, path) AS confidence, min(path) AS path FROM c2 WHERE (start, node) NOT IN (SELECT start, node FROM h1) AND node <> start GROUP BY start, node),
c3 AS (SELECT start, dst AS node, u.type AS edge_type, least(h2.confidence, u.confidence) AS confidence, path || ' → ' || u.type || ' → ' || dst AS path FROM h2 JOIN u ON src = node),
h3 AS (SELECT start, node, arg_min(edge_type, path) AS edge_type, arg_min(confidence, path) AS confidence, min(path) AS path FROM c3
  WHERE (start, node) NOT IN (SELECT start, node FROM h1 UNION ALL SELECT start, node FROM h2) AND node <> start GROUP BY start, node)"""


@query("typed_traverse", "GR5", f"WITH {HOPS} SELECT *, 1 AS depth FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3")
def typed_traverse(spark, sf):
    """From every customer over three hops of two edge types."""
    starts = d.table(spark, sf, "customer").select(tx.slug(F.col("c_name")).alias("start"))
    return graph.traverse(typed(spark, sf), starts, 3, ["uses", "depends_on"])


ASKED = f"""asked AS (SELECT DISTINCT item_id AS query_id, e AS entity, {slug_sql('e')} AS start FROM (SELECT item_id, unnest({d.entities_sql('text')}) AS e FROM benchmark))"""


def asked_entities(spark, sf):
    return d.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.explode(tx.capitalised_entities(F.col("text"))).alias("entity")
    )


@query("k_hop", "GR6", f"""WITH {CO}, {ASKED}, st AS (SELECT DISTINCT start FROM asked), one AS (SELECT DISTINCT start, dst AS node FROM st JOIN edges ON src = start),
two AS (SELECT DISTINCT start, dst AS node FROM one JOIN edges ON src = node) SELECT * FROM (SELECT * FROM one UNION SELECT * FROM two) WHERE start <> node""")
def k_hop(spark, sf):
    starts = asked_entities(spark, sf).select(tx.slug(F.col("entity")).alias("start"))
    return graph.related(cut(edges_of(spark, sf).select("src", "dst")), starts, 2)


ENTITY_VECTORS = d.FACT_VECTORS.replace(d.FACTS, d.FACT_ENTITIES)
QV = d.QUERY_VECTORS
HITS24 = f"""hits AS (SELECT * FROM (SELECT q.query_id, f.fact_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {COSINE} DESC, f.fact_id) AS rank
    FROM query_vectors q JOIN fact_vectors f ON f.superseded_by IS NULL) WHERE rank <= 24),
full_hits AS (SELECT h.query_id, h.fact_id, h.rank, f.content, list_transform(f.entities, lambda x: lower(x)) AS ents,
  list_filter(list_distinct(regexp_split_to_array(lower(f.content), '\\s+')), lambda w: w <> '') AS words FROM hits h JOIN fact_entities f USING (fact_id))"""
CO_ONLY = CO[len(d.FACT_ENTITIES) + 2 :]


def hits_with_entities(spark, sf, k):
    from keepsake.catalog.recall import active_vectors

    hits = vectors.knn(active_vectors(spark, sf), d.query_vectors(spark, sf), k)
    return cut(vectors.attach(hits, d.fact_entities(spark, sf), ["content", "entities"]))


@query("entity_recall", "GR7", f"""WITH {ENTITY_VECTORS}, {QV}, {CO_ONLY}, {ASKED}, {HITS24},
near AS (SELECT DISTINCT a.query_id, a.entity, e.dst AS m FROM asked a JOIN edges e ON e.src = a.start),
mem AS (SELECT query_id, fact_id, rank, unnest(list_distinct(list_concat(ents, words))) AS m FROM full_hits WHERE rank <= 15),
ok AS (SELECT DISTINCT query_id, entity, fact_id, rank FROM mem JOIN near USING (query_id, m))
SELECT query_id, entity, fact_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entity ORDER BY rank) AS pos FROM ok) WHERE pos <= 5""")
def entity_recall(spark, sf):
    out = graph.entity_recall(hits_with_entities(spark, sf, 15), asked_entities(spark, sf), cut(edges_of(spark, sf)), 5)
    return out.select("query_id", "entity", "fact_id", F.col("pos").cast("bigint").alias("pos"))


STOPS = ", ".join(f"'{w}'" for w in graph.BRIDGE_STOP)


@query("bridge_facts", "GR8", f"""WITH {ENTITY_VECTORS}, {QV}, {CO_ONLY}, {HITS24},
term AS (SELECT * FROM full_hits WHERE rank <= 5), oth AS (SELECT * FROM full_hits o WHERE NOT EXISTS (SELECT 1 FROM term t WHERE t.query_id = o.query_id AND t.content = o.content)),
named AS (SELECT query_id, fact_id, unnest(ents) AS m FROM term),
ts AS (SELECT query_id, fact_id AS t, m FROM (SELECT query_id, fact_id, unnest(list_filter(list_distinct(list_concat(ents, words)), lambda w: length(w) >= 4 AND NOT list_contains([{STOPS}], w))) AS m FROM term)
  UNION SELECT query_id, fact_id, m FROM named),
six AS (SELECT query_id, {slug_sql('m')} AS start FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m) AS r FROM (SELECT DISTINCT query_id, m FROM named)) WHERE r <= 6),
around AS (SELECT DISTINCT query_id, dst AS m FROM six JOIN edges ON src = start),
cov AS (SELECT c.query_id, c.fact_id, c.rank, count(DISTINCT t) AS coverage FROM (SELECT query_id, fact_id, rank, unnest(list_distinct(list_concat(ents, words))) AS m FROM oth) c JOIN ts USING (query_id, m) GROUP BY ALL),
touch AS (SELECT DISTINCT query_id, fact_id FROM (SELECT query_id, fact_id, unnest(ents) AS m FROM oth) JOIN around USING (query_id, m))
SELECT query_id, fact_id, rank, coverage FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM cov
  WHERE coverage >= 2 OR (query_id, fact_id) IN (SELECT query_id, fact_id FROM touch)) WHERE pos <= 3""")
def bridge_facts(spark, sf):
    out = graph.bridges(hits_with_entities(spark, sf, 24), cut(edges_of(spark, sf)))
    return out.select("query_id", "fact_id", F.col("rank").cast("bigint").alias("rank"), "coverage")


@query("graph_stats", "GR9", f"WITH {CO} SELECT count(DISTINCT src) AS nodes, count(*) AS directed, count(*) // 2 AS undirected FROM edges")
def graph_stats(spark, sf):
    return graph.stats(edges_of(spark, sf))


@query("top_degree", "GR10", f"""WITH {CO}, top AS (SELECT src, count(*) AS degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60),
once AS (SELECT least(src, dst) AS low, greatest(src, dst) AS high, min(src) AS src FROM edges WHERE src IN (SELECT src FROM top) GROUP BY 1, 2)
SELECT 'node' AS kind, src AS a, '' AS b, degree AS n FROM top UNION ALL SELECT 'edge', src, CASE WHEN src = low THEN high ELSE low END, 0 FROM once""")
def top_degree(spark, sf):
    nodes, edges = graph.top_nodes(cut(edges_of(spark, sf)), 60)
    a = nodes.select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.lit("").alias("b"), F.col("degree").alias("n"))
    return a.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).cast("bigint").alias("n")))


@query("neighbours_with_degree", "GR11", f"WITH {CO}, g AS (SELECT src AS dst, count(*) AS c FROM edges GROUP BY 1) SELECT src, dst, coalesce(c, 0) AS connections, source_count FROM edges LEFT JOIN g USING (dst)")
def neighbours_with_degree(spark, sf):
    return graph.neighbours(cut(edges_of(spark, sf))).select("src", "dst", "connections", "source_count")


# ---------------------------------------------------------------- tools

GRAPH = f"""{d.TOOL_CALLS}, seqs AS (SELECT tool, lag(tool) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM calls),
tg AS (SELECT prev AS src, tool AS dst, count(*) AS n FROM seqs WHERE prev <> tool GROUP BY ALL)"""


def tool_graph(spark, sf):
    return tools.transitions(d.tool_calls(spark, sf), F.date_trunc("day", "ts"))


@query("tool_transitions", "TL2 STR5", f"WITH {GRAPH} SELECT src, dst, n FROM tg")
def tool_transitions(spark, sf):
    return tool_graph(spark, sf)


@query("next_tool", "TL3", f"""WITH {GRAPH}, r AS (SELECT *, sum(n) OVER (PARTITION BY src)::BIGINT AS total, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM tg)
SELECT src, dst, n, total, rank, round(n / total, 2) AS share FROM r WHERE rank <= 5""")
def next_tool(spark, sf):
    out = tools.next_tools(tool_graph(spark, sf))
    return out.select("src", "dst", "n", "total", F.col("rank").cast("bigint").alias("rank"), "share")


@query("next_tool_hint", "TL3", f"""WITH {d.TOOL_CALLS.replace("% 12)", "% 4)")}, seqs AS (SELECT tool, lag(tool) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM calls),
tg AS (SELECT prev AS src, tool AS dst, count(*) AS n FROM seqs WHERE prev <> tool GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM tg)
SELECT src, string_agg(dst || ' (' || round(n / total * 100)::INT || '%)', ', ' ORDER BY rank) AS hint FROM r WHERE rank <= 3 AND n / total >= 0.15 GROUP BY 1""")
def next_tool_hint(spark, sf):
    calls = d.tool_calls(spark, sf).withColumn("tool", F.concat(F.lit("tool_"), F.col("k") % 4))
    return tools.next_tool_hints(tools.transitions(calls, F.date_trunc("day", "ts")))


CHAINS = f"""{GRAPH}, ch AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, x.n AS ab, y.n AS bc, least(x.n, y.n) AS strength FROM tg x JOIN tg y ON x.dst = y.src AND x.src <> y.dst AND x.n >= 5 AND y.n >= 5)"""


@query("two_hop_chains", "TL4", f"WITH {CHAINS} SELECT * FROM ch")
def two_hop_chains(spark, sf):
    return tools.chains(tool_graph(spark, sf))


@query("chain_procedures", "TL5", f"""WITH {CHAINS} SELECT '[meta-tool] ' || a || ' → ' || b || ' → ' || c || ' workflow' AS task, strength,
'High-frequency tool chain discovered by AWO analysis (TIG count: ' || a || '→' || b || '=' || ab || ', ' || b || '→' || c || '=' || bc || ').' || chr(10) || '1. Use ' || a || chr(10) || '2. Use ' || b || chr(10) || '3. Use ' || c AS procedure
FROM ch ORDER BY strength DESC, a, b, c LIMIT 20""")
def chain_procedures(spark, sf):
    return tools.chain_procedures(tools.chains(tool_graph(spark, sf))).select("task", "procedure", "strength")


@query("tool_reliability", "TL6 STR4", f"""WITH {d.TOOL_CALLS}, c AS (SELECT tool AS tool_key, count(*) AS use_count, count(*) FILTER (success) AS s, count(*) FILTER (NOT success) AS f FROM calls GROUP BY 1)
SELECT tool_key, use_count, s AS success_count, f AS fail_count, CASE WHEN s + f >= 5 THEN (CASE WHEN s / (s + f) >= 0.85 THEN 'reliable' WHEN s / (s + f) >= 0.6 THEN 'mostly reliable' WHEN s / (s + f) >= 0.4 THEN 'mixed' ELSE 'often fails' END)
  || ' (' || s || '/' || (s + f) || '✓)' END AS capability_summary FROM c""")
def tool_reliability(spark, sf):
    return tools.tool_outcomes(d.tool_calls(spark, sf))


REG = f"""{d.TOOLS}, nt AS (SELECT p_brand AS name, 'Tool to ' || min(p_type) AS description, 'skill' AS source FROM part GROUP BY 1
  UNION ALL SELECT name, 'Renewed ' || description, source FROM tools WHERE suppkey % 2 = 0),
nk AS (SELECT lower(name) AS tool_key, * FROM nt)"""


@query("tool_registration", "TL1 SCN4", f"""WITH {REG} SELECT tool_key, coalesce(n.description, t.description) AS description,
  CASE WHEN n.name IS NULL THEN {label_sql("t.name || ' ' || t.description", scene.TOOL_WORDS)} ELSE {label_sql("n.name || ' ' || n.description", scene.TOOL_WORDS)} END AS category,
  coalesce(n.source, t.source) AS source, coalesce(t.use_count, 0) AS use_count FROM tools t FULL JOIN nk n USING (tool_key)""")
def tool_registration(spark, sf):
    old = d.tools(spark, sf).withColumn("category", scene.tool_category(F.col("name"), F.col("description")))
    zero = F.lit(0).cast("bigint")
    stored = old.withColumn("success_count", zero).withColumn("fail_count", zero).withColumn("capability_summary", F.lit(None).cast("string"))
    brands = d.table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.concat(F.lit("Tool to "), F.min("p_type")).alias("description")).withColumn("source", F.lit("skill"))
    again = old.filter("suppkey % 2 = 0").select("name", F.concat(F.lit("Renewed "), "description").alias("description"), "source")
    new = brands.unionByName(again).withColumn("category", F.lit(""))
    return tools.register(stored.drop("suppkey"), new).select("tool_key", "description", "category", "source", "use_count")


@query("manifest", "TL7", f"""WITH {d.TOOLS}, c AS (SELECT *, {label_sql("name || ' ' || description", scene.TOOL_WORDS)} AS category FROM tools)
SELECT category, count(*) AS tools, sum(use_count)::BIGINT AS uses, min(name) AS first_name FROM c GROUP BY 1""")
def manifest(spark, sf):
    t = d.tools(spark, sf).withColumn("category", scene.tool_category(F.col("name"), F.col("description")))
    return tools.manifest(t)


@query("tool_names_by_category", "TL7", f"""WITH {d.TOOLS} SELECT {label_sql("name || ' ' || description", scene.TOOL_WORDS)} AS category, name FROM tools""")
def tool_names_by_category(spark, sf):
    """The names lists of the manifest, one name per row again."""
    t = d.tools(spark, sf).withColumn("category", scene.tool_category(F.col("name"), F.col("description")))
    return tools.names_by_category(t, 7).select("category", F.explode(F.split("names", ", ")).alias("name"))


ENV = f"""{d.TOOL_CALLS}, w AS (SELECT session_id AS agent, list_extract({tools.ENV_ORDER + ['region', 'branch']}, (k % 14 + 1)::INT) AS field, value::VARCHAR AS value, ts, event_id FROM calls),
st AS (SELECT agent, field, arg_max(value, (ts, event_id)) AS value FROM w GROUP BY ALL)"""


def env_state(spark, sf):
    writes = d.tool_calls(spark, sf).select(
        F.col("session_id").alias("agent"), d.pick([*tools.ENV_ORDER, "region", "branch"], F.col("k") % 14).alias("field"),
        F.col("value").cast("string").alias("value"), "ts", F.col("event_id").alias("write_id"),
    )
    return tools.latest_state(writes)


@query("env_latest", "TL8", f"WITH {ENV} SELECT * FROM st")
def env_latest(spark, sf):
    return env_state(spark, sf)


@query("env_text", "TL8", f"""WITH {ENV} SELECT agent, '## Agent Environment' || chr(10) || string_agg('- ' || field || ': ' || value, chr(10)
  ORDER BY CASE WHEN list_contains({tools.ENV_ORDER}, field) THEN list_position({tools.ENV_ORDER}, field) ELSE 13 END, field) AS text FROM st GROUP BY 1""")
def env_text(spark, sf):
    return tools.state_text(env_state(spark, sf))


@query("procs_by_tool", "PR4", f"WITH {d.PROCEDURES} SELECT DISTINCT lower(t) AS tool, proc_id FROM (SELECT proc_id, unnest(tools_used) AS t FROM procedures)")
def procs_by_tool(spark, sf):
    return tools.procedures_by_tool(d.procedures(spark, sf))


@query("scan_procedures", "SEL2", f"WITH {d.PROCEDURES} SELECT proc_id, task, success_count FROM procedures WHERE task <> ''")
def scan_procedures(spark, sf):
    return d.procedures(spark, sf).filter("task <> ''").select("proc_id", "task", "success_count")


NEAR1 = f"""WITH {d.PROCEDURE_VECTORS}, {d.QUERY_VECTORS}, near AS (SELECT query_id, proc_id, (1 + c) / 2 AS score FROM (SELECT q.query_id, p.proc_id, list_cosine_similarity(q.embedding, p.embedding) AS c,
  row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.embedding, p.embedding) DESC, p.proc_id) AS r FROM query_vectors q JOIN procedure_vectors p ON TRUE) WHERE r = 1)"""


def nearest_procedure(spark, sf):
    return vectors.knn(d.procedure_vectors(spark, sf), d.query_vectors(spark, sf), 1, "proc_id")


@query("store_procedures", "PR1", f"""{NEAR1} SELECT proc_id, success_count + (SELECT count(*) FROM near n WHERE n.proc_id = p.proc_id AND score > 0.9) AS success_count FROM procedures p
UNION ALL SELECT 1000000000 + query_id, 1 FROM near WHERE score <= 0.9""")
def store_procedures(spark, sf):
    """The recall requests stored as procedures beside the known ones."""
    near = nearest_procedure(spark, sf).select((F.col("query_id") + 1000000000).alias("new_id"), "proc_id", "score")
    new = d.queries(spark, sf).select((F.col("query_id") + 1000000000).alias("new_id"), F.col("text").alias("task"))
    return tools.store_procedures(d.procedures(spark, sf), new, near).select("proc_id", "success_count")


@query("procedure_feedback", "PR3", f"""{NEAR1}, k AS (SELECT proc_id, count(*) FILTER (query_id % 3 > 0) AS s, count(*) FILTER (query_id % 3 = 0) AS f FROM near WHERE score >= 0.5 GROUP BY 1)
SELECT proc_id, success_count + coalesce(s, 0) AS success_count, fail_count + coalesce(f, 0) AS fail_count FROM procedures LEFT JOIN k USING (proc_id)""")
def procedure_feedback(spark, sf):
    near = nearest_procedure(spark, sf).withColumn("success", F.col("query_id") % 3 > 0)
    return tools.procedure_feedback(d.procedures(spark, sf), near).select("proc_id", "success_count", "fail_count")


TV = f"""WITH {d.TOOLS}, {d.QUERY_VECTORS}, tv AS (SELECT t.*, e.embedding::DOUBLE[] AS embedding FROM tools t JOIN embeddings e ON e.vec_id = t.suppkey * 13 % (SELECT count(*) FROM embeddings))"""


@query("tool_recall", "VEC6 SEL8", f"""{TV} SELECT query_id, tool_key, round(score, 4) AS score, rank FROM (SELECT q.query_id, t.tool_key, (1 + list_cosine_similarity(q.embedding, t.embedding)) / 2 AS score,
  row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.embedding, t.embedding) DESC, t.tool_key) AS rank FROM query_vectors q JOIN tv t
  ON q.query_id % 2 = 0 OR t.source = list_extract(['builtin','mcp','plugin','skill'], (q.query_id % 4 + 1)::INT)) WHERE rank <= 5""")
def tool_recall(spark, sf):
    """Nearest tools; odd requests ask for one source."""
    e = d.embeddings(spark, sf).select("vec_id", "embedding")
    n = e.count()
    t = d.tools(spark, sf).withColumn("vec_id", F.col("suppkey") * 13 % n).join(e, "vec_id")
    i = F.col("query_id")
    q = d.query_vectors(spark, sf).withColumn("source", F.when(i % 2 == 1, d.pick(["builtin", "mcp", "plugin", "skill"], i % 4)))
    hits = vectors.knn(t, q, 5, "tool_key", rules=[vectors.Match("source", "source")])
    return hits.select("query_id", "tool_key", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("file_context", "VEC7 SEL9", f"""WITH {d.EPISODE_VECTORS}, fv AS (SELECT page_id AS query_id, page_id % 100 AS session_id, e.embedding::DOUBLE[] AS embedding FROM pages JOIN embeddings e ON e.vec_id = (page_id * 5 + 2) % (SELECT count(*) FROM embeddings))
SELECT query_id, episode_id, round(score, 3) AS score FROM (SELECT q.query_id, p.episode_id, (1 + list_cosine_similarity(q.embedding, p.embedding)) / 2 AS score,
  row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.embedding, p.embedding) DESC, p.episode_id) AS rank FROM fv q JOIN episode_vectors p ON p.session_id <> q.session_id) WHERE rank <= 5""")
def file_context(spark, sf):
    """Pages stand for files; episodes of other sessions near each of them."""
    e = d.embeddings(spark, sf).select("vec_id", "embedding")
    n = e.count()
    files = d.table(spark, sf, "pages").select(
        F.col("page_id").alias("query_id"), (F.col("page_id") % 100).alias("session_id"),
        F.substring_index("url", "/", -1).alias("base"), ((F.col("page_id") * 5 + 2) % n).alias("vec_id"),
    ).join(e, "vec_id")
    hits = vectors.knn(d.episode_vectors(spark, sf), files, 5, "episode_id", rules=[vectors.Match("session_id", "session_id", "differ")])
    return hits.select("query_id", "episode_id", F.round("score", 3).alias("score"))
