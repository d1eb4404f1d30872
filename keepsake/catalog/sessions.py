"""Registered queries: sessions, persona, statistics and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.catalog import derived as d
from keepsake.catalog import recall as rc
from keepsake.catalog.messages import TRIM, q
from keepsake.catalog.registry import query
from keepsake.functions import content as ct
from keepsake.operators import evaluation, lexical, persona, sessions, vectors
from keepsake.session import cut

# Users of the event log as sessions with many short turns.
SUMMARIES = f"""{d.TOOL_CALLS}, sm AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS seq, event_id,
  'ran ' || tool || ' for ' || value || repeat(' step', (event_id % 9)::INT) AS summary FROM calls)"""


def summaries(spark, sf):
    text = F.concat(F.lit("ran "), "tool", F.lit(" for "), F.col("value").cast("string"), F.repeat(F.lit(" step"), (F.col("event_id") % 9).cast("int")))
    return d.tool_calls(spark, sf).select("session_id", F.col("event_id").alias("seq"), text.alias("summary"))


@query("rolling_context", "SES1", f"""WITH {SUMMARIES}, l AS (SELECT session_id, count(*) AS turns, list(summary ORDER BY seq) AS s FROM sm GROUP BY 1)
SELECT session_id, turns, list_reduce(s, lambda a, x: CASE WHEN length(a) + 5 + length(x) > 1200 THEN (a || chr(10) || '---' || chr(10) || x)[1:900] ELSE (a || chr(10) || '---' || chr(10) || x)[1:1500] END) AS context FROM l""")
def rolling_context(spark, sf):
    return sessions.rolling_contexts(summaries(spark, sf), chunk_turns=2048)


@query("compact_contexts", "SES3", """WITH c AS (SELECT doc_id AS session_id, text AS context, length(text) AS n FROM documents WHERE length(text) > 2000),
p AS (SELECT *, list_transform(range(0, (n + 1199) // 1200), lambda i: context[i * 1200 + 1 : i * 1200 + 1200]) AS ch FROM c),
f AS (SELECT session_id, n, CASE WHEN n > 2400 THEN list_reduce(list_prepend(ch[1][1:180], ch[2:]), lambda a, x: (a || chr(10) || '---' || chr(10) || x)[1:1000])
  ELSE (context[1:n // 2] || chr(10) || '---' || chr(10) || context[n // 2 + 1:])[1:1000] END AS r FROM p)
SELECT session_id, n::INT AS size_before, length(r)::INT AS size_after, r AS context FROM f""")
def compact_contexts(spark, sf):
    docs = d.table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("context"))
    return sessions.compact(docs, threshold=2000)


PROMOTE = f"""c AS (SELECT doc_id AS session_id, {TRIM.format('text')} AS context, n_chars FROM documents WHERE length(text) >= 80),
k AS (SELECT *, CASE WHEN length(context) <= 280 THEN context ELSE context[1:180] END AS s FROM c WHERE length(context) >= 80)"""


@query("promoted_sessions", "SES4 EXT10", f"WITH {PROMOTE} SELECT session_id, '[Session Summary] ' || s AS content, session_id = (SELECT max(session_id) FROM k) AS pinned FROM k")
def promoted_sessions(spark, sf):
    docs = d.table(spark, sf, "documents").select(
        F.col("doc_id").alias("session_id"), F.col("text").alias("context"), F.col("doc_id").alias("ended_at")
    )
    episodes, pinned = sessions.promote(docs)
    mark = pinned.select("session_id", F.lit(True).alias("p"))
    return episodes.join(F.broadcast(mark), "session_id", "left").select(  # one row
        "session_id", "content", F.coalesce("p", F.lit(False)).alias("pinned")
    )


DIGEST = f"""{d.TOOL_CALLS}, {d.MESSAGES}, se AS (SELECT session_id, min(ts) AS ts FROM messages GROUP BY 1),
fx AS (SELECT event_id AS fact_id, ts, (event_id * 37 % 100) / 100.0::DOUBLE AS importance, event_type AS category, tool FROM calls),
j AS (SELECT s.session_id, f.*, row_number() OVER (PARTITION BY s.session_id ORDER BY importance DESC, fact_id) AS r FROM se s JOIN fx f ON abs(epoch_us(f.ts) - epoch_us(s.ts)) < 3600000000
  WHERE epoch_us(TIMESTAMP '{d.AS_OF}') - epoch_us(s.ts) >= 86400000000),
dg AS (SELECT session_id, count(*) AS facts_available, least(count(*), 20)::INT AS fact_count, string_agg(fact_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 20) AS fact_ids,
  array_to_string(list_sort(list(DISTINCT tool)), ',') AS entities, array_to_string(list_sort(list(DISTINCT category) FILTER (r <= 20)), ',') AS categories FROM j GROUP BY 1 HAVING count(*) >= 5)"""


def digest_rows(spark, sf):
    calls = d.tool_calls(spark, sf)
    facts = calls.select(
        F.col("event_id").alias("fact_id"), "ts", ((F.col("event_id") * 37 % 100) / 100.0).alias("importance"),
        F.col("event_type").alias("category"), F.array("tool").alias("entities"),
    )
    starts = d.messages(spark, sf).groupBy("session_id").agg(F.min("ts").alias("ts"))
    return sessions.digests(starts, facts, d.as_of())


@query("session_digest", "SES5", f"WITH {DIGEST} SELECT * FROM dg")
def session_digest(spark, sf):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return digest_rows(spark, sf).select("session_id", "facts_available", "fact_count", join("fact_ids"), join("entities"), join("categories"))


@query("latest_digests", "SES6", f"WITH {DIGEST} SELECT session_id, facts_available FROM dg ORDER BY session_id DESC LIMIT 3")
def latest_digests(spark, sf):
    return sessions.latest_digests(digest_rows(spark, sf), 3).select("session_id", "facts_available")


@query("session_windows", "SES8 STR3", f"""WITH {d.TOOL_CALLS}, g AS (SELECT session_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 14400000000 THEN 0 ELSE 1 END AS o FROM calls WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
s AS (SELECT session_id, ts, sum(o) OVER (PARTITION BY session_id ORDER BY ts) AS k FROM g)
SELECT session_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 14400000000 AS "end", count(*) AS n FROM s GROUP BY session_id, k""")
def session_windows(spark, sf):
    out = sessions.session_windows(d.tool_calls(spark, sf))
    return out.select("session_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("tumbling_rate", "STR4", f"""WITH {d.TOOL_CALLS} SELECT tool, epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start, count(*) AS n, round(avg(success::INT), 4) AS rate FROM calls GROUP BY ALL""")
def tumbling_rate(spark, sf):
    w = d.tool_calls(spark, sf).groupBy("tool", F.window("ts", "6 hours").alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("success").cast("int")), 4).alias("rate")).select(
        "tool", F.unix_micros("w.start").alias("start"), "n", "rate"
    )


@query("sliding_rate", "STR4", f"""WITH {d.TOOL_CALLS}, e AS (SELECT tool, success, epoch_us(time_bucket(INTERVAL '2 hours', ts)) - o * 7200000000 AS start FROM calls, range(3) r(o))
SELECT tool, start, count(*) AS n, round(avg(success::INT), 4) AS rate FROM e GROUP BY ALL""")
def sliding_rate(spark, sf):
    w = d.tool_calls(spark, sf).groupBy("tool", F.window("ts", "6 hours", "2 hours").alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("success").cast("int")), 4).alias("rate")).select(
        "tool", F.unix_micros("w.start").alias("start"), "n", "rate"
    )


@query("timeline", "SEL12", f"""WITH {d.EPISODES} SELECT session_id, episode_id, content[1:200] AS content, pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, episode_id DESC) AS pos FROM episodes) WHERE pos <= 3""")
def timeline(spark, sf):
    out = sessions.timeline(d.episodes(spark, sf), 3)
    return out.select("session_id", "episode_id", "content", F.col("pos").cast("bigint").alias("pos"))


@query("observations", "SEL13", f"WITH {d.EPISODES} SELECT episode_id, content[1:300] AS content, session_id, epoch_ms(ts) AS ts FROM episodes")
def observations(spark, sf):
    return sessions.observations(d.episodes(spark, sf)).withColumn("ts", F.unix_millis("ts"))


COMMITS = """commits AS (SELECT 'sha' || o_orderkey AS sha, o_orderstatus AS branch, o_orderpriority AS repo, o_custkey AS session_id, o_orderdate AS ts FROM orders)"""


def commits(spark, sf):
    return d.table(spark, sf, "orders").select(
        F.concat(F.lit("sha"), "o_orderkey").alias("sha"), F.col("o_orderstatus").alias("branch"), F.col("o_orderpriority").alias("repo"),
        F.col("o_custkey").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
    )


@query("commit_list", "SEL14", f"WITH {COMMITS} SELECT sha, session_id FROM commits WHERE branch = 'F' AND repo = '2-HIGH' ORDER BY ts DESC, sha LIMIT 20")
def commit_list(spark, sf):
    """The newest twenty commits of one branch and repository."""
    return sessions.commit_list(commits(spark, sf), "F", "2-HIGH").select("sha", "session_id")


@query("commit_sessions", "SEL14", f"WITH {COMMITS} SELECT sha, c_name AS owner FROM commits JOIN customer ON session_id = c_custkey")
def commit_sessions(spark, sf):
    owners = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("owner"))
    return commits(spark, sf).join(owners, "session_id").select("sha", "owner")


@query("session_list", "SEL15", "SELECT doc_id AS session_id, text[1:300] AS summary, length(text)::INT AS length FROM documents")
def session_list(spark, sf):
    docs = d.table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("context"))
    return sessions.session_list(docs)


# ---------------------------------------------------------------- persona

SAID = """said AS (SELECT c_nationkey AS subject, list_extract(['work', 'preference', 'rule', 'location', 'general'], (o_orderkey % 5 + 1)::INT) AS category,
  'orders ' || o_orderpriority || ' goods for ' || lower(c_mktsegment) || ' from ' || n_name || CASE WHEN o_orderkey % 7 = 0 THEN ' token = abc' || o_orderkey ELSE '' END
  || CASE WHEN o_orderkey % 4 = 0 THEN ' status ' || o_orderstatus ELSE '' END AS content
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def said(spark, sf):
    k = F.col("o_orderkey")
    o, c, n = (d.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    text = F.concat(
        F.lit("orders "), "o_orderpriority", F.lit(" goods for "), F.lower("c_mktsegment"), F.lit(" from "), "n_name",
        F.when(k % 7 == 0, F.concat(F.lit(" token = abc"), k)).otherwise(F.lit("")),
        F.when(k % 4 == 0, F.concat(F.lit(" status "), "o_orderstatus")).otherwise(F.lit("")),
    )
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_nationkey").alias("subject"), d.pick(["work", "preference", "rule", "location", "general"], k % 5).alias("category"), text.alias("content")
    )


ENTRIES_SQL = f"""{SAID}, en AS (SELECT DISTINCT subject, CASE category WHEN 'work' THEN 'work' WHEN 'preference' THEN 'preferences' WHEN 'rule' THEN 'rules' WHEN 'location' THEN 'location' END AS field, content AS entry
  FROM said WHERE category <> 'general' AND NOT regexp_matches(content, {q('(?i)' + chr(92) + 'b(password|token|api[_ -]?key|secret)' + chr(92) + 'b' + chr(92) + 's*(?:is|=|:)' + chr(92) + 's*')})),
wd AS (SELECT *, list_distinct(regexp_extract_all(lower(entry), '[a-z]{{3,}}')) AS w, row_number() OVER (PARTITION BY subject, field ORDER BY -length(entry), entry) AS i FROM en),
pk(subject, field, i, kept, words) AS (SELECT subject, field, 0::BIGINT, []::VARCHAR[], []::VARCHAR[][] FROM en GROUP BY 1, 2 UNION ALL
  SELECT p.subject, p.field, w.i, CASE WHEN ok THEN list_append(p.kept, w.entry) ELSE p.kept END, CASE WHEN ok THEN list_append(p.words, w.w) ELSE p.words END
  FROM (SELECT p.*, x.entry, x.w, x.i AS xi, len(p.kept) < 5 AND len(list_filter(p.words, lambda o: len(list_intersect(o, x.w)) / len(list_distinct(list_concat(o, x.w))) >= 0.6)) = 0 AS ok
    FROM pk p JOIN wd x ON x.subject = p.subject AND x.field = p.field AND x.i = p.i + 1) p, LATERAL (SELECT p.entry AS entry, p.w AS w, p.xi AS i) w),
fin AS (SELECT subject, field, arg_max(kept, i) AS kept FROM pk GROUP BY 1, 2)"""


@query("persona_entries", "PER1", f"WITH RECURSIVE {ENTRIES_SQL} SELECT subject, field, unnest(kept) AS entry, unnest(range(1, len(kept) + 1))::INT AS rank FROM fin")
def persona_entries(spark, sf):
    return persona.build(said(spark, sf), F.lit("nobody"))


@query("persona_profile", "PER2", f"""WITH RECURSIVE {ENTRIES_SQL} SELECT subject, '## User Profile' || chr(10) || string_agg('- ' || field || ': ' || array_to_string(kept, '; ')[1:500], chr(10)
  ORDER BY list_position({persona.FIELD_ORDER}, field)) AS text FROM fin GROUP BY 1""")
def persona_profile(spark, sf):
    return persona.profile_text(persona.profile(persona.build(said(spark, sf), F.lit("nobody"))))


# ---------------------------------------------------------------- statistics


@query("tier_counts", "ST1", f"""WITH {d.FACTS}, {d.EPISODES}, {d.PROCEDURES}, {d.TOOLS} SELECT 'facts' AS tier, count(*) AS n FROM facts UNION ALL SELECT 'episodes', count(*) FROM episodes
UNION ALL SELECT 'procedures', count(*) FROM procedures UNION ALL SELECT 'tools', count(*) FROM tools""")
def tier_counts(spark, sf):
    return evaluation.tier_counts({"facts": d.facts(spark, sf), "episodes": d.episodes(spark, sf), "procedures": d.procedures(spark, sf), "tools": d.tools(spark, sf)})


LOG = """log AS (SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skip' ELSE 'success' END AS outcome, value AS ms FROM events)"""


@query("writer_stats", "ST2", f"""WITH {LOG} SELECT count(*) AS attempts, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'skip') AS skips, count(*) FILTER (outcome = 'error') AS errors,
  round(count(*) FILTER (outcome = 'success') / count(*) FILTER (outcome <> 'skip'), 3) AS success_rate, round(sum(ms) / count(*)) AS avg_ms FROM log""")
def writer_stats(spark, sf):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skip").otherwise("success")
    return evaluation.writer_stats(d.table(spark, sf, "events").select(kind.alias("outcome"), F.col("value").alias("ms")))


@query("latency_percentiles", "EV7", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    out = evaluation.latency(d.table(spark, sf, "events"), "event_type", "value")
    return out.select("event_type", "n", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


# ---------------------------------------------------------------- evaluation

PUNCT = q(evaluation.PUNCTUATION)


def tok_sql(expr: str) -> str:
    return (
        f"list_filter(regexp_extract_all(regexp_replace(lower({expr}), {PUNCT}, '', 'g'), '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]|[^\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\s]+'), "
        "lambda t: NOT list_contains(['a', 'an', 'the'], t))"
    )


PAIRS = f"""WITH {d.FACT_VECTORS}, {d.QUERY_VECTORS}, {rc.BM25}, {rc.BM_SEARCH}, {rc.knn_sql(1)},
qa AS (SELECT query_id || ':bm25' AS pair_id, 'bm25' AS system, content AS context, text AS answer FROM bm_hits JOIN facts USING (fact_id) JOIN queries USING (query_id) WHERE rank = 1
  UNION ALL SELECT query_id || ':vector', 'vector', content, text FROM hits JOIN facts USING (fact_id) JOIN queries USING (query_id)
  UNION ALL SELECT query_id || ':none', 'none', '', text FROM queries),
tk AS (SELECT pair_id, system, context, answer, {tok_sql('context')} AS ct, {tok_sql('answer')} AS gt FROM qa)"""


def pairs(spark, sf):
    """Each benchmark text as the answer, against the best document of two searches and against nothing."""
    corpus, qv = rc.active_vectors(spark, sf), d.query_vectors(spark, sf)
    facts = d.facts(spark, sf)
    bm = lexical.search(lexical.build_index(facts), qv, 1).withColumnRenamed("doc_id", "fact_id")
    vec = vectors.knn(corpus, qv, 1)
    named = lambda hits, name: vectors.attach(hits.select("query_id", "fact_id"), facts, ["content"]).join(qv.select("query_id", "text"), "query_id").select(
        F.concat("query_id", F.lit(f":{name}")).alias("pair_id"), F.lit(name).alias("system"), F.col("content").alias("context"), F.col("text").alias("answer")
    )
    none = qv.select(F.concat("query_id", F.lit(":none")).alias("pair_id"), F.lit("none").alias("system"), F.lit("").alias("context"), F.col("text").alias("answer"))
    return cut(named(bm, "bm25").unionByName(named(vec, "vector")).unionByName(none))


F1SQL = """f AS (SELECT pair_id, coalesce(sum(least(p, g)), 0) AS shared FROM (SELECT pair_id, t, count(*) FILTER (s = 0) AS p, count(*) FILTER (s = 1) AS g FROM
  (SELECT pair_id, unnest(ct) AS t, 0 AS s FROM tk UNION ALL SELECT pair_id, unnest(gt), 1 FROM tk) GROUP BY ALL) GROUP BY 1),
whole AS (SELECT tk.pair_id, CASE WHEN coalesce(shared, 0) > 0 THEN 2.0 * (shared / len(ct)) * (shared / len(gt)) / ((shared / len(ct)) + (shared / len(gt))) ELSE 0.0 END::DOUBLE AS f1 FROM tk LEFT JOIN f USING (pair_id))"""


@query("token_f1", "EV1", f"{PAIRS}, {F1SQL} SELECT pair_id, round(f1, 4) AS f1 FROM whole")
def token_f1(spark, sf):
    return evaluation.token_f1(pairs(spark, sf)).select("pair_id", F.round("f1", 4).alias("f1"))


WINSQL = f"""{F1SQL}, st AS (SELECT pair_id, unnest(range(len(ct))) AS st, ct, gt FROM tk), w AS (SELECT pair_id, st, ct[st + 1 : st + 10] AS win, gt FROM st),
ws AS (SELECT pair_id, len(win) AS nw, len(gt) AS ng, list_sum(list_transform(list_distinct(win), lambda t: least(len(list_filter(win, lambda x: x = t)), len(list_filter(gt, lambda x: x = t))))) AS shared FROM w),
bw AS (SELECT pair_id, max(CASE WHEN shared > 0 THEN 2.0 * (shared / nw) * (shared / ng) / ((shared / nw) + (shared / ng)) ELSE 0.0 END) AS w FROM ws GROUP BY 1)"""


@query("windowed_f1", "EV2", f"{PAIRS.replace('content AS context', 'UNWRAP AS context').replace('content, text', 'UNWRAP, text')}, {WINSQL} SELECT pair_id, round(greatest(f1, coalesce(w, 0)), 4) AS f1 FROM whole LEFT JOIN bw USING (pair_id)".replace(
    "UNWRAP", r"(CASE WHEN regexp_matches(content, '##\s+\w') THEN regexp_extract(content, '(?s)##\s+\w.*$') ELSE content END)"))
def windowed_f1(spark, sf):
    return evaluation.windowed_f1(pairs(spark, sf)).select("pair_id", F.round("f1", 4).alias("f1"))


FOUND = "(len(gt) > 0 AND contains(array_to_string(ct, ' '), array_to_string(gt, ' ')))"


@query("answer_in_context", "EV3", f"{PAIRS} SELECT pair_id, {FOUND} AS found FROM tk")
def answer_in_context(spark, sf):
    return pairs(spark, sf).select("pair_id", evaluation.answer_in_context(F.col("context"), F.col("answer")).alias("found"))


@query("system_table", "EV4 EV6", f"""{PAIRS}, {F1SQL} SELECT system, count(*) AS questions, round(avg(f1), 4) AS mean_f1, round(avg({FOUND}::INT), 4) AS answer_rate,
  round(avg((f1 > 0)::INT), 4) AS recall_at_1, round(avg(len(ct)), 4) AS mean_tokens FROM tk JOIN whole USING (pair_id) GROUP BY 1""")
def system_table(spark, sf):
    p = pairs(spark, sf)
    rows = p.join(evaluation.token_f1(p), "pair_id").select(
        "system", "f1", evaluation.answer_in_context(F.col("context"), F.col("answer")).alias("found"), F.size(evaluation.tokens(F.col("context"))).alias("tokens")
    )
    return evaluation.system_table(rows)


@query("full_context", "EV6", f"""WITH {d.MESSAGES}, c AS (SELECT session_id, seq // 1024 AS part, string_agg(role || ': ' || content, ' ' ORDER BY seq) AS text FROM messages GROUP BY ALL)
SELECT session_id, part, text, len({tok_sql('text')})::INT AS tokens FROM c""")
def full_context(spark, sf):
    return evaluation.full_context(d.messages(spark, sf))


@query("rank_metrics", "EV5", f"""{rc.BASE}, {rc.knn_sql(10)}, truth AS (SELECT query_id, fact_id FROM queries JOIN facts USING (session_id) WHERE superseded_by IS NULL),
sz AS (SELECT query_id, count(*) AS relevant FROM truth GROUP BY 1), g AS (SELECT query_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM hits JOIN truth USING (query_id, fact_id) GROUP BY 1)
SELECT query_id, round(coalesce(found / relevant, 0), 4) AS recall, round(coalesce(found / 10, 0), 4) AS precision,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 4) AS ndcg, round(coalesce(1 / first, 0), 4) AS reciprocal_rank FROM sz LEFT JOIN g USING (query_id)""")
def rank_metrics(spark, sf):
    corpus, qv = rc.active_vectors(spark, sf), d.query_vectors(spark, sf)
    hits = vectors.knn(corpus, qv, 10).select("query_id", F.col("fact_id").alias("id"), "rank")
    truth = qv.select("query_id", "session_id").join(corpus.select("session_id", F.col("fact_id").alias("id")), "session_id").select("query_id", "id")
    return evaluation.rank_metrics(hits, truth, 10)
