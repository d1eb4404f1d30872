"""Registered queries: transcripts, cleaning, tags, admission and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.catalog import derived as d
from keepsake.catalog.registry import query
from keepsake.functions import content as ct
from keepsake.functions import scene
from keepsake.functions import text as tx
from keepsake.operators import admission, embedding, extraction, messages, vectors
from keepsake.operators.ordering import with_position
from keepsake.sources import exchange, markdown, transcripts


def q(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


# ---------------------------------------------------------------- transcripts


def lines_a(spark, sf):
    """Conversations written out as format A lines, with callbacks, summaries and broken lines."""
    block = lambda text: F.to_json(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))))
    tool = F.concat(F.lit('{"type":"tool_use","name":"tool_'), F.col("turn") % 5, F.lit('"}'))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'^\{"t":(.*)\}$', 1)
    user = F.when(F.col("conv_id") % 2 == 0, quoted).otherwise(block(F.col("text")))
    body = F.regexp_replace(block(F.col("text")), r"\]$", "")
    value = (
        F.when(F.col("role") == "user", F.concat(F.lit('{"type":"user",'), F.when(F.col("conv_id") % 11 == 0, F.lit('"toolUseResult":"x",')).otherwise(F.lit("")), F.lit('"message":{"role":"user","content":'), user, F.lit("}}")))
        .when(F.col("role") == "assistant", F.concat(F.lit('{"type":"assistant","message":{"role":"assistant","content":'), body, F.lit(","), tool, F.lit("]}}")))
        .otherwise(F.lit('{"type":"summary", broken'))
    )
    return d.table(spark, sf, "conversations").select(
        F.concat(F.lit("/notes/app/"), "conv_id", F.lit(".jsonl")).alias("path"), F.col("turn").alias("line_no"), value.alias("value")
    )


@query("transcript_messages_a", "SRC1", r"""SELECT 'claudecode:app:' || conv_id AS session_id, turn AS seq, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM conversations
WHERE (role = 'user' AND conv_id % 11 <> 0) OR role = 'assistant'""")
def transcript_messages_a(spark, sf):
    return transcripts.messages_a(lines_a(spark, sf), "app")


@query("transcript_messages_b", "SRC2", r"""SELECT CASE WHEN conv_id % 3 = 0 THEN conv_id::VARCHAR ELSE 'id-' || conv_id END AS session_id, turn AS seq, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content
FROM conversations WHERE role IN ('user', 'assistant')""")
def transcript_messages_b(spark, sf):
    c = d.table(spark, sf, "conversations")
    path = F.concat(F.lit("/b/"), "conv_id", F.lit(".jsonl")).alias("path")
    said = c.select(path, F.col("turn").alias("line_no"), F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.col("text")).alias("b")).alias("content")).alias("message"))).alias("value"))
    heads = c.filter("conv_id % 3 <> 0").select("conv_id").distinct().select(
        path, F.lit(-1).cast("bigint").alias("line_no"), F.concat(F.lit('{"type":"session","id":"id-'), "conv_id", F.lit('"}')).alias("value")
    )
    return transcripts.messages_b(said.unionByName(heads))


@query("transcript_tool_calls", "SRC7", "SELECT '/notes/app/' || conv_id || '.jsonl' AS path, turn AS line_no, 'tool_' || (turn % 5) AS tool FROM conversations WHERE role = 'assistant'")
def transcript_tool_calls(spark, sf):
    return transcripts.tool_calls(lines_a(spark, sf)).select("path", "line_no", "tool")


@query("tool_outcome", "SRC8", """SELECT doc_id, NOT (regexp_matches(lower(text), 'error|exception|traceback|failed|not found|permission denied|timeout|command not found')) AS success FROM documents""")
def tool_outcome(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", transcripts.outcome(F.col("text")).alias("success"))


@query("new_sessions", "SRC4", """WITH p AS (SELECT conv_id FROM conversations WHERE role = 'system'), n AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 2)
SELECT conv_id AS session_id, turn AS seq FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM p) AND conv_id IN (SELECT conv_id FROM n)""")
def new_sessions(spark, sf):
    """Sessions that opened with a system turn stand for those already taken in."""
    m = d.messages(spark, sf)
    return transcripts.new_sessions(m, m.filter("role = 'system'")).select("session_id", "seq")


WINDOWS = """p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS pos FROM messages),
windows AS (SELECT session_id, pos // 4 AS window_id, count(*) AS n, string_agg(role || ': ' || content, chr(10) ORDER BY pos) AS text FROM p GROUP BY ALL HAVING count(*) >= 2)"""


@query("turn_windows", "SRC3", f"WITH {d.MESSAGES}, {WINDOWS} SELECT session_id, window_id, session_id || ':w' || window_id AS chunk_id, n, text FROM windows")
def turn_windows(spark, sf):
    return messages.turn_windows(d.messages(spark, sf))


@query("markdown_sections", "SRC5", r"""WITH m AS (SELECT doc_id, source, '## ' || replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), chr(10) || '## ') AS md FROM documents),
s AS (SELECT doc_id, source, unnest(list_transform(string_split(md, chr(10) || '## '), lambda x, i: {'no': i - 1, 'body': CASE WHEN i = 1 THEN x ELSE '## ' || x END}), recursive := true) FROM m)
SELECT doc_id || '' AS source, no::BIGINT AS section_no, length(regexp_replace(body, '^\s+|\s+$', '', 'g')[1:2000]) AS chars, doc_id % 5 AS priority FROM s WHERE length(regexp_replace(body, '^\s+|\s+$', '', 'g')) >= 80""")
def markdown_sections(spark, sf):
    docs = d.table(spark, sf, "documents")
    files = docs.select(
        F.col("doc_id").cast("string").alias("source"),
        F.concat(F.lit("## "), F.regexp_replace(tx.strip(F.col("text")), "\n", "\n## ")).alias("text"),
    )
    priorities = docs.select(F.col("doc_id").cast("string").alias("source"), (F.col("doc_id") % 5).alias("priority"))
    out = markdown.sections(files, priorities)
    return out.select("source", F.col("section_no").cast("bigint").alias("section_no"), F.length("content").cast("bigint").alias("chars"), "priority")


@query("skill_files", "SRC6", """SELECT p_partkey::VARCHAR AS path, '[skill:' || p_name || '] ' || p_type || ' part' AS task,
  CASE WHEN p_partkey % 4 = 0 THEN p_type || ' part' ELSE 'Use ' || p_brand END AS procedure,
  CASE p_partkey % 3 WHEN 0 THEN 'software-dev' WHEN 1 THEN 'devops' ELSE 'general' END AS domain FROM part WHERE p_partkey % 7 <> 3""")
def skill_files(spark, sf):
    p = F.col("p_partkey")
    head = F.concat(
        F.lit("---\nname: "), "p_name",
        F.when(p % 7 != 3, F.concat(F.lit("\ndescription: "), "p_type", F.lit(" part"))).otherwise(F.lit("")),
        F.when(p % 3 == 0, F.lit("\ncategory: coding")).when(p % 3 == 1, F.lit("\ncategory: security")).otherwise(F.lit("")),
        F.lit("\n---\n"), F.when(p % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Use "), "p_brand")),
    )
    files = d.table(spark, sf, "part").select(p.cast("string").alias("path"), head.alias("text"))
    return markdown.skills(files).select("path", "task", "procedure", "domain")


@query("tier_rows", "SRC13", f"""WITH {d.FACT_ENTITIES} SELECT fact_id, content[1:500] AS content, importance, array_to_string(entities, '|') AS entities,
  CASE WHEN fact_id % 2 = 0 AND len(entities) > 1 THEN entities[1][1:100] END AS triple_s,
  CASE WHEN fact_id % 2 = 0 AND len(entities) > 1 THEN entities[1] || ' | meets | ' || entities[2] END AS triple_str FROM fact_entities""")
def tier_rows(spark, sf):
    e = F.col("entities")
    rows = d.fact_entities(spark, sf).select(
        "fact_id", "content", "category", "confidence", "importance", "entities",
        F.array().cast("array<string>").alias("keywords"), F.array().cast("array<string>").alias("persons"),
        F.lit("").alias("topic"), F.lit("").alias("location"),
        F.get(e, 0).alias("triple_s"), F.when(F.col("fact_id") % 2 == 0, "meets").alias("triple_p"), F.get(e, 1).alias("triple_o"),
    )
    return exchange.tier_facts(rows).select(
        "fact_id", "content", "importance", F.array_join(F.coalesce("entities", F.array().cast("array<string>")), "|").alias("entities"), "triple_s", "triple_str"
    )


@query("explicit_facts", "SRC14", """SELECT o_orderkey AS fact_id, CASE WHEN o_orderkey % 3 = 0 THEN 'fact' ELSE lower(o_orderstatus) END AS category, 0.8::DOUBLE AS importance,
  lower(o_orderpriority) || '|' || o_orderstatus AS keywords FROM orders""")
def explicit_facts(spark, sf):
    k = F.col("o_orderkey")
    rows = d.table(spark, sf, "orders").select(
        k.alias("fact_id"), F.concat(F.lit("order "), k).alias("content"),
        F.when(k % 3 == 0, "").otherwise(F.lower("o_orderstatus")).alias("type"),
        F.concat(F.lower("o_orderpriority"), F.lit(" , , "), "o_orderstatus").alias("concepts"),
    )
    return exchange.remembered(rows).select("fact_id", "category", "importance", F.array_join("keywords", "|").alias("keywords"))


@query("given_facts", "SRC14", """SELECT o_orderkey AS fact_id, 'order ' || o_orderkey AS content, CASE WHEN o_orderkey % 3 = 0 THEN 'general' ELSE lower(o_orderstatus) END AS category,
  CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence, NULL::VARCHAR AS error FROM orders WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'missing text' FROM orders WHERE o_orderkey % 5 = 0""")
def given_facts(spark, sf):
    """Facts given in a batch, with defaults, and the rows that cannot be stored."""
    k = F.col("o_orderkey")
    rows = d.table(spark, sf, "orders").select(
        k.alias("fact_id"), F.when(k % 5 != 0, F.concat(F.lit("order "), k)).alias("text"),
        F.when(k % 3 != 0, F.lower("o_orderstatus")).alias("category"), F.when(k % 4 != 0, F.lit(0.75)).alias("importance"),
    )
    facts, bad = exchange.given_facts(rows)
    return facts.select("fact_id", "content", "category", "confidence", F.lit(None).cast("string").alias("error")).unionByName(bad.select("fact_id", "error"), allowMissingColumns=True)


# ---------------------------------------------------------------- cleaning

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("flatten_content", "MSG1", rf"SELECT conv_id, turn, {TRIM.format('text')} AS content FROM conversations")
def flatten_content(spark, sf):
    """Turns wrapped into nested blocks with silent ones, and flattened again."""
    inner = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))))
    nested = F.to_json(F.array(
        F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text")),
        F.struct(F.lit("text").alias("type"), F.when(F.col("turn") % 2 == 0, inner).otherwise(F.col("text")).alias("text")),
        F.struct(F.lit("tool_use").alias("type"), F.lit("run").alias("text")),
    ))
    return d.table(spark, sf, "conversations").select("conv_id", "turn", ct.flatten(nested).alias("content"))


NOISY = """noisy AS (SELECT session_id, seq, role, CASE WHEN seq % 3 = 0 THEN '<cross_session_memory>old' || chr(10) || 'facts</cross_session_memory>  ' ELSE '' END
  || CASE WHEN seq % 2 = 0 THEN '[[reply_to:12]] ' ELSE '' END || content AS content FROM messages)"""


def noisy(spark, sf):
    head = F.when(F.col("seq") % 3 == 0, F.lit("<cross_session_memory>old\nfacts</cross_session_memory>  ")).otherwise(F.lit(""))
    tag = F.when(F.col("seq") % 2 == 0, F.lit("[[reply_to:12]] ")).otherwise(F.lit(""))
    return d.messages(spark, sf).withColumn("content", F.concat(head, tag, F.col("content")))


LEADING = r"(?is)^\s*" + tx.MEMORY_BLOCK + r"\s*"


@query("strip_noise", "MSG2", rf"""WITH {d.MESSAGES}, {NOISY} SELECT session_id, seq,
  {TRIM.format("regexp_replace(regexp_replace(content, " + q(LEADING) + ", ''), " + q('(?i)' + tx.REPLY_TAG) + ", '', 'g')")} AS content FROM noisy""")
def strip_noise(spark, sf):
    return noisy(spark, sf).select("session_id", "seq", tx.strip_noise(F.col("content")).alias("content"))


@query("noise_sessions", "MSG3", """SELECT conv_id AS session_id FROM conversations WHERE conv_id % 7 = 0 AND role = 'user' AND trim(text) <> '' GROUP BY 1""")
def noise_sessions(spark, sf):
    """Every seventh session holds wrappers only."""
    wrapped = F.concat(F.lit("<cross_session_memory>"), "content", F.lit("</cross_session_memory>\nHEARTBEAT ok"))
    m = d.messages(spark, sf).withColumn("content", F.when(F.col("session_id") % 7 == 0, wrapped).otherwise(F.col("content")))
    return messages.noise_sessions(m)


@query("trivial_filter", "MSG4 MSG6", rf"""WITH u AS (SELECT doc_id, line, {TRIM.format('line')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT doc_id, count(*) AS lines, count(*) FILTER (length(t) < 15 OR regexp_matches(t, {q('(?i)^' + tx.GREETING + '$')})) AS trivial,
  count(*) FILTER (starts_with(t, '## Long-Term Memory') OR starts_with(t, '[cron:')) AS injected FROM u GROUP BY ALL""")
def trivial_filter(spark, sf):
    lines = d.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(tx.is_trivial(F.col("line")), 1)).alias("trivial"),
        F.count(F.when(tx.is_injected(F.col("line")), 1)).alias("injected"),
    )


PLAIN = r"[^'\"\s;,\n]+"
KEYWORD_RE2 = (
    r"(?i)\b(password|token|api[_ -]?key|secret)\b(\s*(?:is|=|:|for\s+[^:\n]{1,80}?\s+is)\s*)"
    rf"(?:'{PLAIN}'|\"{PLAIN}\"|{PLAIN})"
)
SECRETS_RE2 = [("github_token", rf"\b{tx.GITHUB_TOKEN}\b"), ("api_key", rf"\b{tx.API_KEY}\b"), ("active_token", rf"(?i)\b{tx.ACTIVE_TOKEN}\b"), ("keyword_value", KEYWORD_RE2)]


@query("secret_report", "MSG7", "WITH h AS (" + " UNION ALL ".join(f"SELECT source, '{r}' AS rule, len(regexp_extract_all(text, {q(p)})) AS n FROM documents" for r, p in SECRETS_RE2) + ") SELECT source, rule, count(*) AS rows, sum(n)::BIGINT AS hits FROM h WHERE n > 0 GROUP BY ALL")
def secret_report(spark, sf):
    return messages.secret_report(d.table(spark, sf, "documents"), "text", "source")


def redact_sql(expr: str) -> str:
    out = expr
    for (_, pattern), by in zip(SECRETS_RE2, ["[REDACTED_GITHUB_TOKEN]", "[REDACTED_API_KEY]", "[REDACTED_TOKEN]", "\\1\\2[REDACTED]"]):
        out = f"regexp_replace({out}, {q(pattern)}, '{by}', 'g')"
    return out


@query("redact", "MSG8", f"SELECT doc_id, {redact_sql('text')} AS text FROM documents")
def redact(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", tx.redact(F.col("text")).alias("text"))


@query("last_turn_text", "MSG9", f"""WITH {d.MESSAGES}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS b FROM messages)
SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY seq) AS turn_text, coalesce(string_agg(content, ' ' ORDER BY seq) FILTER (role = 'user'), '') AS user_text FROM l WHERE b <= 4 GROUP BY 1""")
def last_turn_text(spark, sf):
    m = d.messages(spark, sf).withColumn("text", F.col("content"))
    return messages.last_turn(m).select("session_id", "turn_text", "user_text")


@query("token_estimate", "MSG10", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS tokens FROM documents")
def token_estimate(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).alias("tokens"))


@query("shrink_markdown", "MSG11", rf"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE
  WHEN starts_with({TRIM.format('x')}, '#') OR starts_with({TRIM.format('x')}, 'http') OR starts_with({TRIM.format('x')}, '```') THEN x
  WHEN length({TRIM.format('x')}) > 20 THEN {TRIM.format('x')}[1:120] || '…' WHEN {TRIM.format('x')} <> '' THEN x END) AS lines FROM documents)
SELECT doc_id, array_to_string(list_filter(lines, lambda x: x IS NOT NULL), chr(10)) AS text FROM l""")
def shrink_markdown(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", ct.shrink_markdown(F.col("text")).alias("text"))


@query("keep_last_pairs", "MSG12", f"""WITH {d.MESSAGES}, t AS (SELECT *, CASE WHEN role = 'user' OR lag(role) OVER w IS DISTINCT FROM 'user' THEN 1 ELSE 0 END AS o FROM messages WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
p AS (SELECT *, (sum(o) OVER (PARTITION BY session_id ORDER BY seq))::BIGINT AS pair FROM t), n AS (SELECT session_id, max(pair) AS pairs FROM p GROUP BY 1)
SELECT session_id, seq, pair, pair > pairs - least(pairs, 2) AS kept FROM p JOIN n USING (session_id)""")
def keep_last_pairs(spark, sf):
    return messages.keep_last_pairs(d.messages(spark, sf), keep=2).select("session_id", "seq", "pair", "kept")


@query("cleaning_report", "MSG1 MSG4 MSG6 MSG7", rf"""SELECT 'empty' AS rule, count(*) FILTER ({TRIM.format('text')} = '') AS n FROM conversations
UNION ALL SELECT 'injected', 0 FROM conversations GROUP BY 1 UNION ALL SELECT 'trivial', count(*) FILTER (length({TRIM.format('text')}) < 15) FROM conversations
UNION ALL SELECT 'secret', count(*) FILTER (regexp_matches(text, {q(KEYWORD_RE2)})) FROM conversations UNION ALL SELECT 'wrapper_only', 0 FROM conversations GROUP BY 1""")
def cleaning_report(spark, sf):
    return messages.rule_report(d.messages(spark, sf))


# ---------------------------------------------------------------- tags


@query("language_tag", "SCN1", r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) / greatest(length(text), 1) > 0.12 THEN 'zh'
  WHEN length(regexp_replace(text, '[^\x{3040}-\x{30ff}]', '', 'g')) / greatest(length(text), 1) > 0.12 THEN 'ja' ELSE 'en' END AS language FROM documents""")
def language_tag(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", scene.language(F.col("text")).alias("language"))


def label_sql(expr: str, words: dict) -> str:
    scores = ", ".join(
        "{'n': " + " + ".join(f"contains(lower({expr}), '{w}')::INT" for w in ws) + f", 'o': {-i}, 'l': '{k}'}}" for i, (k, ws) in enumerate(words.items())
    )
    return f"(SELECT CASE WHEN m.n > 0 THEN m.l ELSE 'general' END FROM (SELECT list_max([{scores}]) AS m))"


@query("domain_tag", "SCN2", f"SELECT doc_id, {label_sql('text', scene.DOMAIN_WORDS)} AS domain FROM documents")
def domain_tag(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", scene.domain(F.col("text")).alias("domain"))


@query("capability_flag", "SCN3", f"""WITH t AS (SELECT p_partkey, list_extract(['what tools fit a ', 'can you use ', 'please paint the ', 'How do I run '], (p_partkey % 4 + 1)::INT) || p_name AS text FROM part)
SELECT p_partkey, regexp_matches(text, {q('(?i)' + chr(92) + 'b' + scene.CAPABILITY_QUERY + chr(92) + 'b')}) AS asks FROM t""")
def capability_flag(spark, sf):
    p = F.col("p_partkey")
    text = F.concat(d.pick(["what tools fit a ", "can you use ", "please paint the ", "How do I run "], p % 4), "p_name")
    return d.table(spark, sf, "part").select("p_partkey", scene.asks_capability(text).alias("asks"))


@query("tool_category", "SCN4", f"WITH {d.TOOLS} SELECT tool_key, {label_sql('name || chr(32) || description', scene.TOOL_WORDS)} AS category FROM tools")
def tool_category(spark, sf):
    return d.tools(spark, sf).select("tool_key", scene.tool_category(F.col("name"), F.col("description")).alias("category"))


# ---------------------------------------------------------------- admission

FOLDED = d.fold_sql("text[1:400]")
WORDS_N = r"greatest(len(list_filter(regexp_split_to_array(text[1:400], '\s+'), lambda w: w <> '')), 1)"
ENT = r"\b[A-Z][a-z]{1,}\b|\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b[A-Z]{2,}\b|\b\w+\.(?:py|js|ts|sh|json|md)\b"
A = admission
TURN_VEC = f"""tv AS (SELECT session_id, seq, content AS text, (session_id * 1000 + seq) * 7 % (SELECT n FROM n_vec) AS v FROM messages WHERE role = 'user'),
turns AS (SELECT t.session_id, t.seq, t.text, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] * 0.5 + z[2] * 0.5) AS e
  FROM tv t JOIN embeddings a ON a.vec_id = v JOIN embeddings b ON b.vec_id = (v + 1) % (SELECT n FROM n_vec)),
best AS (SELECT session_id, seq, text, max((1 + list_cosine_similarity(t.e, f.embedding::DOUBLE[])) / 2) AS best FROM turns t, embeddings f GROUP BY ALL)"""
FACTORS = f"""fac AS (SELECT session_id, seq, 1 - best AS novelty, least(1.0::DOUBLE, len(list_distinct(regexp_extract_all({FOLDED}, {q(ENT)}))) / 4) AS entity,
  least(1.0::DOUBLE, len(regexp_extract_all({FOLDED}, {q('(?i)' + chr(92) + 'b(?:' + A.FACT_WORDS + ')' + chr(92) + 'b')})) / greatest({WORDS_N} * 0.15::DOUBLE, 1)) AS fact,
  least(1.0::DOUBLE, len(regexp_extract_all({FOLDED}, {q('(?i)' + chr(92) + 'd{4}[-/]' + chr(92) + 'd{2}[-/]' + chr(92) + 'd{2}' + chr(92) + 'b|' + chr(92) + 'b(?:' + A.DATE_WORDS + ')' + chr(92) + 'b')})) / 2) AS time,
  least(1.0::DOUBLE, len(regexp_extract_all({FOLDED}, {q('(?i)' + chr(92) + 'b(?:' + A.VALUE_WORDS + ')' + chr(92) + 'b')})) * 0.5::DOUBLE) AS type FROM best),
adm AS (SELECT *, 0.25::DOUBLE * novelty + 0.15::DOUBLE * entity + 0.20::DOUBLE * fact + 0.10::DOUBLE * time + 0.30::DOUBLE * type AS score FROM fac)"""


def turn_vectors(spark, sf):
    """User turns with a vector between two stored ones."""
    e = d.embeddings(spark, sf).select("vec_id", "embedding")
    n = e.count()
    t = d.messages(spark, sf).filter("role = 'user'").withColumn("vec_id", (F.col("session_id") * 1000 + F.col("seq")) * 7 % n)
    t = t.join(e, "vec_id").withColumn("vec_id", (F.col("vec_id") + 1) % n).join(e.withColumnRenamed("embedding", "other"), "vec_id")
    return t.select(
        (F.col("session_id") * 1000 + F.col("seq")).alias("query_id"), "session_id", "seq", F.col("content").alias("text"),
        vectors.blend("embedding", "other").alias("embedding"),
    )


@query("admission_factors", "ADM1", f"""WITH {d.MESSAGES}, n_vec AS (SELECT count(*) AS n FROM embeddings), {TURN_VEC}, {FACTORS}
SELECT session_id, seq, round(novelty, 4) AS novelty, round(entity, 4) AS entity, round(fact, 4) AS fact, round(time, 4) AS time, round(type, 4) AS type, round(score, 4) AS score, score >= 0.4 AS admitted FROM adm""")
def admission_factors(spark, sf):
    turns = turn_vectors(spark, sf)
    best = vectors.knn(d.embeddings(spark, sf), turns, 3, "vec_id").groupBy("query_id").agg(F.max("score").alias("best"))
    out = admission.admit(turns.join(best, "query_id", "left"), "text", "best")
    r = lambda c, name: F.round(c, 4).alias(name)
    return out.select("session_id", "seq", *[r(f"f_{k}", k) for k in admission.WEIGHTS], r("admission", "score"), "admitted")


@query("ingest_actions", "ADM2", f"""WITH {d.MESSAGES}, n_vec AS (SELECT count(*) AS n FROM embeddings), {TURN_VEC}
SELECT session_id, seq, CASE WHEN best > 0.9 THEN 'skip' WHEN best > 0.85 THEN 'check' ELSE 'insert' END AS action FROM best""")
def ingest_actions(spark, sf):
    """Turns against the stored vectors, thresholds moved to where this data has both cases."""
    turns = turn_vectors(spark, sf)
    best = vectors.knn(d.embeddings(spark, sf), turns, 1, "vec_id").select("query_id", "score")
    return turns.join(best, "query_id", "left").select("session_id", "seq", admission.ingest_action(F.col("score"), 0.9, 0.85).alias("action"))


EVOLVE = f"""{d.FACT_ENTITIES}, m AS (SELECT fact_id - 1 AS fact_id, entities AS kw, entities[1] AS topic FROM fact_entities WHERE fact_id % 3 = 1),
base AS (SELECT fact_id, list_transform(entities, lambda x: lower(x)) AS kw, 'note' AS topic FROM fact_entities)"""


@query("evolve_facts", "ADM3", f"""WITH {EVOLVE} SELECT fact_id, array_to_string(CASE WHEN m.kw IS NOT NULL AND len(m.kw) > 0 THEN (list_sort(list_distinct(list_concat(b.kw, m.kw))))[1:12] ELSE b.kw END, '|') AS keywords,
  CASE WHEN m.kw IS NOT NULL AND length(m.topic) > 4 THEN m.topic[1:100] ELSE b.topic END AS topic FROM base b LEFT JOIN m USING (fact_id)""")
def evolve_facts(spark, sf):
    f = d.fact_entities(spark, sf)
    stored = f.select("fact_id", F.transform("entities", F.lower).alias("keywords"), F.lit("note").alias("topic"))
    new = f.filter("fact_id % 3 = 1").select((F.col("fact_id") - 1).alias("fact_id"), F.col("entities").alias("keywords"), F.get("entities", F.lit(0)).alias("topic"))
    return admission.evolve(stored, new).select("fact_id", F.array_join("keywords", "|").alias("keywords"), "topic")


CONTRA = f"""{d.STATEMENTS}, s AS (SELECT turn_id, session_id, text || ' It ' || CASE turn_id % 3 WHEN 0 THEN 'is not' WHEN 1 THEN 'is' ELSE 'has' END || ' here.' AS t, 'Order ' || (turn_id % 4) AS ent FROM statements),
pr AS (SELECT a.turn_id AS old_id, lower(a.t) AS o, lower(b.t) AS n FROM s a JOIN s b ON a.turn_id + 1 = b.turn_id AND (a.turn_id // 2 + 1) = (b.turn_id // 2 + 1))"""
OPP = " OR ".join(f"(contains(o, '{a}') AND contains(n, '{b}')) OR (contains(n, '{a}') AND contains(o, '{b}'))" for a, b in admission.OPPOSITES)


@query("contradictions", "ADM4", f"WITH {CONTRA} SELECT DISTINCT old_id FROM pr WHERE {OPP}")
def contradictions(spark, sf):
    """Pairs of neighbouring statements that share an entity; the older of an opposed pair is superseded."""
    word = d.pick(["is not", "is", "has"], F.col("turn_id") % 3)
    s = d.statements(spark, sf).withColumn("t", F.concat("text", F.lit(" It "), word, F.lit(" here.")))
    ents = F.array(F.concat(F.lit("Pair "), F.floor(F.col("turn_id") / 2)))
    a = s.select(F.col("turn_id").alias("old_id"), (F.col("turn_id") + 1).alias("new_id"), F.col("t").alias("old"), ents.alias("old_entities"))
    b = s.select(F.col("turn_id").alias("new_id"), F.col("t").alias("new"), F.transform(ents, F.upper).alias("new_entities"))
    gone, _ = admission.contradiction_results(a.join(b, "new_id"))
    return gone.select(F.col("fact_id").alias("old_id"))


@query("contradiction_edges", "ADM4", f"""WITH {CONTRA}, hit AS (SELECT DISTINCT old_id FROM pr WHERE {OPP}),
x AS (SELECT 'Pair ' || (old_id // 2) AS a, 'Box ' || (old_id % 5) AS b, 'Pair ' || (old_id // 2) AS c, 'Crate ' || (old_id % 3) AS e FROM hit),
ed AS (SELECT unnest([{{'s': a, 'd': e}}, {{'s': b, 'd': c}}, {{'s': b, 'd': e}}]) AS p FROM x)
SELECT p.s AS src, p.d AS dst, 'contradicts' AS type FROM ed UNION SELECT p.d, p.s, 'contradicts' FROM ed""")
def contradiction_edges(spark, sf):
    """The edges of opposed statements, both ways."""
    word = d.pick(["is not", "is", "has"], F.col("turn_id") % 3)
    s = d.statements(spark, sf).withColumn("t", F.concat("text", F.lit(" It "), word, F.lit(" here.")))
    pair = lambda k: F.concat(F.lit("Pair "), F.floor(k / 2))
    turn = F.col("turn_id")
    a = s.select(turn.alias("old_id"), (turn + 1).alias("new_id"), F.col("t").alias("old"), F.array(pair(turn), F.concat(F.lit("Box "), turn % 5)).alias("old_entities"))
    b = s.select(turn.alias("new_id"), F.col("t").alias("new"), F.array(pair(turn), F.concat(F.lit("Crate "), (turn - 1) % 3)).alias("new_entities"))
    _, edges = admission.contradiction_results(a.join(b, "new_id"))
    return edges.select("src", "dst", "type")


# ---------------------------------------------------------------- extraction


def rules_sql(text: str) -> str:
    parts = [
        f"list_transform(regexp_extract_all({text}, {q(p)}), lambda s: {{'c': '{c}', 's': trim(s, chr(32) || chr(10) || chr(9) || chr(13))[1:200]}})"
        for c, p in extraction.FACT_RULES
    ]
    return "flatten([" + ", ".join(parts) + "])"


RULES = f"""{d.STATEMENTS}, raw AS (SELECT turn_id, session_id, ts, list_filter({rules_sql('text')}, lambda x: x.s <> '') AS f FROM statements),
uniq AS (SELECT turn_id, list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: y.s), x.s) = i) AS f FROM raw)"""


@query("rule_facts", "EXT1", f"WITH {RULES} SELECT turn_id, x.c AS category, x.s AS content FROM (SELECT turn_id, unnest(f) AS x FROM uniq)")
def rule_facts(spark, sf):
    return extraction.rule_facts(d.statements(spark, sf), "turn_id", dedup=False).select("turn_id", "category", "content")


DEDUP = f"""{RULES}, kept AS (SELECT turn_id, list_reduce(list_prepend([]::STRUCT(c VARCHAR, s VARCHAR)[], list_transform(f, lambda x: [x])),
  lambda k, x: CASE WHEN len(list_filter(k, lambda y: contains(lower(y.s), lower(x[1].s)) OR contains(lower(x[1].s), lower(y.s)))) > 0 THEN k ELSE list_concat(k, x) END) AS k FROM uniq)"""


@query("rule_facts_distinct", "EXT2", f"WITH {DEDUP} SELECT turn_id, x.c AS category, x.s AS content FROM (SELECT turn_id, unnest(k) AS x FROM kept)")
def rule_facts_distinct(spark, sf):
    return extraction.rule_facts(d.statements(spark, sf), "turn_id").select("turn_id", "category", "content")


def answers(spark, sf):
    """Model output per order: fenced, every third one cut off inside its last object."""
    k = F.col("o_orderkey")
    head = F.concat(
        F.lit('```json\n[{"lossless_restatement": "Customer '), "o_custkey", F.lit(" placed order "), k,
        F.lit('", "category": "work", "importance": 0.3, "keywords": ["order"], "triple": {"s": "Customer '), "o_custkey",
        F.lit('", "p": "placed", "o": "order '), k, F.lit('"}},\n{"content": "short"}, {"content": "The password is long enough", "category": "credential"}, {"content": "Order '),
        k, F.lit(' has status '), "o_orderstatus", F.lit('", "importance": 1.7, "triple": {"s": "Order"}}, {"content": "Order '), k, F.lit(" is the last one"),
    )
    tail = F.when(k % 3 == 0, F.lit("")).otherwise(F.lit('", "category": "context"}]\n```'))
    return d.table(spark, sf, "orders").select(k.alias("answer_id"), F.concat(head, tail).alias("raw"))


@query("model_facts", "EXT3 EXT4", """SELECT o_orderkey AS answer_id, 'Customer ' || o_custkey || ' placed order ' || o_orderkey AS content, 'work' AS category, 0.65::DOUBLE AS importance, 'order ' || o_orderkey AS triple_o FROM orders
UNION ALL SELECT o_orderkey, 'Order ' || o_orderkey || ' has status ' || o_orderstatus, 'general', 1.0, NULL FROM orders
UNION ALL SELECT o_orderkey, 'Order ' || o_orderkey || ' is the last one', 'context', 0.5, NULL FROM orders WHERE o_orderkey % 3 <> 0""")
def model_facts(spark, sf):
    return extraction.model_facts(answers(spark, sf), "answer_id", "raw").select("answer_id", "content", "category", "importance", "triple_o")


TYPE_CASE = "CASE " + " ".join(f"WHEN list_has_any(c, {m}) THEN '{t}'" for t, m in extraction.EPISODE_TYPES) + " ELSE 'general' END"


@query("episode_type", "EXT5", f"WITH {RULES} SELECT turn_id, {TYPE_CASE} AS ep_type FROM (SELECT turn_id, list_transform(f, lambda x: x.c) AS c FROM uniq WHERE len(f) > 0)")
def episode_type(spark, sf):
    facts = extraction.rule_facts(d.statements(spark, sf), "turn_id", dedup=False)
    return extraction.type_episodes(facts, "turn_id")


@query("episode_chain", "EXT6 STR6", f"""WITH {d.STATEMENTS} SELECT turn_id AS episode_id, lag(turn_id) OVER w AS prev_episode_id, lead(turn_id) OVER w AS next_episode_id
FROM statements WINDOW w AS (PARTITION BY session_id ORDER BY ts, turn_id)""")
def episode_chain(spark, sf):
    eps = d.statements(spark, sf).withColumnRenamed("turn_id", "episode_id").drop("text")
    return extraction.chain_episodes(eps, F.date_trunc("month", "ts")).select("episode_id", "prev_episode_id", "next_episode_id")


TOOLS_IN = "array_to_string(list_filter(" + str(extraction.KNOWN_TOOLS) + ", lambda t: contains(lower(x.s), t))[1:8], ',')"


@query("procedure_facts", "EXT7", f"WITH {RULES} SELECT turn_id, x.s AS task, {TOOLS_IN} AS tools FROM (SELECT turn_id, unnest(f) AS x FROM uniq) WHERE x.c = 'procedure'")
def procedure_facts(spark, sf):
    facts = extraction.rule_facts(d.statements(spark, sf), "turn_id", dedup=False)
    return extraction.procedure_facts(facts).select("turn_id", "task", F.array_join("tools_used", ",").alias("tools"))


@query("query_entities", "EXT8", f"WITH r AS (SELECT doc_id, {d.entities_sql('text')} AS e FROM documents) SELECT doc_id, len(list_distinct(e)) AS n, array_to_string(({d.distinct_in_order_sql('e')})[1:3], '|') AS first_three FROM r")
def query_entities(spark, sf):
    found = d.table(spark, sf, "documents").select("doc_id", tx.capitalised_entities(F.col("text")).alias("e"))
    return found.select("doc_id", F.size("e").cast("bigint").alias("n"), F.array_join(F.slice("e", 1, 3), "|").alias("first_three"))


@query("content_window", "EXT10", "SELECT doc_id, length(text[1:2000]) AS episode_chars, length(CASE WHEN length(text) <= 280 THEN text ELSE text[1:180] END) AS summary_chars FROM documents")
def content_window(spark, sf):
    t = F.col("text")
    return d.table(spark, sf, "documents").select(
        "doc_id", F.length(F.substring(t, 1, ct.EPISODE_CHARS)).cast("bigint").alias("episode_chars"),
        F.length(ct.summary_fallback(t)).cast("bigint").alias("summary_chars"),
    )


@query("hashed_embedding", "EMB1", r"SELECT doc_id, 384 AS dims, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def hashed_embedding(spark, sf):
    v = embedding.hashed(d.table(spark, sf, "documents").select("doc_id", "text"), "text")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.select("doc_id", F.size("embedding").alias("dims"), F.round(F.sqrt(square), 3).alias("norm"))
