"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import curve_packing, decontamination, exact_dedup, filter_audit, jaccard_join, language_id, line_dedup
from keepsake.llm import periodic_runs, quality_rules, secret_scans, token_store, url_filters, warc_fixity
from keepsake.llm.common import table
from keepsake.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
# Listed for the query: urls of pages whose markup holds runs of symbols, a mark of generated spam.
SPAM = "&amp;&amp;&amp;"

OP1 = r"""
with u as (
  select page_id, html, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
c as (
  select *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') as canonical from h),
listed as (select distinct canonical from c where host <> '' and contains(html, '&amp;&amp;&amp;')),
rules(action, rule, rhost, rpath) as (values
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
urls as (select distinct host, path, canonical from c),
best as (
  select host, path, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
  from urls join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by host, path)
select c.page_id, c.host, c.path, b.rule,
       coalesce(b.action, case when l.canonical is null then 'allow' else 'block' end) as verdict
from c left join best b on c.host = b.host and c.path = b.path
       left join listed l on c.canonical = l.canonical and c.host <> ''
"""


@query("op1_url_filters", OP1)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = url_filters.host_of(F.col("url")), url_filters.path_of(F.col("url"))
    listed = pages.where(F.contains("html", F.lit(SPAM)) & (host != "")).select(url_filters.canonical(host, path).alias("url"))
    return url_filters.judge(pages, url_filters.rule_table(spark, RULES), listed)


OP5 = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (
  select doc_id, i, count(*) over (partition by doc_id, words[i:i + 4]) as n
  from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w)),
cov as (
  select doc_id, sum(least(5, coalesce(nxt - i, 5))) as n_repeat_words
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from win where n > 1) group by doc_id),
m as (
  select w.doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         len(lines) as n_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from w left join cov on w.doc_id = cov.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or n_symbols > n_words or (n_lines >= 4 and 2 * n_dup_lines > n_lines)) as kept
from m
"""


@query("op5_quality_rules", OP5)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_secret_scans")
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_token_store")
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_store.read(spark, path, token_store.size_and_crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


@query("op2_curve_packing")
def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = curve_packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


# The replica of the query is damaged where this holds: one character in the middle of a page is replaced.
DAMAGED = "pmod(xxhash64(page_id, url), 97) = 0"


@query("op9_warc_fixity")
def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc_fixity.write_warc(pages, f"{path}/original")
    broken = F.when(F.expr(DAMAGED), F.overlay("html", F.lit("\u00a4"), F.expr("length(html) div 2 + 1"))).otherwise(F.col("html"))
    warc_fixity.write_warc(pages, f"{path}/replica", broken)
    return warc_fixity.audit(*(warc_fixity.records(spark, f"{path}/{side}") for side in ("original", "replica")))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.counted(table(spark, sf_dir, "documents"), least_words=line_dedup.EVERY).select("row.doc_id", "n_lines", "n_dropped", "text")


def with_cycles(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; the words of one document in ten repeat with a period from some word on.

    Which documents, from where and with what period follows from crc32 of the id; a null id is left as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    cycled = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    cycled = cycled.select("doc_id", "text", "words", F.size("words").cast("bigint").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    cycled = cycled.select("doc_id", "text", "words", "n", "g", F.expr("if(n > 0, g % n, 0)").alias("a"))
    cycled = cycled.select("doc_id", "text", "words", "n", "a", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    again = F.expr("transform(sequence(0L, n - 1), i -> get(words, cast(if(i < a, i, a + (i - a) % p) as int)))")
    return cycled.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(with_cycles(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    shown = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return shown.select(
        "doc_id",
        "n_runs",
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


OP12 = r"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as part from documents),
t as (select text, min(doc_id) as least from d group by text),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
m as (
  select w.part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
         case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
         + case when 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) then 4 else 0 end
         + case when regexp_matches(w.text, '[#$%&*|]') then 8 else 0 end + case when t.least < w.doc_id then 16 else 0 end as bits
  from w join t on w.text = t.text left join l on w.doc_id = l.doc_id),
c as (select part, bits, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, bits),
f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
  select a.letter || b.letter || x.letter || y.letter || z.letter as filter_order
  from f a, f b, f x, f y, f z where a.bit + b.bit + x.bit + y.bit + z.bit = 31 and (a.bit | b.bit | x.bit | y.bit | z.bit) = 31),
s as (
  select filter_order, cast(step as integer) as step, f.bit,
         coalesce((select sum(g.bit) from f g where contains(substr(filter_order, 1, cast(step as integer) - 1), g.letter)), 0) as gone
  from o, range(1, 6) r(step), f where f.letter = substr(filter_order, cast(step as integer), 1)),
k as (
  select part, filter_order, step, bit,
         sum(case when bits & cast(gone as integer) = 0 and bits & bit = 0 then n else 0 end) as kept,
         sum(case when bits & cast(gone as integer) = 0 and bits & bit > 0 then n else 0 end) as removed,
         sum(case when bits & cast(gone as integer) > 0 and bits & bit > 0 then n else 0 end) as redundant,
         sum(case when bits = bit then n else 0 end) as unique_fails,
         sum(case when bits & cast(gone as integer) = 0 and bits & bit > 0 then good else 0 end) as good_lost,
         sum(case when bits & cast(gone as integer) = 0 and bits & bit > 0 then toxic else 0 end) as toxic_lost
  from c, s group by part, filter_order, step, bit)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from k
"""


@query("op12_filter_audit", OP12)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13 = """
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
       doc_id = max(doc_id) over (partition by text) as kept, sha256(text) as text_sha256
from d
"""


@query("op13_exact_dedup", OP13)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), keep=exact_dedup.GREATEST)
