"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Two lists judge a url: rules, (host, path) prefixes that allow or block, and
listed canonical urls, which are blocked where no rule fits. Both become keys of
one blocked Bloom filter: a key sets one bit in each of the eight 64-bit words
of one block. A url probes the keys it could hit; what the filter lets through
meets the listed keys themselves in a hash join, which removes false positives.

Each distinct (host, path) is judged once, however many rows hold it, and the
verdicts join back. The filter takes ``BITS_PER_KEY`` bits a key; it is broadcast
while it has at most ``BROADCAST_BLOCKS`` blocks (64 bytes each), and beyond that
probes and blocks meet in a shuffle join on the block number.

Defined cases: a null url, or one without ``://``, has empty host and path, fits
no rule and is allowed. Repeated rows are judged alike. Of rules that fit, the
longest wins; of equally long ones the blocking one. Empty tables give empty
results. Other columns of the given tables are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 8
BITS_PER_KEY = 16
BROADCAST_BLOCKS = 1 << 16
BROADCAST_KEYS = 100_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and standard ports, path without closing slashes."""
    return F.concat(F.regexp_replace(host, r"^www\.|:(80|443)$", ""), F.regexp_replace(path, "/+$", ""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as ``(action, "host/path")``; the path starts at the first slash."""
    table = spark.createDataFrame(rules, "action string, rule string")
    return table.select("action", "rule", F.substring_index("rule", "/", 1).alias("host"), F.regexp_extract("rule", "/.*$", 0).alias("path"))


def _listed_keys(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """key, action, rule: of rules and of distinct listed urls."""
    of_rules = rules.select(_rule_key(F.col("host"), F.col("path")).alias("key"), "action", "rule")
    of_urls = listed.select(_url_key(F.col("url")).alias("key")).where("key is not null").distinct()
    return of_rules.unionByName(of_urls.select("key", F.lit("block").alias("action"), F.lit(None).cast("string").alias("rule")))


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), host, path)


def _url_key(canonical_url: Column) -> Column:
    return F.concat(F.lit("url "), canonical_url)


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))


def _bit(key: str, word: int) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(F.lit(word // 8), F.col(key)), 6 * (word % 8)).bitwiseAND(F.lit(63))
    return F.expr("1L"), place


def _word(key: str, word: int) -> Column:
    one, place = _bit(key, word)
    return F.call_function("shiftleft", one, place.cast("int"))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row per block that holds a key: its number and eight words of bits."""
    return keys.groupBy(_block("key", blocks).alias("block")).agg(
        *[F.bit_or(_word("key", w)).alias(f"word{w}") for w in range(WORDS)]
    )


def possible(probes: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Probes whose bits are all set in their block."""
    hit = F.lit(True)
    for w in range(WORDS):
        hit = hit & (F.col(f"word{w}").bitwiseAND(_word("key", w)) == _word("key", w))
    side = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    return probes.withColumn("block", _block("key", blocks)).join(side, "block").where(hit).select(*probes.columns)


def _probes(urls: DataFrame, path_lengths: list[int]) -> DataFrame:
    """Each (host, path) with the keys it could hit: host and parent domains x path prefixes of the rules' lengths, and its own url."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in path_lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    of_rules = F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: _rule_key(h, p))))
    own = F.array(_url_key(canonical(F.col("host"), F.col("path"))))
    return urls.where("host <> ''").select("host", "path", F.explode(F.concat(of_rules, own)).alias("key"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (or null), verdict of every row of ``pages``.

    ``rules``: action, rule, host, path. ``listed``: url, canonical.
    """
    urls = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keys = _listed_keys(rules, listed)
    n_keys = keys.count()
    blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))
    # As many numbers as rules have path lengths; rule paths are at most some hundred characters long.
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())
    probes = _probes(urls.select("host", "path").distinct(), lengths)
    maybe = possible(probes, bloom_filter(keys, blocks), blocks)
    hits = maybe.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, "key")
    order = F.struct(F.length("rule").alias("n"), (F.col("action") == "block").alias("block"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), F.struct(F.col("rule").isNotNull(), order)).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict")
    )
