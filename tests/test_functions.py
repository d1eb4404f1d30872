"""Hand-made rows with exact expected values."""

import math

from pyspark.sql import functions as F

from keepsake.functions import content as ct
from keepsake.functions import decay, depth, scene
from keepsake.functions import text as tx
from keepsake.operators import admission, extraction, ranking

def now():
    return F.lit("2024-02-01").cast("timestamp")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_heat_rows(spark):
    ts = lambda days: F.lit("2024-02-01").cast("timestamp") - F.make_dt_interval(F.lit(days))
    assert value(spark, ranking.heat(ts(0), F.lit(0), now())) == 1.0
    assert abs(value(spark, ranking.heat(ts(30), F.lit(0), now())) - math.exp(-1)) < 1e-12
    assert abs(value(spark, ranking.heat(ts(1), F.lit(10), now())) - math.exp(-1 / 30) * (1 + 0.25 * math.log1p(10))) < 1e-12
    assert value(spark, ranking.heat(ts(1000), F.lit(0), now())) == 0.01


def test_secrets_are_found_and_redacted(spark):
    rows = [
        "key is ghp_abcdefghijklmnop now", "use sk-test-0123456789abcdef", "see token-active-42 there", "my password is 'hunter22', ok",
        "nothing here",
    ]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(tx.contains_secret(F.col("t")).alias("s"), tx.redact(F.col("t")).alias("r")).collect()
    assert [g.s for g in got] == [True, True, True, True, False]
    assert got[0].r == "key is [REDACTED_GITHUB_TOKEN] now"
    assert got[1].r == "use [REDACTED_API_KEY]"
    assert got[2].r == "see [REDACTED_TOKEN] there"
    assert got[3].r == "my password is [REDACTED], ok"


def test_noise_and_trivial(spark):
    wrapped = "<cross_session_memory>a\nb</cross_session_memory>"
    assert value(spark, tx.only_noise(F.lit(wrapped + "\nHEARTBEAT ok")))
    assert not value(spark, tx.only_noise(F.lit(wrapped + " and more")))
    assert value(spark, tx.strip_noise(F.lit(wrapped + " [[reply_to:4]] hello there"))) == "hello there"
    assert value(spark, tx.is_trivial(F.lit("thanks!!!")))
    assert not value(spark, tx.is_trivial(F.lit("please look at the build log")))
    assert value(spark, tx.is_injected(F.lit("  [cron: nightly")))


def test_flatten_nested_blocks(spark):
    text = '[{"type":"thinking","text":"x"},{"type":"text","text":"[{\\"type\\":\\"text\\",\\"text\\":\\"inner\\"}]"},{"type":"text","text":"outer"},"plain"]'
    assert value(spark, ct.flatten(F.lit(text))) == "inner outer plain"
    assert value(spark, ct.flatten(F.lit('{"type":"tool_result","content":"x"}'))) == ""
    assert value(spark, ct.flatten(F.lit("[not json"))) == "[not json"


def test_cjk_rows(spark):
    assert value(spark, scene.language(F.lit("我住在上海, ok"))) == "zh"
    assert value(spark, scene.language(F.lit("これはテストです"))) == "ja"
    assert value(spark, tx.search_tokens(F.lit("Redis 向量 and été abc"))) == ["redis", "and", "abc", "向量"]
    facts = value(spark, extraction.rule_matches(F.lit("我叫小明。我喜欢茶。截止是周五。")))
    assert [(f.category, f.content) for f in facts][:1] == [("identity", "我叫小明。")]
    assert "preference" in {f.category for f in facts}


def test_domain_ties_take_the_first(spark):
    assert value(spark, scene.domain(F.lit("docker and redis"))) == "devops"
    assert value(spark, scene.domain(F.lit("stock and python"))) == "trading"
    assert value(spark, scene.domain(F.lit("zzz"))) == "general"


def test_depth(spark):
    assert value(spark, depth.facts_wanted(F.lit("a"), F.lit(6))) == 3
    assert value(spark, depth.episodes_wanted(F.lit("a"), F.lit(6))) == 6
    assert value(spark, depth.facts_wanted(F.lit("what when where who how " + "w " * 20), F.lit(6))) == 5


def test_confidence(spark):
    df = spark.createDataFrame(
        [(1.0, "warning", 3, "2024-01-02", None), (1.0, "identity", 1, "2024-02-01", None), (0.9, "rule", 2, "2024-02-01", "x")],
        "confidence double, category string, source_count int, t string, superseded_by string",
    ).withColumn("ts", F.col("t").cast("timestamp")).withColumn("last_confirmed_ts", F.col("ts"))
    got = [r.v for r in df.select(decay.effective_confidence(now()).alias("v")).collect()]
    assert got == [round(math.exp(-1), 4), 0.6, 0.0]


def test_contradiction(spark):
    e = F.array(F.lit("Redis"))
    low = F.array(F.lit("redis"))
    assert value(spark, admission.contradicts(F.lit("Redis is not fast"), F.lit("redis is fast"), e, low))
    assert not value(spark, admission.contradicts(F.lit("Redis was fast"), F.lit("redis was slow"), e, low))
    assert not value(spark, admission.contradicts(F.lit("x is not y"), F.lit("x is y"), e, F.array(F.lit("b"))))


def test_broken_model_output(spark):
    raw = '```json\n[{"content": "a whole fact here", "category": "rule", "importance": 0.1}, {"content": "cut off in the mid'
    df = spark.createDataFrame([(1, raw), (2, "no json")], "id int, raw string")
    got = extraction.model_facts(df, "id", "raw").collect()
    assert [(r.id, r.content, r.importance) for r in got] == [(1, "a whole fact here", 0.8)]


def test_entities_of_very_long_runs(spark):
    """A run of capitalised words longer than a task's stack; ends and boundaries as before."""
    texts = ["Abcd " * 20000, "Foo Bar9 Baz\n Qux. Élan Éa Abé xAb A Bc", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(tx.capitalised_entities(F.col("text")).alias("e")).collect()
    assert rows[0].e == [("Abcd " * 20000).strip()]
    assert rows[1].e == ["Foo", "Baz\n Qux", "Bc"]
    assert rows[2].e == [] and rows[3].e is None
