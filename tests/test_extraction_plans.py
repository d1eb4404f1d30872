"""Rules and answers are matched once per row, and the words that let a rule be skipped miss no match."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from keepsake.functions import text as tx
from keepsake.operators import extraction

SAID = [
    "My name is Ann Lee", "I'M Bob", "I am working for Acme", "I work as a cook.", "Im a baker at Home", "I'm an old painter of walls.", "i've been teaching at Yale",
    "I have been a nurse for 12 years", "for Acme, I'm", "at Acme Corp my role", "I stay in Rome", "I'm from Oslo", "I moved to to Bern.", "I own a flat in Nice",
    "they rented my place in Paris last", "I did my MBA at at Bonn", "my PhD was from Kiel", "I've been out for two weeks", "I DISLIKE tea", "my neighbor Tom", "my goal is peace",
    "Important: call", "NEVER use it", "the token for x is abc", "by May 2024", "Due date 2024-01-02", "via curl to load it", "enabled the new plugin", "upgrade to v2",
    "the active branch is main", "to build it, we run make.", "the right way to go is to walk.", "steps for tea: boil.", "when hot, call Tom.", "我叫小明。我在学校工作。", "我是老师。我的职位是经理。",
    "我在一处住北京。我目前在上海。", "我就读于北大学习。我的学校是北大。", "我已经学习3年。我讨厌茶。", "我的妻子小红。", "注意：开会。从不喝酒。", "截止是周五。deadline: 周五。", "nothing", "",
]


def test_skipped_rules_lose_no_match(spark):
    rows = [(i, " ".join(p)) for i, p in enumerate([*((s,) for s in SAID), *itertools.pairwise(SAID), *((s.upper(), s.lower()) for s in SAID)])] + [(-1, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.f for r in df.select("id", extraction.rule_matches(F.col("text")).alias("f")).collect()}
    plain = df.select("id", *[tx.all_matches(F.col("text"), p).alias(str(i)) for i, (_, p) in enumerate(extraction.FACT_RULES)]).collect()
    used = set()
    for row in plain:
        want = {}
        for i, (category, _) in enumerate(extraction.FACT_RULES):
            for m in row[str(i)] or []:
                want.setdefault(m.strip(" \n\t")[:200], category)
                used.add(i)
        want.pop("", None)
        assert (got[row.id] is None) == (row.id == -1)
        assert [(f.content, f.category) for f in got[row.id] or []] == list(want.items())
    assert len(used) == len(extraction.FACT_RULES)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_matched_once_per_row(spark):
    said = spark.createDataFrame([(1, "a", "I like tea")], "id int, x string, y string")
    facts = extraction.rule_facts(said.select("id", F.concat("x", "y").alias("text")), "id", dedup=False)
    for df in (facts, extraction.procedure_facts(facts), extraction.type_episodes(facts, "id")):
        assert plan(df).count("regexp_extract_all") <= len(extraction.FACT_RULES)


def test_answers_are_parsed_once_per_row(spark):
    p = plan(extraction.model_facts(spark.createDataFrame([(1, "[]")], "id int, raw string"), "id", "raw"))
    assert p.count("regexp_extract(") == 2
    assert p.count("from_json") + p.count("JsonToStructs") == 1


def test_streamed_turns_are_made_once(spark, tmp_path, monkeypatch):
    from keepsake.catalog import streams
    from keepsake.plans import ingest

    spark.sql("select id % 3 o_custkey, id o_orderkey, date'2024-01-01' o_orderdate, 'O' o_orderstatus, '1-URGENT' o_orderpriority from range(24)").coalesce(1).write.parquet(str(tmp_path / "o"))
    next((tmp_path / "o").glob("*.parquet")).rename(tmp_path / "orders.parquet")
    seen = spark.sparkContext.accumulator(0)
    own = ingest.turns

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def turns(*a, **k):
        made = own(*a, **k)
        return made.mapInArrow(counted, made.schema)

    monkeypatch.setattr(ingest, "turns", turns)
    out = streams.stream_ingest(spark, str(tmp_path)).collect()
    assert sum(r.n for r in out) == seen.value == 6


def test_a_batch_of_near_copies_forms_no_pairs(spark, monkeypatch):
    from keepsake.operators import similarity
    from keepsake.plans import ingest

    def said(i):
        return f"I like tea from shop {'x' * (i % 3)}{i // 30}, I always use bash. My name is Tom Lee and the deadline is 2024-03-01."

    rows = spark.createDataFrame([(i // 4, i, "user", said(i), 1_000_000 * (100 - i)) for i in range(240)], "session_id bigint, seq bigint, role string, content string, at bigint")
    rows = rows.withColumn("ts", F.timestamp_micros("at")).drop("at")
    want = [sorted(r.content for r in t.collect()) for t in _tables(ingest.run(rows, dims=64))]
    monkeypatch.setattr(similarity, "similar_pairs", None)
    got = ingest.run(rows, dims=64)
    assert [sorted(r.content for r in t.collect()) for t in _tables(got)] == want
    assert 0 < len(want[0]) < 60
    assert got.facts.where("embedding is null").isEmpty()


def _tables(done):
    return done.episodes, done.facts, done.procedures


def test_one_pass_settles_what_pairs_would(spark, monkeypatch):
    import numpy as np

    from keepsake.operators import similarity

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    vectors = np.vstack([centres[rng.integers(30, size=300)] + rng.normal(scale=0.15, size=(300, 8)), rng.normal(size=(60, 8)), np.zeros((2, 8))]).astype(np.float32)
    rows = [(int(i), [float(x) for x in v], int(t) if t else None) for i, (v, t) in enumerate(zip(vectors, rng.integers(0, 5, size=len(vectors))))]
    df = spark.createDataFrame(rows, "id bigint, vec array<float>, at bigint").repartition(3)
    unit = vectors.astype(np.float64) / np.maximum(np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True), 1e-30)
    near = np.round(unit @ unit.T, 12) >= 0.9
    want = []
    for i, _, _ in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        if not near[i, want].any():
            want.append(i)
    for block in (8192, 40, 7):
        monkeypatch.setattr(similarity, "FIRST_ROWS", block)
        done, left = similarity.settle(df, 0.9, [F.asc_nulls_last("at"), F.asc("id")], "id", "vec")
        keeper = {r.id: r.keeper_id for r in done.collect()}
        got = {i for i, k in keeper.items() if i == k}
        # What goes has the first that stays and is near.
        assert all(k == next(w for w in want if near[i, w]) for i, k in keeper.items() if i != k)
        rest = {r.id for r in left.collect()} if left is not None else set()
        assert left is None or block < 8192
        assert rest or block > 7
        # What is left is near nothing that stays, and holds all others that would stay.
        assert got <= set(want) and set(want) - got <= rest and not near[np.ix_(sorted(rest), sorted(got))].any()


def test_message_text_is_made_once_per_row(spark):
    from keepsake.operators import messages

    said = spark.createDataFrame([(1, 1, "user", "  [cron: a"), (1, 2, "user", " x "), (1, 3, "user", None)], "session_id int, seq int, role string, content string")
    assert [r.text for r in messages.clean(said).collect()] == ["x"]
    assert plan(messages.clean(said)).lower().count("reply_to_current") == 1


def test_words_with_common_beginnings():
    import re

    words = ["use", "uses", "used", "i am", "i'm", "rule:", "a"]
    found = lambda p, text: re.findall(rf"(?i)(?<!\w)(?:{p})(?!\w)", text)
    for text in ("Use uses used user", "I'm here, i am. rule: a", "rule:x re use", ""):
        assert found(tx.any_of(words), text) == found("|".join(words), text)
