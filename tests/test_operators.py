"""Properties and brute-force comparisons on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.functions import content
from keepsake.operators import admission, evaluation, extraction, graph, lexical, lifecycle, messages, packing, ranking, sessions, similarity, tools, vectors
from keepsake.operators.ordering import with_next, with_position, with_previous
from keepsake.plans import ingest
from keepsake.sources import exchange, transcripts
from keepsake.streaming import jobs

def now():
    return F.lit("2024-02-01").cast("timestamp")


def unit(rng, n, dim):
    m = rng.normal(size=(n, dim)).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def vec_table(spark, m, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} bigint, embedding array<float>")


def test_positions_cross_chunk_borders(spark):
    rows = [(s, i, i * 10) for s in (1, 2) for i in range(25)]
    df = spark.createDataFrame(rows, "s int, i int, v int").repartition(5)
    chunk = F.floor(F.col("i") / 4)
    pos = with_position(df, ["s"], [F.asc("i")], chunk).collect()
    assert all(r.pos == r.i for r in pos) and len(pos) == 50
    prev = {(r.s, r.i): r.previous for r in with_previous(df, ["s"], ["i"], chunk, ["v"]).collect()}
    after = {(r.s, r.i): r.following for r in with_next(df, ["s"], ["i"], chunk, ["v"]).collect()}
    assert prev[(1, 0)] is None and prev[(1, 4)].v == 30 and after[(2, 23)].v == 240 and after[(2, 24)] is None


@pytest.mark.parametrize("per_pass", [1000, 3])
def test_knn_equals_brute_force_in_any_number_of_passes(spark, monkeypatch, per_pass):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", per_pass)
    rng = np.random.default_rng(1)
    a, q = unit(rng, 120, 8), unit(rng, 7, 8)
    a[60] = a[3]
    hits = vectors.knn(vec_table(spark, a, "fact_id").repartition(4), vec_table(spark, q, "query_id"), 5).collect()
    a64, q64 = a.astype(float), q.astype(float)
    a64 /= np.linalg.norm(a64, axis=1, keepdims=True)
    q64 /= np.linalg.norm(q64, axis=1, keepdims=True)
    for i in range(7):
        s = np.round(a64 @ q64[i], 12)
        want = sorted(range(120), key=lambda j: (-s[j], j))[:5]
        assert [h.fact_id for h in sorted((h for h in hits if h.query_id == i), key=lambda h: h.rank)] == want


def test_similarity_join_equals_all_pairs_with_many_cells_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE_ROWS", 16)
    rng = np.random.default_rng(2)
    centers = unit(rng, 6, 6)
    m = np.vstack([centers[i % 6] + 0.15 * rng.normal(size=6) for i in range(200)]).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r.a, r.b) for r in similarity.similar_pairs(vec_table(spark, m, "fact_id"), 0.95).collect()}
    d = m.astype(float)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    s = np.round(d @ d.T, 12)
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if s[i, j] >= 0.95} and len(got) > 100


def test_cell_search_finds_most_of_the_exact_hits(spark):
    rng = np.random.default_rng(3)
    centers = unit(rng, 10, 12)
    m = np.vstack([centers[i % 10] + 0.2 * rng.normal(size=12) for i in range(400)]).astype(np.float32)
    corpus, q = vec_table(spark, m, "fact_id"), vec_table(spark, m[:20], "query_id")
    exact = {(r.query_id, r.fact_id) for r in vectors.knn(corpus, q, 5).collect()}
    near = {(r.query_id, r.fact_id) for r in similarity.approximate_knn(corpus, q, 5, probe=6, n_cells=16).collect()}
    assert len(exact & near) / len(exact) > 0.9


def test_keepers_equal_one_pass_in_priority_order(spark):
    rng = random.Random(4)
    n = 40
    pr = {i: rng.randint(0, 5) for i in range(n)}
    pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.1}
    nodes = spark.createDataFrame(list(pr.items()), "id bigint, p int")
    got = {r.id: r.keeper_id for r in lifecycle.choose_keepers(nodes, spark.createDataFrame(sorted(pairs), "a bigint, b bigint"), ["p"]).collect()}
    order = sorted(range(n), key=lambda i: (-pr[i], i))
    near = lambda i, j: (min(i, j), max(i, j)) in pairs
    keepers, want = [], {}
    for i in order:
        best = next((k for k in keepers if near(i, k)), None)
        want[i] = i if best is None else best
        if best is None:
            keepers.append(i)
    assert got == want


def test_rolling_context_equals_turn_by_turn(spark):
    rng = random.Random(5)
    rows = [(s, i, "w" * rng.randint(1, 280)) for s in (1, 2, 3) for i in range({1: 90, 2: 3, 3: 40}[s])]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, summary string")
    got = {r.session_id: r.context for r in sessions.rolling_contexts(df, chunk_turns=8).collect()}
    for s in (1, 2, 3):
        text = ""
        for sid, _, x in rows:
            if sid == s:
                joined = text + "\n---\n" + x
                text = (x if not text else joined[:900] if len(joined) > 1200 else joined)[:1500]
        assert got[s] == text


def test_packing_stays_in_budget_and_stops_at_the_first_misfit(spark):
    facts = spark.createDataFrame([(1, 1, "a b c"), (1, 2, "d " * 30), (1, 3, "e")], "query_id int, rank int, content string")
    lines = packing.section(facts, "facts", "rank", F.col("content"))
    out = packing.pack(lines, spark.createDataFrame([(1, 12), (2, 5)], "query_id int, token_budget int")).orderBy("query_id").collect()
    assert out[0].items == 1 and out[0].tokens == 7 and "a b c" in out[0].context and "\ne\n" not in out[0].context
    assert out[1].context == ""


def test_fusion_ignores_partition_order(spark):
    rows = [(1, l, r, f"c{(l * 7 + r * 3) % 9}", (l * 7 + r * 3) % 9, 1.0 / l) for l in (1, 2, 3) for r in range(1, 7)]
    df = spark.createDataFrame(rows, "query_id int, list_no int, rank int, content string, fact_id int, weight double")
    one, many = (sorted(ranking.fuse(df.repartition(n), 5).collect()) for n in (1, 8))
    assert one == many


def test_bm25_exact_word_wins_and_superseded_rows_do_not(spark):
    docs = spark.createDataFrame(
        [(i, f"document about topic {'alpha' if i % 2 else 'beta'} words", None) for i in range(20)] + [(20, "XKQLZP qwvstream words", None), (21, "XKQLZP twice XKQLZP", 1)],
        "fact_id bigint, content string, superseded_by bigint",
    )
    ix = lexical.build_index(docs)
    q = spark.createDataFrame([(1, "where is xkqlzp")], "query_id bigint, text string")
    assert [r.doc_id for r in lexical.search(ix, q, 3).collect()] == [20]
    less = lexical.remove_documents(ix, spark.createDataFrame([(20,)], "doc_id bigint"))
    assert lexical.search(less, q, 3).count() == 0
    assert less.stats.first().n_docs == 21


def test_feedback_order_and_chunks_agree(spark):
    facts = spark.createDataFrame([(1, 0.9, 1, None)], "fact_id bigint, importance double, source_count bigint, superseded_by string").withColumn("last_confirmed_ts", now())
    ratings = [(1, r, i) for i, r in enumerate([5, 5, 1, 3, 2, 4, 1, 1, 5])]
    df = spark.createDataFrame(ratings, "fact_id bigint, rating int, rating_id bigint").withColumn("at", F.timestamp_seconds(F.col("rating_id")))
    x = 0.9
    for _, r, _ in ratings:
        x = min(1.0, x * 1.2) if r >= 4 else max(0.05, x * 0.7) if r <= 2 else x
    for width in (1, 4, 100):
        got = lifecycle.apply_feedback(facts, df, F.floor(F.col("rating_id") / width)).first()
        assert abs(got.importance - x) < 1e-12 and got.needs_review and got.user_rating == 5 and got.source_count == 5


def test_traverse_with_cycle_and_types(spark):
    edges = spark.createDataFrame(
        [("a", "b", "uses", 0.9), ("b", "c", "uses", 0.5), ("c", "a", "uses", 0.9), ("a", "d", "fixed", 0.9), ("c", "e", "uses", 0.8)],
        "src string, dst string, type string, confidence double",
    )
    starts = spark.createDataFrame([("a",)], "start string")
    got = {r.node: (r.depth, r.confidence, r.path) for r in graph.traverse(edges, starts, 3, ["uses"]).collect()}
    assert got == {"b": (1, 0.9, "a → uses → b"), "c": (2, 0.5, "a → uses → b → uses → c"), "e": (3, 0.5, "a → uses → b → uses → c → uses → e")}
    assert {r.node for r in graph.related(edges, starts, 1).collect()} == {"b", "d"}


def test_transcript_lines(spark, tmp_path):
    f = tmp_path / "s1.jsonl"
    f.write_text(
        '{"type":"user","message":{"content":"<cross_session_memory>x</cross_session_memory> fix the build"}}\n'
        '{"type":"user","toolUseResult":{"a":1},"message":{"content":"out"}}\n'
        '{"type":"assistant","message":{"content":[{"type":"text","text":"ok"},{"type":"tool_use","name":"bash"},{"type":"text","text":"done"}]}}\n'
        '{"type":"user","message":{"content":[{"type":"tool_result","content":"x"}]}}\n{broken\n'
    )
    lines = transcripts.read_lines(spark, str(tmp_path))
    got = transcripts.messages_a(lines, "p").orderBy("seq").collect()
    assert [(r.session_id, r.role, r.content) for r in got] == [("claudecode:p:s1", "user", "fix the build"), ("claudecode:p:s1", "assistant", "ok\ndone")]
    assert [r.tool for r in transcripts.tool_calls(lines).collect()] == ["bash"]


def test_export_reads_back(spark, tmp_path):
    facts = spark.createDataFrame([(1, "a"), (2, "b")], "fact_id bigint, content string")
    exchange.export(facts, facts.limit(0), str(tmp_path / "x"))
    back = exchange.read_export(spark, str(tmp_path / "x"), "facts", facts.schema)
    assert sorted(back.collect()) == sorted(facts.collect())


def test_containment_dedup(spark):
    df = spark.createDataFrame([(1, "I like tea. I love I like tea, always use tea.")], "id int, text string")
    texts = [r.content for r in extraction.rule_facts(df, "id").collect()]
    assert len(texts) == len(set(texts)) and not any(a != b and a.lower() in b.lower() for a in texts for b in texts)


def test_soft_delete_twice_is_once(spark):
    facts = spark.createDataFrame([(1, None), (2, "k")], "fact_id bigint, superseded_by string")
    stones = spark.createDataFrame([(1, "x", "merged"), (2, "y", "merged")], "fact_id bigint, by string, reason string").withColumn("at", now())
    once = lifecycle.soft_delete(facts, stones)
    twice = lifecycle.soft_delete(once, stones.withColumn("by", F.lit("other")))
    assert sorted(once.collect()) == sorted(twice.collect()) and {r.superseded_by for r in once.collect()} == {"x", "k"}


def test_tool_register_keeps_counters(spark):
    stored = spark.createDataFrame([("bash", "Bash", "old", "system", "builtin", 4, 3, 1, "mixed (3/4✓)")], "tool_key string, name string, description string, category string, source string, use_count bigint, success_count bigint, fail_count bigint, capability_summary string")
    new = spark.createDataFrame([("Bash", "run shell commands", "", "mcp"), ("Web Search", "search the web", "", None)], "name string, description string, category string, source string")
    got = {r.tool_key: (r.description, r.category, r.source, r.use_count) for r in tools.register(stored, new).collect()}
    assert got == {"bash": ("run shell commands", "system", "mcp", 4), "web_search": ("search the web", "search", "builtin", 0)}


def test_keep_last_pairs(spark):
    roles = ["user", "user", "assistant", "assistant", "user", "assistant"]
    df = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(roles)], "session_id int, seq int, role string, content string")
    got = sorted((r.seq, r.pair, r.kept) for r in messages.keep_last_pairs(df, keep=2).collect())
    assert got == [(0, 1, False), (1, 2, False), (2, 2, False), (3, 3, True), (4, 4, True), (5, 4, True)]


@pytest.mark.parametrize("tile", [512, 3])
def test_bands_find_nearly_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(similarity, "BUCKET_TILE", tile)
    rng = np.random.default_rng(8)
    m = unit(rng, 300, 32).astype(float)
    # Copies at cosines around the threshold, some equal vectors, a null.
    m = np.vstack([m] + [m[:200] + s * unit(rng, 200, 32) for s in (0.1, 0.4, 0.6)] + [m[:5]])
    rows = vec_table(spark, m.astype(np.float32), "fact_id").repartition(3)
    null = spark.createDataFrame([(9999, None)], rows.schema)
    exact = {(r.a, r.b): r.cosine for r in similarity.similar_pairs(rows, 0.85).collect()}
    found = [(r.a, r.b, r.cosine) for r in similarity.banded_pairs(rows.unionByName(null), 0.85).collect()]
    assert len({(a, b) for a, b, _ in found}) == len(found)
    assert all(abs(exact[a, b] - c) < 1e-9 for a, b, c in found)
    assert len(found) >= 0.95 * len(exact) > 300
    assert similarity.banded_pairs(rows.limit(0), 0.85).count() == 0


def test_tiles_grow_with_rows_within_memory():
    """Rows are sent once per tile, so the number of tiles must not grow with the rows while a tile has room."""
    assert 1_200_000 / similarity._tile_rows(1_200_000, 64) <= 25
    assert similarity._tile_rows(100, 64) == similarity.TILE_ROWS
    assert similarity._tile_rows(10**9, 1024) * 1024 <= similarity.TILE_NUMBERS


def test_tiles_send_on_pairs_in_steps(spark, monkeypatch):
    """Equal vectors: all pairs, in batches of bounded size."""
    import pyarrow as pa

    monkeypatch.setattr(similarity, "SCORES_PER_STEP", 100)
    tile = pa.table({"id": pa.array(range(40), pa.int64()), "vec": pa.array([[1.0, 0.0]] * 40, pa.list_(pa.float32())), "home": [True] * 40})
    made = list(similarity._tile(tile, tile, 0.9))
    assert max(b.num_rows for b in made) <= 100 and sum(b.num_rows for b in made) == 40 * 39 / 2


def test_bands_grow_with_rows_and_threshold():
    assert similarity.bands_for(0.9, 1 << 20, 0.9)[1] == 16 > similarity.bands_for(0.9, 1 << 14, 0.9)[1]
    assert similarity.bands_for(0.95, 1 << 20, 0.9)[0] < similarity.bands_for(0.85, 1 << 20, 0.9)[0]
    assert similarity.bands_for(1.0, 10, 0.9)[0] == 1


def lexical_docs(spark):
    rng = random.Random(12)
    words = [a + b for a in ("red", "blue", "old", "new", "tall", "wide") for b in ("barn", "road", "tree", "lake", "hill", "gate", "farm")]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(3, 60))), None) for i in range(700)]
    rows += [(1000, "", None), (1001, None, None), (1002, "redbarn redbarn", 3), (1003, "redbarn " * 500, None)]
    asked = [(q, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for q in range(12)] + [(50, "unknown words"), (51, ""), (52, None)]
    return spark.createDataFrame(rows, "fact_id bigint, content string, superseded_by bigint"), spark.createDataFrame(asked, "query_id bigint, text string")


def test_counted_postings_equal_plain_counts(spark):
    docs, _ = lexical_docs(spark)
    got = {(r.doc_id, r.term): (r.tf, r.doc_len) for r in lexical.build_index(docs).postings.collect()}
    want = {}
    for r in docs.collect():
        words = (r.content or "").split() if r.superseded_by is None else []
        for w in words:
            want[r.fact_id, w] = (words.count(w), len(words))
    assert got == want


@pytest.mark.parametrize("range_docs", [16, 128, 10_000])
def test_stored_search_equals_search(spark, tmp_path, range_docs):
    docs, asked = lexical_docs(spark)
    index = lexical.build_index(docs)
    lexical.write_index(index, f"{tmp_path}/ix", buckets=8, range_docs=range_docs)
    show = lambda hits: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in hits.collect())
    assert show(lexical.search_stored(spark, f"{tmp_path}/ix", asked, 5)) == show(lexical.search(index, asked, 5))


def test_stored_lists_are_whole(spark, tmp_path):
    """A list of documents per bucket, range and term, also where it is longer than an Arrow batch or a document comes twice."""
    docs, asked = lexical_docs(spark)
    twice = docs.unionByName(docs.where("fact_id < 20"))
    index = lexical.build_index(twice)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        lexical.write_index(index, f"{tmp_path}/ix", buckets=4, range_docs=200)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    stored = spark.read.parquet(f"{tmp_path}/ix/postings")
    assert stored.count() == stored.select("bucket", "range", "term").distinct().count() == spark.read.parquet(f"{tmp_path}/ix/blocks").count()
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "term", "tf", "doc_len").collect()))
    assert rows(stored.select("term", F.inline("docs"))) == rows(index.postings)
    show = lambda hits: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in hits.collect())
    hits = lexical.search_stored(spark, f"{tmp_path}/ix", asked, 5)
    assert show(hits) == show(lexical.search(index, asked, 5))


def test_stored_search_reads_a_part(spark, tmp_path):
    docs, _ = lexical_docs(spark)
    path = f"{tmp_path}/ix"
    lexical.write_index(lexical.build_index(docs), path, buckets=8, range_docs=16)
    blocks = spark.read.parquet(f"{path}/blocks")
    gains = spark.read.parquet(f"{path}/idf").where("term in ('widefarm', 'redbarn')").select(F.lit(1).alias("query_id"), "bucket", "term", F.col("idf").alias("gain"))
    kept = lexical.possible_ranges(blocks, gains, 3)
    assert 3 <= kept.count() < blocks.select("range").distinct().count() / 2
    plan = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin([1]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_filtered_and_open_search_from_one_product(spark, monkeypatch):
    rng = np.random.default_rng(5)
    facts = vec_table(spark, unit(rng, 90, 6), "fact_id").withColumn("domain", F.when(F.col("fact_id") % 3 == 0, "a").otherwise("b"))
    asked = vec_table(spark, unit(rng, 9, 6), "query_id").withColumn("domain", F.when(F.col("query_id") % 2 == 0, "a").otherwise("c"))
    rules = [vectors.Match("domain", "domain")]
    for block, tile in ((4096, 1 << 16), (2, 20)):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        monkeypatch.setattr(vectors, "CORPUS_TILE", tile)
        both = vectors.knn_in_and_out(facts, asked, 4, rules)
        show = lambda hits: sorted((r.query_id, r["rank"], r.fact_id, r.cosine) for r in hits.collect())
        assert show(both.where("scope = 'open'")) == show(vectors.knn(facts, asked, 4))
        assert show(both.where("scope = 'filtered'")) == show(vectors.knn(facts, asked, 4, rules=rules))
        assert {r.query_id for r in both.where("scope = 'filtered'").collect()} == {0, 2, 4, 6, 8}
        assert vectors.knn(facts, asked.limit(0), 4).count() == vectors.knn(facts.limit(0), asked, 4).count() == 0


def test_blocks_in_blocks_are_opened(spark):
    import json

    text = "the  innermost text"
    for _ in range(4):
        text = json.dumps([{"type": "text", "text": text}, {"type": "thinking", "text": "no"}])
    nested = [{"type": "text", "text": "deep"}]
    for _ in range(8):
        nested = [{"type": "text", "content": nested}]
    rows = spark.createDataFrame([(1, text), (2, json.dumps(nested))], "id int, c string")
    assert [r.t for r in rows.select("id", content.flatten(F.col("c")).alias("t")).orderBy("id").collect()] == ["the  innermost text", "deep"]


@pytest.mark.parametrize("whole", [10_000, 50])
def test_percentiles_equal_exact_ones(spark, monkeypatch, whole):
    monkeypatch.setattr(evaluation, "WHOLE_GROUP", whole)
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=3000), "b": rng.integers(0, 4, 2000).astype(float), "c": np.array([5.0]), None: rng.exponential(size=700), "same": np.full(900, 2.5)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("empty", None)]
    shares = [0.0, 0.5, 0.95, 1.0]
    got = {r.g: r for r in evaluation.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", "v", shares).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        assert np.allclose([got[g][f"p{i}"] for i in range(4)], np.quantile(values, shares), atol=1e-12)


def test_bumps_start_anew_only_without_batches(spark, tmp_path):
    assert jobs.bumped(spark, f"{tmp_path}/none") is None
    (tmp_path / "facts").mkdir()
    assert jobs.bumped(spark, str(tmp_path)) is None
    spark.createDataFrame([(1, 2)], "fact_id bigint, access_count bigint").write.parquet(f"{tmp_path}/facts/batch=0")
    assert [r.access_count for r in jobs.bumped(spark, str(tmp_path)).collect()] == [2]


def test_windows_of_two_batches_share_no_name(spark):
    say = lambda a, b: spark.createDataFrame([("s", i, "user", f"a message with number {i}") for i in range(a, b)], "session_id string, seq bigint, role string, content string").withColumn("ts", now())
    names = [{r.chunk_id for r in ingest.turns(say(a, a + 8), by_first=True).collect()} for a in (0, 8)]
    assert len(names[0]) == len(names[1]) == 2 and not names[0] & names[1]


def test_contradictions_give_edges_both_ways(spark):
    rows = [(1, "it is not open", "it is open", ["Shop", "Door"], ["SHOP", "Key"]), (2, "it is open", "it is open", ["Shop"], ["Shop"])]
    gone, edges = admission.contradiction_results(spark.createDataFrame(rows, "old_id bigint, old string, new string, old_entities array<string>, new_entities array<string>"))
    assert [r.fact_id for r in gone.collect()] == [1]
    found = {(r.src, r.dst) for r in edges.collect()}
    assert found == {(b, a) for a, b in found} >= {("Shop", "Key"), ("Key", "Door"), ("Door", "SHOP")}


def test_related_nodes_of_more_starts_than_bits(spark):
    """Nodes within two hops of 150 starts, with loops, repeated edges, a hub, unknown and null starts."""
    edges = [(f"n{i}", f"n{(i * 7 + 3) % 200}") for i in range(200)] + [("n0", f"n{i}") for i in range(0, 200, 9)] + [("n5", "n5"), ("n6", "n45"), ("n6", "n45"), ("n45", "n6")]
    starts = [f"n{i}" for i in range(149)] + ["n0", "nowhere"]
    want = set()
    for s in starts:
        one = {b for a, b in edges if a == s}
        want |= {(s, n) for n in one | {b for a, b in edges if a in one} if n != s}
    table = spark.createDataFrame([(s,) for s in [*starts, None]], "start string")
    got = graph.related(spark.createDataFrame(edges, "src string, dst string"), table, 2).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert graph.related(spark.createDataFrame([], "src string, dst string"), table, 2).count() == 0
