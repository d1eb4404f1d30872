"""Jaccard join, line dedup, components, sketches and tiles against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepsake.llm import hashing, jaccard_join, line_dedup, linking, sketches
from keepsake.llm.components import components

from plain import WORDS, edited, sentence, shingles, words


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def similar(x, y):
    both = len(x & y)
    return both > 0 and 100 * both >= 80 * (len(x) + len(y) - both)


def test_shingle_hashes():
    rng = random.Random(1)
    texts = ["", "a", " a  b\tC\nd e F g", None, "A b c d e f g a b c d e", "é ü x\x0by z"]
    texts += ["".join(rng.choice("ab \n\tC") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    own = hashing.sets(pa.array(texts))
    names = {}
    for text, hashes in zip(texts, own):
        assert len(hashes) == len(shingles(text))
        assert names.setdefault(frozenset(hashes.tolist()), shingles(text)) == shingles(text)


@pytest.mark.parametrize("last", [0, 200_000])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr("keepsake.llm.components.LAST_EDGES", last)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000 + i, 1000) for i in range(1, 200)] + [(5, 5)]
    edges += [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(250)]
    plain = Union()
    for a, b in edges:
        plain.join(a, b)
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()}
    assert got == {x: plain.root(x) for x in plain.up if plain.root(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bit_sets(spark):
    values = [(x,) for x in range(-50, 5000, 37)]
    bits = sketches.bit_set(spark.createDataFrame(values, "v bigint").repartition(3))
    assert sketches.within(bits, np.array([v for v, in values])).all()
    assert sketches.within(bits, np.arange(10**6, 10**6 + 10000)).mean() < 0.01


def test_tiles_find_all_links():
    rng = random.Random(3)
    base = [rng.randrange(1 << 60) for _ in range(80)]
    many = [np.unique([x if rng.random() > rng.choice([0.02, 0.2]) else rng.randrange(1 << 60) for x in base]) for _ in range(60)] + [np.zeros(0, np.int64)]
    got = set(zip(*(x.tolist() for x in linking.linked(many, many, 80))))
    assert got == {(i, j) for i, x in enumerate(many) for j, y in enumerate(many) if similar(set(x.tolist()), set(y.tolist()))}


def expected(corpus):
    plain = Union()
    sets = [(i, shingles(t)) for i, t in corpus]
    for k, (i, x) in enumerate(sets):
        plain.root(i)
        for j, y in sets[:k]:
            if similar(x, y):
                plain.join(i, j)
    return {i: (len(x), plain.root(i)) for i, x in sets}


def test_jaccard_join_equals_brute_force(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert got == expected(corpus)


def test_jaccard_join_where_groups_miss_links(docs, corpus, monkeypatch):
    """With no groups from MinHash keys, the matrix alone finds the links."""
    monkeypatch.setattr(jaccard_join, "LEAST_KEYS", 99)
    monkeypatch.setattr(linking, "TILE", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert got == expected(corpus)


def test_jaccard_clean(docs, corpus):
    left = jaccard_join.clean(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in expected(corpus).items() if i == c}


def test_jaccard_of_odd_rows(odd, none):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.join(odd).collect())
    n = len(WORDS) - 4
    assert got == [("7", n, "7"), ("7", n, "7"), ("8", 0, "8"), ("8", 0, "8"), ("9", n + 1, "7"), ("None", n, "7")]
    assert jaccard_join.clean(odd).columns == odd.columns
    assert jaccard_join.join(none).count() == jaccard_join.clean(none).count() == 0


def test_jaccard_clean_chooses_by_row(spark):
    rng = random.Random(22)
    a, b, c, d, e = (sentence(rng, 40) for _ in range(5))
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (None, a, 4), (None, c, 5), (None, c, 6), (None, c + " end", 7)]
    rows += [(6, d, 8), (6, d, 8), (6, d + " end", 9), (None, e, 10), (7, None, 11), (7, "", 12), (7, "", 12)]
    left = jaccard_join.clean(spark.createDataFrame(rows, "doc_id bigint, text string, n bigint").repartition(3)).collect()
    got = sorted(r.n for r in left)
    of_c, of_d = [n for n in got if n in (5, 6, 7)], [n for n in got if n in (8, 9)]
    assert len(of_c) == len(of_d) == 1
    assert [n for n in got if n not in of_c + of_d] == [1, 3, 10, 11, 12, 12]


def plain_dedup(rows):
    """Texts after dedup, and (doc, line) of the lines taken out."""
    lines = [(i, n, x.strip(" \t\n\r\x0b\x0c")) for i, t in rows for n, x in enumerate((t or "").split("\n")) if words(x)]
    names = sorted({x for _, _, x in lines})
    sets = {x: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in names}
    plain = Union()
    holders = {}
    for a in names:
        for b in {b for s in sets[a] for b in holders.get(s, [])}:
            if 0.8 * len(sets[a]) <= len(sets[b]) <= len(sets[a]) / 0.8 and similar(sets[a], sets[b]):
                plain.join(a, b)
        # Of ten shingles one: similar lines share more than that.
        for s in sorted(sets[a])[:: 10 if len(sets[a]) > 200 else 1]:
            holders.setdefault(s, []).append(a)
    kept = {}
    for i, n, x in sorted(lines):
        kept.setdefault(plain.root(x), (i, n))
    out = {(i, n) for i, n, x in lines if kept[plain.root(x)] != (i, n)}
    return {i: t and "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in out) for i, t in rows}, out


def line_corpus():
    rng = random.Random(9)
    pool = [sentence(rng, rng.randint(5, 30)) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "few words here\nfew words here"), (4, " padded line of five words \r\npadded line of five words")]
    for i in range(5, 120):
        own = [rng.choice(pool) if rng.random() < 0.3 else sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 12))]
        own = [edited(rng, x, 0.03) if rng.random() < 0.3 else x for x in own]
        rows.append((i, "\n".join(own) + rng.choice(["", "\n"])))
    hot = sentence(rng, 40)
    return rows + [(i, sentence(rng, 8) + "\n" + edited(rng, hot, 0.02)) for i in range(200, 300)]


def test_line_dedup_equals_brute_force(spark):
    rows = line_corpus()
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id bigint, text string, n_lines bigint").repartition(3)
    texts, out = plain_dedup(rows)
    got = line_dedup.counted(docs).select("row.doc_id", "text", "n_lines", "n_dropped").collect()
    # Bands may miss a pair in some hundreds: here links are plenty, and all components are found.
    assert {r.doc_id: r.text for r in got} == texts
    assert {r.doc_id: r.n_dropped for r in got} == {i: sum(d == i for d, _ in out) for i, _ in rows}
    assert {r.doc_id: r.n_lines for r in got} == {i: 0 if t is None else t.count("\n") + 1 for i, t in rows}
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == docs.columns
    assert {(r.doc_id, r.n_lines) for r in cleaned.collect()} == {(i, i) for i, _ in rows}


def test_recall_of_changed_lines(spark):
    rows, linked = [], {}
    for length in (10, 20, 45, 60, 80, 150, 400):
        rng = random.Random(length)
        a = [sentence(rng, length)[:length] for _ in range(300)]
        # A change near the end leaves most shingles of a short line, one anywhere those of a long one.
        b = [x[:k] + rng.choice("#&x9") + x[k + rng.randint(0, 1) :] for x in a for k in [rng.randrange(length) if length > 80 else length - rng.randint(1, 3)]]
        pairs = zip(line_dedup.line_sets(pa.array(a)), line_dedup.line_sets(pa.array(b)))
        linked[length] = [i for i, (x, y) in enumerate(pairs) if similar(set(x.tolist()), set(y.tolist()))]
        rows += [(length * 10_000 + i, x) for i, x in enumerate(a)] + [(length * 10_000 + 1000 + i, x) for i, x in enumerate(b)]
    left = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    for length, own in linked.items():
        found = [left[length * 10_000 + 1000 + i] == "" for i in own]
        assert sum(found) >= (0.985 if length > 50 else 1) * len(found) and (len(found) > 50 or length < 20), length


def test_lines_of_a_template_meet_few(spark):
    texts = [f"Comments ({i})" for i in range(3000)] + [f"Posted on day {i % 900} by user{i}" for i in range(3000)]
    shape = line_dedup.shapes(texts)
    classes = spark.createDataFrame([(i, s) for i, s in enumerate(shape.to_pylist())], f"class bigint, shape {line_dedup.SHAPE}")
    pivoted = linking.with_pivots(line_dedup._buckets(classes, 80))
    sizes = pivoted.groupBy("key").count().collect()
    assert sum(r["count"] ** 2 for r in sizes) < 100 * len(texts)


def test_signatures_rule_out_no_short_pair():
    rng = random.Random(31)
    texts = [sentence(rng, 12)[: rng.randint(8, 47)] for _ in range(60)]
    texts += [t[:-1] for t in texts] + [t + "s" for t in texts] + [t[1:] for t in texts] + ["a" * k for k in (1, 7, 8, 9, 20, 47)]
    shape = line_dedup.shapes(texts)
    table = pa.table({c: shape.field(c) for c in ("n", "marks")} | {"member": pa.array(range(len(texts)))})
    near = line_dedup._near_tables(table, table)
    sets = [set(x.tolist()) for x in line_dedup.line_sets(pa.array(texts))]
    assert shape.field("n").to_pylist() == [len(x) for x in sets]
    assert all(near[i, j] for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and similar(x, y))
    assert 0 < near.sum() < near.size / 10


def test_line_dedup_of_odd_rows(odd, none):
    left = line_dedup.clean(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    texts = {(str(r.doc_id), r.text) for r in left.collect()}
    assert ("7", " ".join(WORDS)) in texts and ("None", "") in texts and ("9", "") in texts and ("8", None) in texts
    assert line_dedup.clean(none).count() == 0


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(21)
    a, b, c, d = (sentence(rng, 12) for _ in range(4))
    rows = [(None, f"{a}\n{b}", 1), (None, f"{c}\n{a}", 2), (4, f"{d}\n{a}", 3), (4, f"{b}\n{d}", 4), (5, f"{c}x", 5)]
    own = sentence(rng, 12)
    rows += [(6, f"{own}\nfew words", 6)] * 3 + [(None, sentence(rng, 12), 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint").repartition(3)
    got = [(r.doc_id, r.text, r.n) for r in line_dedup.clean(docs).collect()]
    lines = [x for _, t, _ in got for x in t.split("\n") if len(words(x)) >= 5]
    # Each line once, whatever the ids; no document is emptied of lines that it alone has.
    assert sorted(lines) == sorted([a, b, d, f"{c}x", own, rows[-1][1]])
    texts = {n: [t for _, t, m in got if m == n] for _, _, n in rows}
    assert texts[1] == texts[2] == [""] and texts[5] == [f"{c}x"]
    assert sorted(texts[6]) == sorted(["", "", f"{own}\nfew words"]) and sorted(texts[7]) == ["", rows[-1][1]]
    assert all(r.n_lines - r.n_dropped == len([x for x in r.text.split("\n") if x]) for r in line_dedup.counted(docs).collect())


def test_short_lines_and_lines_without_spaces_take_part(spark):
    lines = ["Les.", "a", "日本語の行には空白がないので一語と数えられる" * 2, "Share this page"]
    near = lines[2][:-1] + "五"
    rows = [(1, "\n".join(lines)), (2, "\n".join([" Les. ", "", "b", near])), (3, "\n".join(["a", *lines[2:]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: r.text for r in line_dedup.clean(docs, least_words=line_dedup.EVERY).collect()}
    assert got == {1: rows[0][1], 2: "\nb", 3: ""}


@pytest.mark.parametrize("members", [2, 5, 6, 40])
def test_pivots_cover_small_buckets(spark, members):
    buckets = spark.range(members).select(F.lit(1).cast("bigint").alias("key"), F.col("id").alias("member"), F.lit(10).alias("n"))
    pivoted = linking.with_pivots(buckets)
    pairs = linking.pivot_pairs(pivoted, 80).collect()
    assert all(r.n_keys == 1 and r.a > r.b for r in pairs)
    p = min(members, linking.PIVOTS)
    assert len(pairs) == len({(r.a, r.b) for r in pairs}) == p * members - p * (p + 1) // 2
