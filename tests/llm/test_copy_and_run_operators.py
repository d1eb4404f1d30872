"""Periodic runs, filter interaction audit, exact dedup."""

import hashlib
import random
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from keepsake.llm import exact_dedup, filter_audit, periodic_runs
from keepsake.llm.copies import Repeated, hash128
from keepsake.llm.queries import QUERIES, with_cycles

from plain import sentence, words

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=periodic_runs.LEAST):
    """start, length, period of all runs, by every period in turn."""
    found, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_collapsed(w, runs):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def run_texts():
    rng = random.Random(8)
    texts = [None, "", " \n\t", "one", "a b", " ".join("a" * 40), " ".join("ab" * 30), " ".join(fibonacci(300)), "é ß " * 9, "x\x0by\x0cx\ty\r" * 4, "A a " * 7, "\xa0 \x85 " * 7]
    # Neighbouring repetitions of one period: their members reach across the gap.
    texts += [" ".join("ab" * m + "a" * g + "ba" * k) for m in (3, 9, 17) for g in (1, 2) for k in (4, 9, 16)]
    texts += [" ".join(("a" * m + "b") * k) for m, k in ((3, 9), (20, 4), (50, 3))]
    for _ in range(150):
        w = []
        while len(w) < 90:
            unit = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 14))]
            w += unit * rng.randint(1, 6) + [rng.choice("abcd")] * rng.randint(0, 2)
        texts.append(" ".join(w))
    cycle = sentence(rng, 900)
    texts += [sentence(rng, 400), f"{sentence(rng, 50)} {cycle} {cycle} {cycle[:2000]}", " ".join("b" * 20000)]
    return texts + texts[-3:]


def test_runs_equal_brute_force(spark):
    texts = run_texts()
    rows = periodic_runs.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = words(texts[r.doc_id])
        want = [(0, 20000, 1)] if len(w) == 20000 else plain_runs(w)
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == want, texts[r.doc_id]
        assert r.collapsed == plain_collapsed(w, want)


@pytest.mark.parametrize("least", [2, 4, 5, 9])
def test_runs_of_other_least_lengths(least):
    for text in run_texts()[5:120]:
        _, runs, _ = periodic_runs._described([text, text], least)
        assert [tuple(x.values()) for x in runs.to_pylist()[1]] == plain_runs(words(text), least)


def test_runs_of_a_very_long_text():
    unit = " ".join(f"w{i}" for i in range(70_000))
    counts, runs, collapsed = periodic_runs._described([f"{unit} {unit} end", None], 12)
    assert counts.tolist() == [140_001, 0] and runs.to_pylist() == [[{"start": 0, "length": 140_000, "period": 70_000}], []]
    assert collapsed == [f"{unit} end", ""]


def test_runs_of_odd_rows_and_none(odd, none):
    rows = periodic_runs.find(odd).collect()
    assert len(rows) == odd.count() and all(r.runs == [] for r in rows) and sorted(r.doc_id or 0 for r in rows) == [0, 7, 7, 8, 8, 9]
    assert periodic_runs.find(none).collect() == []


def test_run_query_equals_brute_force(spark):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(words(r.text)) < 500}
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    cycled = 0
    for i, w in docs.items():
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            cycled += 1
        runs = plain_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        milli = None if not runs else 1000 * top[1] // top[2]
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want = (i, len(runs), *top, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest())
        assert tuple(got[i]) == want
    assert cycled > 5 and len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_cycles_of_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "a")]
    assert sorted(with_cycles(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), key=str) == sorted(rows, key=str)


def plain_audit(rows, labels):
    """part, order, step -> counts, document by document and order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, _ in rows:
        t = t or ""
        w = words(t)
        bad = {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        bad |= {"D"} if set(t) & set("#$%&*|") else set()
        bad |= {"E"} if i is not None and least[t] < i else set()
        fails.append(bad)
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in fails[k]}
                before = {k for k in own if f in fails[k]} - left
                left -= gone
                shapley[f] += len(gone)
                lost = [sum(rows[k][0] in x for k in gone) for x in (good, toxic)]
                out[part, order, step] = (len(left), len(gone), len(before), sum(fails[k] == {f} for k in own), *lost)
        for key in [k for k in out if k[0] == part]:
            out[key] += (shapley[key[1][key[2] - 1]],)
    return out


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(4)
    long, upper = sentence(rng, 260), "ABC " * 5 + sentence(rng, 230)
    texts = [None, "", long, long, long + " #", upper, upper, "a " * 250, sentence(rng, 30), sentence(rng, 30) + " $ X", long]
    rows = [(i, texts[i % len(texts)], f"s{i % 3}" if i % 7 else None) for i in range(60)]
    rows += [(5, long, "s1"), (5, long, "s1"), (None, long, "s1"), (None, long, "s2"), (3, texts[3], "s0")] + [(1000 + i, "hot text", "s0") for i in range(900)]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 60, 2)] + [(5, 1, None), (5, 0, 1), (None, 1, 1), (1001, 1, 0), (4000, 1, 1)]
    return rows, [(i, q, None if t is None else int(t)) for i, q, t in labels]


def test_audit_equals_plain_version(spark, audited):
    rows, labels = audited
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id bigint, text string, source string, bits int, quality int").repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    want = plain_audit(rows, labels)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_audit_of_other_filters_and_of_nothing(spark, none, audited):
    rows, labels = audited
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    two = [filter_audit.Filter("X", "n_chars = 0"), filter_audit.Filter("Y", filter_audit.COPIES)]
    got = filter_audit.audit(docs, labels, two)
    assert got.count() == 2 * 2 * 4 and {r.filter_order for r in got.collect()} == {"XY", "YX"}
    total = got.where("filter_order = 'XY'").groupBy("part").agg(F.sum("removed").alias("x")).agg(F.sum("x")).first()[0]
    texts = [t or "" for _, t, _ in rows]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    assert total == sum(t == "" or (i is not None and i > least[t]) for (i, _, _), t in zip(rows, texts))
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def plain_groups(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    choose = max if keep == exact_dedup.GREATEST else min
    return {t: (choose((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("keep", [exact_dedup.LEAST, exact_dedup.GREATEST])
@pytest.mark.parametrize("weak", [False, True])
def test_dedup_equals_plain_version(spark, keep, weak):
    rng = random.Random(6)
    texts = [None, "", " ", "a", "A", "á", "á", "x" * 100_000, "x" * 100_000 + "y"] + [sentence(rng, rng.randint(1, 8)) for _ in range(40)]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(1000 + i, "hot") for i in range(1200)] + [(None, "only null"), (None, "only null"), (None, "a"), (7, "twice"), (7, "twice"), (7, None)]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id bigint, text string, hash string, kept int").repartition(6)
    # A hash of one hexadecimal digit makes unequal texts meet.
    content_hash = (lambda t: F.substring(F.md5(t), 1, 1)) if weak else hash128
    got = exact_dedup.dedup(docs, keep=keep, content_hash=content_hash).collect()
    want = plain_groups(rows, keep)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): t for t in want}
    assert len(got) == len(rows)
    assert sorted((r.doc_id, by_text[r.text_sha256]) for r in got if r.doc_id is not None) == sorted((i, t or "") for i, t in rows if i is not None)
    assert all((r.keep_id, r.group_size) == want[by_text[r.text_sha256]] for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(want) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    clean = exact_dedup.clean(docs, keep=keep, content_hash=content_hash)
    assert clean.columns == docs.columns
    assert sorted((r.text or "", str(r.doc_id)) for r in clean.collect()) == sorted((t, str(i)) for t, (i, _) in want.items())


def test_dedup_with_a_normal_form(spark):
    docs = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "a c")], "doc_id bigint, text string")
    got = exact_dedup.dedup(docs, normalise=lambda t: F.regexp_replace(F.lower(t), " +", " "))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got.collect()) == [(1, 1, True), (2, 1, False), (3, 3, True)]
    with pytest.raises(ValueError):
        exact_dedup.dedup(docs, keep="any")


def test_dedup_of_odd_rows_and_none(odd, none):
    rows = exact_dedup.dedup(odd).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == [("7", "7", 3), ("7", "7", 3), ("8", "8", 2), ("8", "8", 2), ("9", "9", 1), ("None", "7", 3)]
    assert sum(r.kept for r in rows) == 3 and exact_dedup.clean(odd).count() == 3
    assert exact_dedup.dedup(none).count() == exact_dedup.clean(none).count() == 0


def test_flags_without_a_filter(spark, monkeypatch):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "hash string")
    repeated = Repeated.of(rows)
    assert sorted(tuple(r) for r in repeated.flagged(rows).collect()) == [("a", True), ("a", True), ("b", False)]
    monkeypatch.setattr("keepsake.llm.copies.FILTER_BLOCKS", 0)
    assert repeated.flagged(rows).where("possible").count() == 3
