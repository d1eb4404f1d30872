"""URL filters, packing, token store, fixity audit."""

import itertools
import random
import re
import hashlib
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsake.llm import curve_packing, token_store, url_filters, warc_fixity
from keepsake.llm.tokens import WordTokenizer

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net")]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def verdict(url, listed):
    host, path = host_path(url)
    fit = []
    for action, rule in RULES:
        rule_host, slash, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rest):
            fit.append((len(rule), action == "block", rule, action))
    if fit:
        return max(fit)[2:]
    canonical = re.sub(r"^www\.|:(80|443)$", "", host) + re.sub("/+$", "", path)
    return None, "block" if host and canonical in listed else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/7?x#y", "https://example.com/en/70", "https://example.com/en", "x://com/en/1",
    "http://notcom/en/", "http://b.net", "http://c.org/p/", "http://www.c.org/p", "http://c.org:80/p//", "http://c.org/q", "a://b://c.net/", "http://d.org?u=http://e.net/",
    "HTTP://ÄB.org/é", "http://example.com/en/7", "http://example.com/en/7",
]


@pytest.mark.parametrize("blocks", [1 << 16, 0])
def test_urls(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filters, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(url_filters, "BROADCAST_KEYS", blocks)
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(URLS)], "page_id bigint, url string, key string, block bigint")
    listed = ["c.org/p", "äb.org/é", "ÄB.org/é", "unseen.org/x", "c.org/p"]
    out = url_filters.judge(pages, url_filters.rule_table(spark, RULES), spark.createDataFrame([(x,) for x in listed], "url string")).collect()
    assert len(out) == len(URLS)
    for r in out:
        assert (r.host, r.path) == host_path(URLS[r.page_id])
        assert (r.rule, r.verdict) == verdict(URLS[r.page_id], listed), URLS[r.page_id]


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    blocks = 3000 * url_filters.BITS_PER_KEY // 512
    bloom = url_filters.bloom_filter(keys, blocks)
    assert url_filters.possible(keys, bloom, blocks).count() == 3000
    others = spark.range(20000).select(F.concat(F.lit("other"), F.col("id")).alias("key"))
    assert url_filters.possible(others, bloom, blocks).count() < 400


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    rules, listed = url_filters.rule_table(spark, RULES), spark.createDataFrame([], "url string")
    assert url_filters.judge(pages, rules, listed).count() == 0
    one = spark.createDataFrame([(None, "http://a.com/en/")], "page_id bigint, url string")
    assert url_filters.judge(one, rules.limit(0), listed).first().verdict == "allow"


PARTS = ["a", "The", "the", "é", " ", "  ", "\n", "\n\n", "\t", ",", ".", "'s", "1", "23", "~", "\x1c", "ß", "e\u0301", "<|endoftext|>", "中文", "\r\n", "|", "İ", "Σ", "hello", "wörld,", "ŉ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_cache_gives_the_tokenizers_ids(name):
    rng = random.Random(2)
    texts = ["", " ", "a", "\n", "a\nb", "a \nb"] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    own = WordTokenizer(public_tokenizers.path(name))
    for part in (texts, texts[:40], texts[::-1]):
        ids, many = own.encode(part)
        ends = np.cumsum(many)
        want = own.tokenizer.encode_batch(part, add_special_tokens=False)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, many)] == [w.ids for w in want]


def test_code_lengths():
    def limited(counts, most):
        """Least cost over all lengths that satisfy Kraft's inequality."""
        best = None
        for lengths in itertools.product(range(1, most + 1), repeat=len(counts)):
            if sum(2.0**-n for n in lengths) <= 1:
                cost = sum(c * n for c, n in zip(counts, lengths))
                best = cost if best is None else min(best, cost)
        return best

    rng = np.random.RandomState(0)
    for most in (3, 4):
        for _ in range(5):
            counts = rng.randint(1, 100, 6) ** 2
            lengths = token_store.code_lengths(counts, most)
            assert lengths.max() <= most and (counts * lengths).sum() == limited(counts, most)
    assert token_store.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert token_store.code_lengths(np.array([0, 0])).tolist() == [0, 0]
    with pytest.raises(ValueError):
        token_store.code_lengths(np.ones(9, int), 3)


def test_codes_round_trip():
    rng = np.random.RandomState(1)
    docs = [rng.zipf(1.3, n) % 3000 for n in (0, 1, 255, 256, 257, 5000, 0, 3)]
    lengths = token_store.code_lengths(np.bincount(np.concatenate(docs)))
    codes = token_store.canonical_codes(lengths)
    assert len({f"{codes[i]:0{lengths[i]}b}" for i in np.flatnonzero(lengths)}) == np.count_nonzero(lengths)
    bits, marks = token_store.encode(docs, lengths, codes)
    table = token_store.decoding_table(lengths)
    for doc, own, places in zip(docs, bits, marks):
        many = np.array([min(token_store.STEP, len(doc) - k) for k in range(0, len(doc), token_store.STEP)], int)
        assert token_store.decode(own, places, many, table).tolist() == doc.tolist()
        # Any stretch can be decoded alone.
        if len(many) > 1:
            assert token_store.decode(own, places[-1:], many[-1:], table).tolist() == doc[-many[-1] :].tolist()


def reference_ids(texts, name, end):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True
    return [e.ids + [end] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_store(docs, corpus, spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 3000)
    path = tempfile.mkdtemp(prefix="keepsake-test-") + "/store"
    token_store.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = token_store.read(spark, path).orderBy("doc_id").collect()
    want, start = reference_ids([t for _, t in corpus], "byte_bpe_50k.json", 0), 0
    assert len(got) == len(want)
    for r, ids in zip(got, want):
        assert (r.start, r.ids) == (start, ids)
        start += len(ids)


def test_token_store_of_odd_rows(odd, none, spark):
    path = tempfile.mkdtemp(prefix="keepsake-test-")
    name = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write(odd, f"{path}/odd", name)
    got = sorted((r.start, str(r.doc_id), len(r.ids)) for r in token_store.read(spark, f"{path}/odd").collect())
    assert [x[1] for x in got] == ["None", "7", "7", "8", "8", "9"] and [x[2] for x in got][3:5] == [1, 1]
    assert [x[0] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1]]
    token_store.write(none, f"{path}/none", name)
    assert token_store.read(spark, f"{path}/none").count() == 0


def test_hilbert_curve_is_continuous():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        place = curve_packing.hilbert(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def packed_well(pieces, want):
    """Each id once, sequences gapless, none padded but at a power of two."""
    seen = {i: 0 for i in want}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(want[r.doc_id]) and r.length > 0
        own = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids == own and r.ids_crc32 == zlib.crc32(np.array(own, "<u4"))
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in want.items()}
    for _, own in itertools.groupby(sorted(pieces, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == r.sequence_length <= 2048 and at & (at - 1) == 0


def test_packing(docs, corpus):
    want = dict(zip([i for i, _ in corpus], reference_ids([t for _, t in corpus], "word_bpe_49k.json", 1)))
    packed_well(curve_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect(), want)


def test_curve_keeps_copies_together(docs):
    table = curve_packing.with_place(curve_packing.embedded(docs, public_tokenizers.path("word_bpe_49k.json")))
    assert table.groupBy("crc").agg(F.countDistinct("place").alias("n")).where("n > 1").count() == 0


def test_packing_of_odd_rows(odd, none):
    name = public_tokenizers.path("word_bpe_49k.json")
    pieces = curve_packing.pack(odd, name, keep_ids=False).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == ["7", "7", "8", "8", "9", "None"]
    assert curve_packing.pack(none, name).count() == 0


def pages(spark):
    rng = random.Random(7)
    rows = [(i, f"http://h{i % 5}.org/{i}", "<p>" + "é\r\n\r\nWARC/1.0\r\n" * (i % 3) + "x" * rng.randint(0, 300) + "</p>") for i in range(300)]
    rows += [(None, None, None), (5, "http://bad.org/\r\nContent-Length: 3\r\n", ""), (5, "http://twice.org", "y")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def test_warc_round_trip_and_audit(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "FANOUT", 4)
    table, path = pages(spark).cache(), tempfile.mkdtemp(prefix="keepsake-test-")
    warc_fixity.write_warc(table, f"{path}/a")
    warc_fixity.write_warc(table, f"{path}/b", F.when(F.expr("page_id % 50 = 7"), F.lit("lost")).otherwise(F.col("html")))
    a, b = (warc_fixity.records(spark, f"{path}/{x}") for x in "ab")
    assert sorted(r.record_id for r in a.collect()) == sorted(str(r.page_id) if r.page_id is not None else "" for r in table.collect())
    assert warc_fixity.audit(a, a).count() == 0
    found = warc_fixity.audit(a, b).collect()
    assert {r.record_id for r in found} == {str(i) for i in range(7, 300, 50)} and {r.state for r in found} == {"changed"}
    for r in found:
        assert r.original_stop - r.original_start > r.replica_stop - r.replica_start > 0
    last = a.groupBy("archive").agg(F.max("ordinal").alias("ordinal"))
    cut_off = a.join(last, ["archive", "ordinal"], "left_anti")
    assert {r.state for r in warc_fixity.audit(a, cut_off).collect()} == {"missing"}
    assert warc_fixity.audit(cut_off, a).select("archive", "ordinal", "state").collect().__len__() == last.count()
    table.unpersist()


def test_audit_of_empty_archives(spark):
    empty = spark.createDataFrame([], warc_fixity.RECORDS)
    assert warc_fixity.audit(empty, empty).count() == 0
    one = spark.createDataFrame([(0, 0, "1", 0, 9, "d")], warc_fixity.RECORDS)
    assert [r.state for r in warc_fixity.audit(empty, one).collect()] == ["extra"]


def replica(rows, change):
    """Records (as ``records`` gives them) of one archive of payloads, some changed, lost or added."""
    out, at = [], 0
    for n, (name, payload) in enumerate(change(rows)):
        out.append((0, n, name, at, at + len(payload), hashlib.sha256(payload.encode()).hexdigest()))
        at += len(payload)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_plain_comparison(spark, monkeypatch, seed):
    monkeypatch.setattr(warc_fixity, "FANOUT", 8)
    rng = random.Random(seed)
    rows = [(str(i), f"payload {i} " + "x" * rng.randint(0, 50)) for i in range(700)] + [("twice", "a"), ("twice", "b"), (None, "c")]
    changed = {rng.randrange(700) for _ in range(4)}
    lost = {rng.randrange(700) for _ in range(3)} - changed
    extra = rng.randrange(700)

    def change(rows):
        for n, (name, payload) in enumerate(rows):
            if n == extra:
                yield "new", "new payload"
            if n not in lost:
                yield name, payload + "longer" if n in changed else payload

    a, b = (spark.createDataFrame(replica(rows, c), warc_fixity.RECORDS) for c in (list, change))
    got = {(r.record_id, r.state): r for r in warc_fixity.audit(a, b).collect()}
    assert set(got) == {(str(n), "changed") for n in changed} | {(str(n), "missing") for n in lost} | {("new", "extra")}
    assert all(r.ordinal == int(r.record_id) for r in got.values() if r.state != "extra")
    leaves = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    below, counts = warc_fixity.descend(leaves)
    # A record changes its own branch, and one more where it begins a node.
    assert max(counts) <= 2 * (len(changed) + len(lost) + 1)
    assert below.count() < leaves.count() / 2


def test_audit_without_differences_opens_nothing(spark):
    rows = [(str(i), "x" * (i % 7)) for i in range(200)]
    a = spark.createDataFrame(replica(rows, list), warc_fixity.RECORDS)
    below, counts = warc_fixity.descend(a.withColumn("side", F.lit("a")).unionByName(a.withColumn("side", F.lit("b"))))
    assert below.count() == 0 and not any(counts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_the_word_cache_keeps_frequent_words(name, monkeypatch):
    """Words seen more than once stay over a full cache and the end of a task; the ids are the tokenizer's all along."""
    path = public_tokenizers.path(name)
    monkeypatch.setattr("keepsake.llm.tokens.KEPT_WORDS", 20)
    monkeypatch.setattr("keepsake.llm.tokens.CACHE_WORDS", 60)
    own, plain, asked = WordTokenizer(path), Tokenizer.from_file(path), []
    tokenize = own._tokenize
    monkeypatch.setattr(own, "_tokenize", lambda words: asked.append(list(words)) or tokenize(words))
    for i in range(6):
        texts = [f"the cat über le élan, the cat\nand w{i}x{k} {chr(97 + i)}{chr(97 + k)}zq. the cat" for k in range(20)] + ["", "a  \tb c"]
        ids, many = own.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        own.rest()
    assert len(own.cache) <= 60
    assert not any({"cat", "über"} & set(words) for words in asked[1:])
