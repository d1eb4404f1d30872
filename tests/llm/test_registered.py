"""The registered queries without SQL, as they are, against plain versions on the smallest tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsake.llm.queries import DAMAGED, QUERIES, vocabulary

from plain import shingles
from test_pair_operators import expected, plain_dedup
from test_text_operators import base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def encoded(name, texts, end):
    tokenizer = Tokenizer.from_file(vocabulary(name))
    tokenizer.encode_special_tokens = True
    return {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for i, t in texts.items()}


def test_packing(spark, texts):
    ids = encoded("word_bpe_49k.json", texts, 1)
    rows = QUERIES["op2_curve_packing"](spark, SF).collect()
    for i, own in ids.items():
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]] and sum(p.length for p in pieces) == len(own)
        assert all(p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length]) for p in pieces)
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert sequences.setdefault(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] += r.length
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sequences.values())
    assert max(sequences.values()) <= 2048 and padded < 0.02 * sum(sequences.values())


def test_jaccard_join(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_jaccard_join"](spark, SF).collect()}
    assert got == expected(list(texts.items()))


def test_language_id(spark, texts):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [r.lang_pred == known[r.doc_id] for r in rows if r.held_out and len(texts[r.doc_id]) > 100 and known[r.doc_id]]
    assert sum(right) > 0.95 * len(right) > 20


def test_secret_scans(spark, texts):
    for r in QUERIES["op6_secret_scans"](spark, SF).collect():
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(r.spans.split(","))


def test_line_dedup(spark, texts):
    rows = sorted(texts.items())
    want, out = plain_dedup(rows)
    got = {r.doc_id: r for r in QUERIES["op7_line_dedup"](spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert sum(r.n_dropped for r in got.values()) == len(out)


def test_token_store(spark, texts):
    ids = encoded("byte_bpe_50k.json", texts, 0)
    start, want = 0, {}
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), zlib.crc32(ids[i]))
        start += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_token_store"](spark, SF).collect()} == want


def test_warc_fixity(spark):
    # The smallest tables have no page that the query damages.
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet").where(F.expr(DAMAGED) & F.col("html").isNotNull())
    rows = QUERIES["op9_warc_fixity"](spark, folder).collect()
    assert sorted((r.record_id, r.state) for r in rows) == sorted((str(r.page_id), "changed") for r in pages.select("page_id").collect()) and rows


def test_decontamination(spark, texts):
    items = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for own in [shingles(t)] for k, q in items.items() if q and 100 * len(q & own) >= 80 * len(q)}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op10_benchmark_decontamination"](spark, SF).collect()} == want and want
