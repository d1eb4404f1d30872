"""The pipeline stage by stage against plain versions, and the registered queries against their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from check import canonical
from keepsake.llm import quality_rules
from keepsake.llm.queries import ORACLES, QUERIES

from plain import shingles
from test_pair_operators import expected, plain_dedup

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = entry_module.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    assert canonical(QUERIES[name](spark, SF).toPandas()).equals(canonical(con.sql(ORACLES[name]).df()))


def test_stages(spark, tmp_path, docs):
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {i for i, _ in before}
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            book = quality_rules.ledger(spark.createDataFrame(before, "doc_id bigint, text string"))
            assert set(after) == {r.doc_id for r in quality_rules.apply_policy(book, "v1").where("kept").collect()}
        elif name == "line_dedup":
            texts, _ = plain_dedup(before)
            assert after == {i: t for i, t in texts.items() if t and t.split()}
        elif name == "jaccard_join":
            assert set(after) == {i for i, (_, c) in expected(before).items() if i == c}
        else:
            sets = {i: shingles(t) for i, t in before}
            assert set(after) == {i for i, x in sets.items() if not any(q and 100 * len(q & x) >= 80 * len(q) for q in items)}
