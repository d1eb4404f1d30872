"""The catalogue against its SQL on the smallest tables, a part of it per run of the suite."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import canonical
from keepsake.catalog import ENTRIES

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "knn_filtered", "bm25_topk", "hybrid_recall", "budget_pack", "effective_confidence", "consolidation_report", "redact",
    "turn_windows", "typed_traverse", "tool_transitions", "session_digest", "persona_entries", "stream_transitions",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    e = ENTRIES[name]
    assert canonical(e.run(spark, SF).toPandas()).equals(canonical(con.sql(e.sql).df()))


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 100
    assert entry_module.entry(spark).columns == ["query_id", "fact_id", "score_e9", "rank"]
