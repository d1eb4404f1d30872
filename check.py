"""Compare registered queries with their SQL on DuckDB: ``python check.py [sf] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

from keepsake.catalog import ENTRIES
from keepsake.session import local_session


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v != v else (f"{float(v):.6f}" if isinstance(v, float) else str(v)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(ENTRIES)
    spark = local_session("check", "8")
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    bad = 0
    for name in names:
        entry = ENTRIES[name]
        try:
            t = time.time()
            got = entry.run(spark, sf).toPandas()
            took = time.time() - t
            if entry.sql is None:
                print(f"{name:28s} rows={len(got):7d} {took:6.2f}s  no sql", flush=True)
                continue
            t = time.time()
            want = con.sql(entry.sql).df()
            a, b = canonical(got), canonical(want)
            ok = list(a.columns) == list(b.columns) and a.equals(b)
            print(f"{name:28s} rows={len(got):7d} {took:6.2f}s sql {time.time()-t:6.2f}s {'ok' if ok else 'DIFFERENT'}", flush=True)
            if not ok:
                bad += 1
                if list(a.columns) != list(b.columns):
                    print("  columns", list(a.columns), list(b.columns))
                else:
                    print("  rows", len(a), len(b))
                    m = a.merge(b, how="outer", indicator=True)
                    print(m[m._merge != "both"].head(8).to_string(max_colwidth=90))
        except Exception:
            bad += 1
            print(f"{name:28s} FAILED", flush=True)
            traceback.print_exc(limit=3)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
