"""The product of a block of queries and a tile of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from keepsake.operators import vectors


def test_scores_are_put_in_order_only_until_every_query_has_its_rows(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6))

    def table(n, many):
        held = rng.integers(40, size=n)
        return held, pa.table({"id": np.arange(n), "vec": pa.array(base[held].tolist(), pa.list_(pa.float64())), "r0": np.arange(n) % many})

    (rows, corpus), (asked, queries) = table(500, 7), table(30, 7)
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64()), ("scope", pa.string())])
    calls, own = [], np.partition
    monkeypatch.setattr(vectors, "SCORES_PER_STEP", 30 * 50)
    monkeypatch.setattr(np, "partition", lambda *a, **k: calls.append(1) or own(*a, **k))
    block = vectors._Queries(queries, [vectors.Match("s", "s", "differ")])
    got = pa.Table.from_batches(vectors._product(corpus.to_batches(), block, 4, (vectors.FILTERED, vectors.OPEN), schema), schema).to_pylist()
    assert len(calls) == 2
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    scores = np.round(unit[rows] @ unit[asked].T, 12)
    for scope in (vectors.FILTERED, vectors.OPEN):
        for q in range(30):
            order = sorted((i for i in range(500) if scope == vectors.OPEN or i % 7 != q % 7), key=lambda i: (-scores[i, q], i))[:4]
            mine = sorted(((r["cosine"], r["id"]) for r in got if r["scope"] == scope and r["query_id"] == q), key=lambda x: (-x[0], x[1]))
            assert [i for _, i in mine] == order
            assert np.allclose([s for s, _ in mine], scores[order, q])
