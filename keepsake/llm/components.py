"""Connected components of undirected edges, by alternating star contraction.

Each task first reduces its edges to a forest. Up to ``LAST_EDGES`` edges, what is left
is joined in one task. Beyond that, two steps alternate: a large
star hangs every larger neighbour of a node on the least of its neighbourhood, a
small star hangs the smaller neighbours there. Both keep the components; when
nothing changes, every node hangs on the least node of its component. The number
of rounds grows with the logarithm of the number of nodes; each is written out,
so that a lost executor costs a part of one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.session import cut

EDGES = "a bigint, b bigint"
# Edges that one task may join at the end; some 200 bytes each.
LAST_EDGES = 200_000


def forest_edges(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, least node) that connect what the given edges connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _forest(batches):
    for batch in batches:
        edges = forest_edges(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of its component) of every node of ``edges`` (a, b)."""
    now = cut(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b").mapInArrow(_forest, EDGES))
    if now.count() <= LAST_EDGES:

        def joined(batches):
            yield from _forest([b for t in [pa.Table.from_batches(batches, schema)] for b in t.combine_chunks().to_batches()])

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        last = now.coalesce(1).mapInArrow(joined, EDGES)
        return cut(last).select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        now = cut(_star(_star(now, large=True), large=False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1000003), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with b < a after one step."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    around = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else down
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = around.join(least, "a")
    if large:
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.where("a <> b").distinct()
    moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()
