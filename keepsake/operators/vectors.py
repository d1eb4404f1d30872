"""Nearest-neighbour search over a table of vectors, for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.operators.ordering import top_per_group
from keepsake.session import cut

# Queries of one block. At 384 dimensions their vectors are 12 MB.
QUERY_BLOCK = 4096
# Corpus rows of one tile where queries fill several blocks.
CORPUS_TILE = 1 << 16
# Entries of the score matrix held at once in a task.
SCORES_PER_STEP = 4_000_000


@dataclass(frozen=True)
class Match:
    """A row condition between query and corpus.

    ``equal``: values agree, or the query holds ``wildcard`` (or null).
    ``differ``: values differ. ``at_least`` / ``at_most``: corpus value against
    the query's bound, where a null bound admits every row.
    """

    query_col: str
    corpus_col: str
    kind: str = "equal"
    wildcard: str | None = None


def matrix(column) -> np.ndarray:
    """Arrow list column -> 2-d float64 array of unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _values(column) -> np.ndarray:
    return column.to_pandas().to_numpy()


class _Queries:
    """A block of queries: ids, unit vectors as columns, and what their rules ask for."""

    def __init__(self, table: pa.Table, rules: list[Match]):
        self.ids = table.column(0)
        self.vectors = matrix(table.column(1)).T.copy() if table.num_rows else np.zeros((1, 0))
        self.wanted = [[None if v is None or v != v else v for v in _values(table.column(2 + i)).tolist()] for i in range(len(rules))]
        self.rules = rules

    def allowed(self, rows: pa.RecordBatch) -> np.ndarray | None:
        """Which rows (down) the rules of which queries (across) admit; nothing is ruled out without rules."""
        mask = None
        for i, (rule, wanted) in enumerate(zip(self.rules, self.wanted)):
            have = _values(rows.column(2 + i))[:, None]
            free = np.array([w is None or w == rule.wildcard for w in wanted])[None, :]
            want = np.array([have[0, 0] if w is None else w for w in wanted], dtype=have.dtype)[None, :]
            if rule.kind == "equal":
                ok = (have == want) | free
            elif rule.kind == "differ":
                ok = (have != want) | free
            elif rule.kind == "at_least":
                ok = (have >= want) | free
            else:
                ok = (have <= want) | free
            mask = ok if mask is None else mask & ok
        return mask


class _Best:
    """The best ``k`` rows of each query so far: by score down, then id up."""

    def __init__(self, queries: int, k: int):
        self.k, self.n = k, queries
        self.floor = np.full(queries, -np.inf)
        self.found = None

    def add(self, scores: np.ndarray, ids: np.ndarray, mask: np.ndarray | None = None) -> None:
        n, k = len(scores), self.k
        cutoff = self.floor
        # Once each query has ``k`` rows, few scores pass the worst of them, and nothing is put in order but these.
        if n > k and np.isneginf(cutoff).any():
            shown = scores if mask is None else np.where(mask, scores, -np.inf)
            cutoff = np.maximum(cutoff, np.partition(shown, n - k, axis=0)[n - k])
        r, q = np.nonzero(scores >= cutoff - 1e-9)
        if mask is not None:
            keep = mask[r, q]
            r, q = r[keep], q[keep]
        # Equal vectors must tie whatever kernel computed them; the slack is wider than the rounding.
        found = (q, ids[r], np.round(scores[r, q], 12))
        if self.found is not None:
            found = tuple(np.concatenate(p) for p in zip(self.found, found))
        if not len(found[0]):
            return
        q, ids, s = found
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.r_[True, q[1:] != q[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = np.arange(len(q)) - start < k
        self.found = q, ids, s = q[keep], ids[keep], s[keep]
        worst = np.full(self.n, np.inf)
        np.minimum.at(worst, q, s)
        self.floor = np.where(np.bincount(q, minlength=self.n) >= k, worst, -np.inf)


def _product(batches, queries: _Queries, k: int, scopes: tuple[str, ...], schema: pa.Schema):
    """Best rows of ``batches`` (id, vector, rule columns) for each query: within its rules, or of all rows."""
    best = {scope: _Best(len(queries.ids), k) for scope in scopes}
    for batch in batches:
        if not batch.num_rows or not len(queries.ids):
            continue
        rows, ids = matrix(batch.column(1)), _values(batch.column(0))
        if ids.dtype == object:
            ids = ids.astype(str)
        step = max(1, SCORES_PER_STEP // len(queries.ids))
        for a in range(0, len(rows), step):
            part = batch.slice(a, step)
            scores = rows[a : a + step] @ queries.vectors
            for scope in scopes:
                best[scope].add(scores, ids[a : a + step], queries.allowed(part) if scope == FILTERED else None)
    for scope, own in best.items():
        if own.found is not None:
            q, ids, s = own.found
            columns = [queries.ids.take(pa.array(q)), pa.array(ids), pa.array(s), pa.array([scope] * len(q), pa.string())]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)


FILTERED, OPEN = "filtered", "open"


def _hits(corpus: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, query_id: str, query_vec: str, rules: list[Match], scopes: tuple[str, ...]) -> DataFrame:
    """Best ``k`` rows per query and scope, with their rank."""
    from pyspark.sql.pandas.types import to_arrow_schema

    # Columns go by place, as both tables and several rules may share names.
    rows = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *[F.col(r.corpus_col).alias(f"r{i}") for i, r in enumerate(rules)]).where("vec is not null")
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vec).alias("vec"), *[F.col(r.query_col).alias(f"r{i}") for i, r in enumerate(rules)]).where("vec is not null")
    schema = T.StructType([T.StructField(query_id, asked.schema["q"].dataType), T.StructField(id_col, rows.schema["id"].dataType), T.StructField("cosine", T.DoubleType()), T.StructField("scope", T.StringType())])
    arrow = to_arrow_schema(schema)
    n = asked.count()
    if n <= QUERY_BLOCK:
        # At most one block: it goes to the rows, which stay where they are.
        block = _Queries(asked.toArrow(), rules)
        found = rows.mapInArrow(lambda batches: _product(batches, block, k, scopes, arrow), schema)
    else:
        blocks, tiles = -(-n // QUERY_BLOCK), max(1, -(-rows.count() // CORPUS_TILE))
        number = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
        every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
        left = rows.withColumn("tile", number("id", tiles)).withColumn("block", every(blocks))
        right = asked.withColumn("block", number("q", blocks)).withColumn("tile", every(tiles))

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            return pa.Table.from_batches(_product(x.to_batches(max_chunksize=8192), _Queries(y, rules), k, scopes, arrow), arrow)

        found = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(meet, schema)
    # The hits, at most queries times ``k``, are written once, as later steps read them several times.
    return cut(top_per_group(found, [query_id, "scope"], [F.desc("cosine"), F.asc(id_col)], k)).withColumn("score", (1 + F.col("cosine")) / 2)


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "fact_id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    rules: list[Match] | None = None,
) -> DataFrame:
    """Exact ``k`` nearest rows per query: (query_id, id, cosine, score, rank).

    A block of queries is multiplied with the corpus where its rows lie, and each task
    sends on its own best ``k``; the corpus is not shuffled. More queries than a block
    and the corpus are both dealt out, and each pair of a corpus tile and a query block
    is a task of one job: no task and no driver holds more than one of each.
    """
    scopes = (FILTERED,) if rules else (OPEN,)
    return _hits(corpus, queries, k, id_col, vec_col, query_id, query_vec, rules or [], scopes).drop("scope")


def knn_in_and_out(corpus: DataFrame, queries: DataFrame, k: int, rules: list[Match], id_col: str = "fact_id", vec_col: str = "embedding") -> DataFrame:
    """``knn`` within the rules and over all rows, from one product; ``scope`` tells which."""
    return _hits(corpus, queries, k, id_col, vec_col, "query_id", "embedding", rules, (FILTERED, OPEN))


def blend(first: str, second: str):
    """Half of each vector, brought back to unit length; the first alone if the second is null."""
    mixed = F.zip_with(first, second, lambda a, b: a.cast("double") * 0.5 + b.cast("double") * 0.5)
    norm = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda acc, v: acc + v * v))
    unit = F.when(norm > 0, F.transform(mixed, lambda v: v / norm)).otherwise(mixed)
    return F.when(F.col(second).isNull(), F.col(first).cast("array<double>")).otherwise(unit)


def scene_then_global(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    rules: list[Match],
    id_col: str = "fact_id",
    wanted: str | None = None,
) -> DataFrame:
    """Filtered search; where it finds fewer than wanted, the gap is filled from an open search.

    ``wanted`` names a query column with the number of rows asked for (at most ``k``).
    Returns the hits of both with column ``source`` (``scene`` or ``global``).
    """
    want = F.col(wanted) if wanted else F.lit(k)
    wants = queries.select("query_id", want.cast("int").alias("_want"))
    both = knn_in_and_out(corpus, queries, k, rules, id_col)
    scene = both.where(F.col("scope") == FILTERED).drop("scope").join(wants, "query_id").filter("rank <= _want")
    found = scene.groupBy("query_id").agg(F.count(F.lit(1)).alias("_found"))
    gap = wants.join(found, "query_id", "left").select(
        "query_id", (F.col("_want") - F.coalesce("_found", F.lit(0))).alias("_gap")
    )
    fill = both.where(F.col("scope") == OPEN).drop("scope").join(gap, "query_id").filter("rank <= _gap")
    return (
        scene.drop("_want")
        .withColumn("source", F.lit("scene"))
        .unionByName(fill.drop("_gap").withColumn("source", F.lit("global")))
    )


def attach(hits: DataFrame, corpus: DataFrame, cols: list[str], id_col: str = "fact_id") -> DataFrame:
    """Bring corpus columns to the hits. Hits number at most queries times ``k``."""
    from keepsake.session import broadcast_if_small

    return corpus.select(id_col, *cols).join(broadcast_if_small(hits), id_col)


def fan_out(queries: DataFrame, sub_queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "fact_id", rules=None) -> DataFrame:
    """Search every sub-query and keep the best hit per (query, content), first sub-query first.

    ``sub_queries`` holds (query_id, part, embedding); ``corpus`` must hold ``content``.
    """
    parts = sub_queries.withColumn("_sub", F.concat_ws("#", "query_id", "part"))
    hits = knn(corpus, parts, k, id_col, query_id="_sub", rules=rules)
    keyed = hits.join(parts.select("_sub", "query_id", "part"), "_sub")
    full = attach(keyed, corpus, ["content"], id_col)
    return top_per_group(
        full.drop("rank").withColumnRenamed("cosine", "_c"),
        ["query_id", "content"],
        [F.asc("part"), F.desc("_c"), F.asc(id_col)],
        1,
    ).select("query_id", id_col, "content", "part", F.col("_c").alias("cosine"))


def category_profile(hits: DataFrame) -> DataFrame:
    """Number of hits per category and query."""
    return hits.groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("n"))
