"""Links between texts that share a bucket, without all pairs of a bucket.

Every member of a bucket is compared with ``PIVOTS`` members of it;
a bucket of at most ``PIVOTS + 1`` members is compared in full that way. What those
links connect needs no further comparison. In a larger bucket, members outside its
largest component so far are then compared with the whole bucket, in tiles of
bounded size. A tile returns a forest of its links, so output is linear in the
members even where everything is linked.

Members travel with their texts; sets are made where two of them meet, by the
``sets`` function of the operator (an Arrow column to sorted arrays of hashes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import slices
from keepsake.llm.components import EDGES, forest_edges
from keepsake.llm.sketches import bit_set
from keepsake.session import cut

PIVOTS = 4
TILE = 256
# Columns of one block of a tile's incidence matrices.
COLUMNS = 8192
PAIR_BYTES = 1 << 17

TEXTS = "member bigint, text string"


def texts_of(docs: DataFrame, members: DataFrame, make) -> DataFrame:
    """member, text of the classes in the one column of ``members`` and of few others.

    ``make(docs, wanted)`` gives the texts of classes that may be in a bit set of fixed size.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(bit_set(members))
    return cut(make(docs, wanted).groupBy("member").agg(F.first("text").alias("text")))


def with_pivots(buckets: DataFrame) -> DataFrame:
    """``buckets`` (key, member, n) of two members or more, with ``pivots`` and the bucket's ``size``.

    Pivots are the members that meet most others over all their buckets: of a group
    of near copies, those nearest to what the copies have in common.
    """
    # Most buckets have one member and go before anything is ordered.
    shared = cut(buckets.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1"))
    met = shared.groupBy("member").agg(F.sum("size").alias("met"))
    order = Window.partitionBy("key").orderBy(F.desc("met"), "member").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pivot = F.struct("member", "n")
    pivots = F.filter(F.array(*[F.nth_value(pivot, k + 1).over(order) for k in range(PIVOTS)]), lambda p: p.isNotNull())
    return shared.join(met, "member").withColumn("pivots", pivots).drop("met")


def pivot_pairs(pivoted: DataFrame, percent: int) -> DataFrame:
    """a, b, n_keys: members and pivots whose sizes allow a link, and in how many buckets they meet."""
    pair = pivoted.select("member", "n", F.transform("pivots", lambda p: p["member"]).alias("all"), F.explode("pivots").alias("p"))
    # Two pivots of one bucket meet once in it.
    pair = pair.where("p.member < member or (p.member > member and not array_contains(all, member))")
    pair = pair.where(f"100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
    return pair.groupBy(F.greatest("member", "p.member").alias("a"), F.least("member", "p.member").alias("b")).agg(F.count(F.lit(1)).alias("n_keys"))


def verified(pairs: DataFrame, texts: DataFrame, shingles, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the Jaccard similarity; ``shingles`` gives the hashes of a column's texts and their numbers."""
    both = pairs.select("a", "b").join(texts.select(F.col("member").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("member").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        # Few texts at a time, as all their shingles are sorted.
        for batch in slices(batches, "x", PAIR_BYTES):
            for part in slices([batch], "y", PAIR_BYTES, ends=False):
                keep = _alike(*shingles(part.column(2)), *shingles(part.column(3)), percent)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, EDGES)


def _alike(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets reach the similarity: hashes of ``n[i]`` and ``m[i]`` shingles, repeats among them; empty sets do not."""
    pairs = len(n)
    # The number of the pair and the first bits of the hash, some 50, make one number to sort by.
    bits = np.uint64(64 - max(1, pairs).bit_length())

    def sets(hashes, many):
        own = np.sort(np.repeat(np.arange(pairs, dtype=np.uint64) << bits, many) | hashes >> (np.uint64(64) - bits))
        return own[np.append(True, own[1:] != own[:-1])] if len(own) else own

    def count(members):
        return np.bincount((members >> bits).astype(np.int64), minlength=pairs)

    a, b = sets(x, n), sets(y, m)
    every = np.sort(np.concatenate([a, b]))
    shared = count(every[1:][every[1:] == every[:-1]])
    return (shared > 0) & (100 * shared >= percent * (count(a) + count(b) - shared))


def left_over(pivoted: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visitors and hosts (key, member): of buckets of more than PIVOTS + 1 members that ``groups`` (node, component) leaves apart.

    Visitors are the members outside the bucket's largest component, hosts all members.
    Of buckets with the same members one is taken.
    """
    large = pivoted.where(F.col("size") > PIVOTS + 1).select("key", "member")
    print_ = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("member") % (1 << 40)), F.bit_xor(F.xxhash64("member")))
    once = large.groupBy("key").agg(print_.alias("f")).groupBy("f").agg(F.min("key").alias("key")).select("key")
    placed = large.join(once, "key").join(groups.withColumnRenamed("node", "member"), "member", "left")
    placed = cut(placed.select("key", "member", F.coalesce("component", "member").alias("component")))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    apart = placed.join(tops, "key")
    return apart.where("component <> top.component").select("key", "member"), apart.select("key", "member")


def _tiled(rows: DataFrame, own: str, other: str, counts: DataFrame) -> DataFrame:
    """Give each row its own tile number and copy it to all tiles of the other side."""
    more = [c for c in rows.columns if c not in ("key", "member")]
    tile = F.pmod(F.xxhash64("member"), F.ceil(F.col(f"n_{own}") / TILE).cast("bigint"))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(f"n_{other}") / TILE).cast("bigint") - 1))
    return rows.join(counts, "key").select("key", "member", *more, tile.alias(f"{own}_tile"), copies.alias(f"{other}_tile"), F.lit(own == "visitor").alias("visits"))


def opened(visitors: DataFrame, hosts: DataFrame, texts: DataFrame, sets, percent: int, near=None) -> DataFrame:
    """Links a, b between visitors and hosts (key, member each) of a key, as forests of tiles.

    ``near`` (two Arrow tables of further columns to a matrix of flags) may rule pairs
    out before any text moves: of a tile only members with a partner left get theirs.
    """
    counts = visitors.groupBy("key").agg(F.count(F.lit(1)).alias("n_visitor")).join(hosts.groupBy("key").agg(F.count(F.lit(1)).alias("n_host")), "key")
    both = _tiled(visitors, "visitor", "host", counts).unionByName(_tiled(hosts, "host", "visitor", counts))
    if near is not None:

        def partners(group: pa.Table) -> pa.Table:
            flags = group.column("visits").to_numpy()
            guests, rest = np.flatnonzero(flags), np.flatnonzero(~flags)
            left = near(group.take(pa.array(guests)), group.take(pa.array(rest)))
            chosen = np.concatenate([guests[left.any(axis=1)], rest[left.any(axis=0)]])
            return group.select(["key", "member", "visitor_tile", "host_tile", "visits"]).take(pa.array(chosen))

        both = cut(both.groupBy("key", "visitor_tile", "host_tile").applyInArrow(partners, both.select("key", "member", "visitor_tile", "host_tile", "visits").schema))
    rows = both.select("key", "member", "visitor_tile", "host_tile", "visits").join(texts, "member")

    def compare(group: pa.Table) -> pa.Table:
        flags = group.column("visits").to_numpy()
        names = group.column("member").to_numpy()
        own = sets(group.column("text").combine_chunks())
        guests, rest = np.flatnonzero(flags), np.flatnonzero(~flags)
        i, j = linked([own[g] for g in guests], [own[h] for h in rest], percent)
        edges = forest_edges(names[guests][i], names[rest][j])
        return pa.table([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], names=["a", "b"])

    return rows.groupBy("key", "visitor_tile", "host_tile").applyInArrow(compare, EDGES)


def linked(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of all pairs of sorted sets that reach the similarity; empty sets link with nothing."""
    if not x or not y:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    shared = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(common), COLUMNS):
        block = common[at : at + COLUMNS]
        shared += _incidence(x, block) @ _incidence(y, block).T
    sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    counts = np.rint(shared).astype(np.int64)
    return np.nonzero((100 * counts >= percent * (sizes - counts)) & (counts > 0))


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, s in enumerate(sets):
        own = s[(s >= columns[0]) & (s <= columns[-1])]
        at = np.searchsorted(columns, own)
        out[i, at[columns[at] == own]] = 1
    return out
