"""N-gram Jaccard join by a token-group matrix: all links between texts, as components.

A text is the set of its distinct five-word shingles; texts of one set fold to a
class first. Links are then found in two steps.

*Groups.* Classes that agree in most of ``KEYS`` MinHashes with a common pivot are
compared with it exactly; connected classes form a group of similar texts, every
other class is a group of its own. This step need not find every link.

*Matrix.* Of every class the prefix is taken: its first ``n - need(n) + 1`` shingles
in one global order, rare ones first. Two classes that link share a prefix shingle,
so a group's row of the matrix is the union of its members' prefixes, each shingle
with how far its members reach from there. A class, the query, meets a group at a
shingle if enough of both lies behind it, and then counts what its prefix shares
with the group's union. That count bounds the overlap with each member: beyond the
shorter prefix lie at most ``need(max(n, m)) - 1`` shingles of the larger set. Groups
below the overlap that the similarity asks for stay closed; the members of the
others are compared with the query exactly. Each pair of groups is asked once, from the smaller one, and a
class never queries its own group, where it is connected already. So no link that
matters to the components is lost, and a group of many near copies costs one
comparison with a pivot each.

Shingles are ordered by the counts of ``2**ORDER_BITS`` hash buckets over all texts,
an array of fixed size; any order gives the same result. Sets that must be compared
are made anew from the texts; a bit set of fixed size keeps most others out.

Defined cases: null or wordless texts have an empty set and are a component of
their own each; a text of one to four words has its whole sequence as its one
shingle; rows are joined by their texts, so rows of one doc_id may lie in several
components, and a component whose rows all have null doc_id has a null id; ``clean``
keeps one row of each component, rows with null doc_id last, and all rows with an
empty set; an empty table gives an empty result; other columns pass through
``clean``. Sets are told apart by a 64-bit hash of their shingles' hashes, rows by
one of id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm import linking
from keepsake.llm.common import keyed, row_key, slices
from keepsake.llm.components import components
from keepsake.llm.hashing import list_array, mix, sets, shingles
from keepsake.llm.sketches import gathered, sliced, within
from keepsake.session import cut

PERCENT = 80
KEYS = 6
LEAST_KEYS = 3
ORDER_BITS = 20
SEEN_SETS = 200_000

SIGNATURES = "doc_id bigint, row bigint, class bigint, n bigint, keys array<bigint>, slice int, cells binary"
PREFIXES = "class bigint, n bigint, tokens array<bigint>"

_ODD = mix(np.arange(101, 101 + KEYS, dtype=np.uint64)) | np.uint64(1)
_PLACE = mix(np.arange(201, 201 + KEYS, dtype=np.uint64))


def set_class(own: np.ndarray) -> int:
    """Hash of a set of shingles; 0 for the empty set only."""
    if not len(own):
        return 0
    both = np.array([own.sum(dtype=np.uint64), np.bitwise_xor.reduce(own), len(own)], np.uint64)
    return int(mix((mix(both) * _ODD[:3]).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0]) or 1


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """A row per text: class, size, MinHash keys; and behind them each task's counts of shingles by bucket."""

    def run(batches):
        counts = np.zeros(1 << ORDER_BITS, np.uint32)
        for batch in slices(batches):
            own = sets(batch.column(1))
            flat = np.concatenate([*own, np.zeros(0, np.uint64)])
            counts += np.bincount(_bucket(flat), minlength=1 << ORDER_BITS).astype(np.uint32)
            sizes = np.array([len(s) for s in own], np.int64)
            filled = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[filled]
            keys = np.zeros((len(filled), KEYS), np.uint64)
            if len(filled):
                for k in range(KEYS):
                    keys[:, k] = mix(np.minimum.reduceat(flat * _ODD[k], starts)) ^ _PLACE[k]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([set_class(s) for s in own], pa.int64()),
                    pa.array(sizes),
                    list_array(keys.reshape(-1), np.where(sizes > 0, KEYS, 0)),
                    pa.nulls(len(own), pa.int32()),
                    pa.nulls(len(own), pa.binary()),
                ],
                names=["doc_id", "row", "class", "n", "keys", "slice", "cells"],
            )
        part = sliced(counts)
        blank = [pa.nulls(part.num_rows, t) for t in (*[pa.int64()] * 4, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*blank, *part.columns], names=["doc_id", "row", "class", "n", "keys", "slice", "cells"])

    return docs.mapInArrow(run, SIGNATURES)


def needed(n, percent: int):
    """Fewest shared shingles of a set of ``n`` with any set it links to."""
    return -(-percent * n // 100)


def prefixes(docs: DataFrame, counts, percent: int) -> DataFrame:
    """class, n and prefix of every text's set, once per task."""

    def run(batches):
        # Counts to orders of magnitude, so that equal ones are ordered by hash.
        rank = counts.value
        seen: set[int] = set()
        for batch in slices(batches):
            rows = []
            for own in sets(batch.column(1)):
                name = set_class(own)
                if not name or name in seen:
                    continue
                if len(seen) < SEEN_SETS:
                    seen.add(name)
                first = len(own) - needed(len(own), percent) + 1
                order = np.lexsort((own, rank[_bucket(own)]))[:first]
                rows.append((name, len(own), own[order]))
            if rows:
                names, sizes, tokens = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), list_array(np.concatenate(tokens), np.array([len(t) for t in tokens]))],
                    names=["class", "n", "tokens"],
                )

    return docs.mapInArrow(run, PREFIXES)


def _texts(docs: DataFrame, wanted) -> DataFrame:
    """Texts whose class may be among those of a bit set, once per task."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            names = np.array([set_class(s) for s in sets(batch.column(1))], np.int64)
            chosen = []
            for i in np.flatnonzero(within(wanted.value, names)):
                if names[i] and names[i] not in seen:
                    chosen.append(i)
                    if len(seen) < SEEN_SETS:
                        seen.add(names[i])
            if chosen:
                yield pa.RecordBatch.from_arrays([pa.array(names[chosen]), batch.column(1).take(pa.array(chosen))], names=["member", "text"])

    return docs.mapInArrow(run, linking.TEXTS)


def _fewest(n: Column, m: Column, percent: int) -> Column:
    """Prefix shingles that sets of n and m must share at least, if they link."""
    overlap = F.ceil(percent * (n + m) / (100 + percent))
    beyond = F.ceil(percent * F.greatest(n, m) / 100) - 1
    return F.greatest(F.lit(1), overlap - beyond - 1)


def _grouped(classes: DataFrame, plain: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of classes to pivots, and class, n, group."""
    buckets = classes.select(F.explode("keys").alias("key"), F.col("class").alias("member"), "n")
    pairs = cut(linking.pivot_pairs(linking.with_pivots(buckets), percent).where(F.col("n_keys") >= LEAST_KEYS).select("a", "b"))
    texts = linking.texts_of(plain, pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct(), _texts)
    links = cut(linking.verified(pairs, texts, shingles, percent))
    groups = cut(components(links))
    of = classes.select("class", "n").join(groups.withColumnRenamed("node", "class"), "class", "left")
    return links, of.select("class", "n", F.coalesce("component", "class").alias("group"))


def _opened_links(plain: DataFrame, groups: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Links across groups."""
    shared = plain.sparkSession.sparkContext.broadcast(np.frexp(counts.astype(np.float64) + 1)[1].astype(np.uint8))
    table = cut(prefixes(plain, shared, percent))
    rows = table.select("class", F.posexplode("tokens").alias("place", "token"))
    # A shingle of one class matches nothing; those are nearly all.
    of_token = Window.partitionBy("token")
    rows = rows.withColumns({"low": F.min("class").over(of_token), "high": F.max("class").over(of_token)}).where("low < high")
    rows = cut(rows.select("class", "token", "place").distinct().join(groups, "class"))
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"), F.max("n").alias("most"))
    # A set of n reaches sets of m or fewer from a place, if enough of it lies behind that place.
    reach = F.expr(f"100 * n - {100 + percent} * place")
    matrix = cut(rows.groupBy("token", "group").agg(F.min("n").alias("low"), F.max(reach).alias("reach")).join(sizes, "group"))
    matrix = matrix.select("token", F.col("group").alias("host"), "low", "reach", F.struct("members", "group").alias("host_rank"), "least", "most")
    asking = cut(rows.join(sizes.select("group", "members"), "group").select("token", "class", "n", reach.alias("own"), F.struct("members", "group").alias("rank")))
    near = (F.col("own") >= percent * F.col("low")) & (F.col("reach") >= percent * F.col("n")) & F.expr(f"100 * n >= {percent} * least and 100 * most >= {percent} * n")
    met = asking.join(matrix.select("token", "host", "low", "reach", "host_rank", "least", "most"), "token").where((F.col("rank") < F.col("host_rank")) & near)
    pairs = cut(met.select("class", "host").distinct())
    # Only for these pairs all that their prefixes share is counted.
    both = pairs.join(asking.select("class", "token", "n"), "class").join(matrix.select("token", "host", "least", "most"), ["token", "host"])
    counted = both.groupBy("class", "host").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("most").alias("most"))
    low = F.greatest("least", F.ceil(percent * F.col("n") / 100))
    high = F.least("most", F.floor(100 * F.col("n") / percent))
    bound = F.least(_fewest(F.col("n"), low, percent), _fewest(F.col("n"), high, percent))
    opened = cut(counted.where(F.col("m") >= bound).select(F.col("host").alias("key"), F.col("class").alias("member"), "n"))
    spans = opened.groupBy("key").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    inside = groups.join(spans, F.col("group") == F.col("key")).where(f"100 * n >= {percent} * lo and 100 * hi >= {percent} * n")
    hosts = cut(inside.select("key", F.col("class").alias("member")))
    guests = opened.select("key", "member")
    texts = linking.texts_of(plain, guests.select("member").unionByName(hosts.select("member")).distinct(), _texts)
    return linking.opened(guests, hosts, texts, sets, percent)


def classes_and_links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, class, n of every row of a keyed table; and links a, b that connect every component of classes."""
    made = cut(signatures(docs))
    rows = made.where("slice is null").select("doc_id", "row", "class", "n")
    classes = cut(made.where("slice is null and n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("keys").alias("keys")))
    counts = gathered(made.where("slice is not null"), 1 << ORDER_BITS, "u4", np.add)
    links, groups = _grouped(classes, docs, percent)
    groups = cut(groups)
    return rows, links.unionByName(_opened_links(docs, groups, counts, percent))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id reachable by links."""
    rows, links = classes_and_links(keyed(docs, doc_id, text), percent)
    found = components(links).select(F.col("node").alias("class"), "component")
    placed = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first")).join(found, "class", "left")
    placed = cut(placed.select("class", "first", F.coalesce("component", "class").alias("component")))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = placed.join(least, "component").select("class", "component_id")
    out = rows.join(of_class, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, then of the least row key."""
    rows, links = classes_and_links(keyed(docs, doc_id, text), percent)
    found = components(links).select(F.col("node").alias("class"), "component")
    own = rows.where("n > 0").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("class").alias("class"), F.count(F.lit(1)).alias("times"))
    own = cut(own.join(found, "class", "left").select("row", "doc_id", "times", F.coalesce("component", "class").alias("component")))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "times")
    kept = cut(own.groupBy("component").agg(F.min(place).alias("keeper")).select(F.col("keeper.row").alias("_row"), F.col("keeper.times").alias("_times")))
    gone = own.select(F.col("row").alias("_row")).join(kept.where("_times = 1"), "_row", "left_anti")
    key = row_key(docs[doc_id], docs[text])
    left = docs.join(gone, key == gone["_row"], "left_anti")
    repeated = kept.where("_times > 1").select("_row")
    if repeated.isEmpty():
        return left
    # Of rows with equal id and text any one, chosen once.
    equal = docs.select(F.struct(*docs.columns).alias("whole"), key.alias("_row")).join(repeated, "_row")
    one = cut(equal.groupBy("_row").agg(F.first("whole").alias("whole")))
    return left.unionByName(one.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns]))
