"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short and documents long, so the Jaccard similarity of the two
says nothing; what counts is the part of the item's five-word shingles that the
document holds. Items are partitioned by the size of their shingle set. An item
of q shingles is represented by its bottom MinHash sketch, its smallest hashes;
a document that holds ``PERCENT`` of the item lacks at most ``q - need`` of its
shingles, so a sketch of ``q - need + 1`` hashes meets every such document: the
search has no false negatives at any document length. A partition states the
largest sketch hash and the least document size of its items, and a document
looks up only its own hashes below that mark, and only if it is large enough.
Whatever meets a sketch is verified by exact shingle containment.

The item side is searched in blocks of at most ``BLOCK_SHINGLES`` shingles in
all, which bounds what is broadcast; each block reads the documents once, without
a shuffle. A document is taken whole, in the task that reads it.

Defined cases: null or wordless texts and items have no shingles and match
nothing; a text of one to four words has its whole sequence as its one shingle;
repeated rows give repeated results, repeated items (same id and text) count
once; empty tables give empty results; other columns pass through ``clean``
untouched and are ignored by ``search``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.common import id_text, slices
from keepsake.llm.hashing import list_array, sets, shingles
from keepsake.session import cut

PERCENT = 80
BLOCK_SHINGLES = 1 << 20
FLAG_BITS = 20

HITS = "doc_id bigint, item_id bigint, n_shared bigint, n_item_shingles bigint, containment double"


def needed(q: int) -> int:
    """Fewest shingles of an item of ``q`` that make a hit."""
    return -(-PERCENT * q // 100)


@dataclass
class Index:
    """Sketches and full sets of one block of items."""

    ids: list[int]
    items: list[np.ndarray]

    def __post_init__(self):
        classes = np.array([len(s).bit_length() for s in self.items], int)
        self.partitions = []
        for c in sorted(set(classes.tolist())):
            own = np.flatnonzero(classes == c)
            sketches = [self.items[i][: len(self.items[i]) - needed(len(self.items[i])) + 1] for i in own]
            hashes, item = np.concatenate(sketches), np.repeat(own, [len(s) for s in sketches])
            order = np.argsort(hashes, kind="stable")
            hashes, item = hashes[order], item[order]
            flags = np.zeros(1 << FLAG_BITS, bool)
            flags[hashes >> np.uint64(64 - FLAG_BITS)] = True
            least = min(needed(len(self.items[i])) for i in own)
            self.partitions.append((least, hashes[-1], flags, hashes, item))

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items of which one sketch hash is among ``hashes``."""
        found: set[int] = set()
        for least, mark, flags, sketch, item in self.partitions:
            if len(hashes) < least:
                continue
            low = hashes[flags[hashes >> np.uint64(64 - FLAG_BITS)]]
            low = low[low <= mark]
            first, last = np.searchsorted(sketch, low, "left"), np.searchsorted(sketch, low, "right")
            for a, b in zip(first[last > first], last[last > first]):
                found.update(item[a:b].tolist())
        return found

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item id, shared shingles, item shingles) of all texts of a column."""
        hashes, many = shingles(column)
        ends = np.cumsum(many)
        # One test over the whole slice leaves few texts to look at.
        any_flag = np.zeros(1 << FLAG_BITS, bool)
        for p in self.partitions:
            any_flag |= p[2]
        flagged = np.flatnonzero(any_flag[hashes >> np.uint64(64 - FLAG_BITS)])
        for row in np.unique(np.searchsorted(ends, flagged, "right")):
            own = hashes[ends[row] - many[row] : ends[row]]
            found = sorted(self.candidates(own))
            if not found:
                continue
            whole = np.unique(own)
            for i in found:
                q = len(self.items[i])
                shared = int(np.isin(self.items[i], whole, assume_unique=True).sum())
                if 100 * shared >= PERCENT * q:
                    yield int(row), self.ids[i], shared, q


def _blocks(items: DataFrame, item_id: str, text: str) -> list[tuple[list[int], list[np.ndarray]]]:
    """The items in blocks of bounded size; a block is gathered when it is searched."""
    plain = id_text(items, item_id, text).where("text is not null").distinct()

    def hashed(batches):
        for batch in slices(batches):
            own = sets(batch.column(1))
            flat = np.concatenate([*own, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(flat, np.array([len(s) for s in own]))], names=["item_id", "hashes"])

    table = plain.mapInArrow(hashed, "item_id bigint, hashes array<bigint>").where("size(hashes) > 0")
    total = table.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_SHINGLES))
    for k in range(n):
        rows = table.where(F.pmod(F.xxhash64("item_id", "hashes"), F.lit(n)) == k).collect()
        if rows:
            yield [r.item_id for r in rows], [np.array(r.hashes, np.int64).view(np.uint64) for r in rows]


def _each_block(spark: SparkSession, items: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[Callable[[], Index], Callable[[DataFrame], DataFrame]]]:
    """Each block's index, and what to do with the result of its pass.

    With several blocks a pass is written out and its block taken from the executors
    before the next one is searched; a single block stays until the result is read.
    """
    blocks = _blocks(items, item_id, item_text)
    block, following = next(blocks, None), next(blocks, None)
    several = following is not None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)

        def done(result: DataFrame, shared=shared) -> DataFrame:
            if not several:
                return result
            result = cut(result)
            shared.destroy()
            return result

        yield (lambda shared=shared: Index(*shared.value)), done
        block, following = following, next(blocks, None)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All pairs of a document and an item of which it holds at least ``PERCENT`` of the shingles."""
    plain, found = id_text(docs, doc_id, text), []
    for index, done in _each_block(docs.sparkSession, items, item_id, item_text):

        def run(batches, index=index):
            known = index()
            for batch in slices(batches):
                hits = list(known.hits(batch.column(1)))
                if hits:
                    row, item, shared, q = (np.array(c) for c in zip(*hits))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(item), pa.array(shared), pa.array(q), pa.array(shared / q)],
                        names=["doc_id", "item_id", "n_shared", "n_item_shingles", "containment"],
                    )

        found.append(done(plain.mapInArrow(run, HITS)))
    if not found:
        return docs.sparkSession.createDataFrame([], HITS)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    place = docs.columns.index(text)
    for index, done in _each_block(docs.sparkSession, items, item_id, item_text):

        def run(batches, index=index):
            known = index()
            for batch in slices(batches, text):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in known.hits(batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        docs = done(docs.mapInArrow(run, docs.schema))
    return docs
