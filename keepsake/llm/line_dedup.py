"""Fuzzy line dedup: MinHash on character shingles, banding, exact Jaccard, union-find.

Lines are the parts between ``\n``, without the white space around them; all that are
not blank take part, or those of at least ``least_words`` words. A line shorter than a
shingle links with equal lines only. Equal lines fold to one class first.

A class has a one-permutation MinHash signature of its distinct shingles of ``WIDTH``
characters: the least of each of ``BINS`` bins, an empty bin as empty.

* Classes of more than ``SHORT`` shingles are cut into ``BANDS`` bands of ``ROWS`` bins:
  lines of a similarity of 0.8 share a band with a chance above 0.99.
* In shorter lines bins stay empty, and lines of one template would agree in whole
  bands. Classes of up to ``SHORT`` shingles, and those long enough to link with them,
  meet at the first shingles of an order with rare ones first; lines that link share
  one of these for certain. Up to three shingles link with equal sets only.

Members of a bucket are first compared by their signatures, 16 bits a bin: each shingle
that only one of two lines has changes one bin at most, so a pair with more unequal
bins than its sizes allow cannot link (beyond 48 shingles, ``MOST_BINS`` unequal ones
are the limit; a pair of similarity 0.8 exceeds it once in 10,000). What is left is
compared exactly (``linking``), components of links are found (``components``), and of
each component the first line by (doc_id, row key, line number) is kept. A row's key is
a hash of its id and text.

Texts are read three times and never gathered: for the signatures, for the
shingles of classes that share a band, and to take the lines out. Shared arrays
have fixed sizes (``sketches``). Rows of a hot line carry 32 bytes and fold in the
task that reads them.

Defined cases: a null text stays null and has no line; rows with one doc_id are
documents of their own, and of rows with equal id and text one keeps its lines;
rows with null doc_id come last in the choice of what is kept; an empty table gives
an empty result; other columns pass through ``clean``. Classes are told apart by a
64-bit hash.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import linking
from keepsake.llm.common import id_text, keyed, row_key, slices
from keepsake.llm.components import EDGES, components
from keepsake.llm.copies import flagged
from keepsake.llm.hashing import _BASE, _BASE_INVERSE, _WHITE, PIECE, _power_table, list_array, mix, text_bytes
from keepsake.llm.sketches import PARTS, gathered, sliced, within
from keepsake.session import cut

PERCENT = 80
WIDTH = 8
# Words are cut at ASCII white space, so only this takes in lines of scripts without it.
EVERY = 1
BANDS, ROWS = 8, 3
BINS = BANDS * ROWS
SHORT = 40
MOST_BINS = 12
# Shingles of short lines are ordered by counts of 2**ORDER_BITS hash buckets; any order is right.
ORDER_BITS = 20
# A task forgets which lines it has seen beyond so many; they are then described again.
SEEN_LINES = 50_000
# Characters of lines that are described at a time (or one line).
CHARACTERS = 1 << 16

# Of a bucket of so many members the near pairs are listed, of a larger one tiles are compared.
SMALL_BUCKET = 64

SHAPE = "struct<n:bigint,marks:array<bigint>,grams:array<bigint>>"
LINES = f"doc_id bigint, row bigint, line bigint, class bigint, shape {SHAPE}"

_NEWLINE = 10
_POINTS = mix(np.arange(1, 1 << 14, dtype=np.uint64))


class Lines:
    """The lines that take part of the texts of a column: rows, numbers, classes and places."""

    def __init__(self, column: pa.Array, least_words: int = EVERY):
        raw, rows = text_bytes(column)
        white = _WHITE[raw]
        n = len(raw)
        first = np.zeros(n, bool)
        first[rows[:-1][rows[:-1] < n]] = True
        breaks = np.flatnonzero(raw == _NEWLINE)
        starts = np.unique(np.concatenate([rows[:-1], breaks + 1]))
        starts = starts[starts <= n]
        row = np.searchsorted(rows, starts, "right") - 1
        # A line start behind a text's last character belongs to that text and is empty.
        ends = np.minimum(np.append(starts[1:], n), rows[1:][np.minimum(row, len(rows) - 2)]) if len(starts) else starts
        inside = ~white
        word_first = inside.copy()
        word_first[1:] &= white[:-1]
        word_first |= inside & first
        before = np.concatenate([[0], np.cumsum(word_first)])
        words = before[ends] - before[starts]
        line = np.arange(len(starts)) - np.searchsorted(starts, rows[:-1])[np.minimum(row, len(rows) - 2)] if len(starts) else starts
        use = words >= least_words
        solid = np.flatnonzero(inside)
        self.raw, self.row, self.line = raw, row[use], line[use]
        starts, ends = starts[use], ends[use]
        self.starts = solid[np.searchsorted(solid, starts)] if len(starts) else starts
        self.ends = solid[np.searchsorted(solid, ends) - 1] + 1 if len(starts) else ends

    def texts(self, chosen: np.ndarray) -> list[str]:
        return [self.raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(self.starts[chosen], self.ends[chosen])]

    def classes(self) -> np.ndarray:
        """A 64-bit hash of each line."""
        out = np.zeros(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + PIECE)))
            low, high = self.starts[i], self.ends[j - 1]
            out[i:j] = exact_ranges(self.raw[low:high], self.starts[i:j] - low, self.ends[i:j] - low)
            i = j
        return out


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines, line after line, and their number; a line shorter than a shingle has one."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    many = np.maximum(sizes - WIDTH + 1, 1)
    points = _POINTS[points] if len(points) and points.max() < len(_POINTS) else mix(points + np.uint64(1))
    # Characters beyond a short line's end count as blanks of their own kind.
    padded = np.maximum(sizes, WIDTH)
    wide = np.zeros(int(padded.sum()), np.uint64)
    offset = np.cumsum(padded) - padded
    wide[np.repeat(offset - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(points))] = points
    at = np.repeat(offset - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    n = len(wide)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(wide * _power_table(_BASE, n + 1)[:n], out=sums[1:], dtype=np.uint64)
    return mix((sums[at + WIDTH] - sums[at]) * _power_table(_BASE_INVERSE, n + 1)[at]), many


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return characters(column.to_pylist())


def line_sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each line of a column, ascending."""
    hashes, many = characters(column.to_pylist())
    ends = np.cumsum(many)
    return [np.unique(hashes[e - n : e]) for e, n in zip(ends, many)]


_EXACT = np.random.RandomState(11).randint(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def exact_ranges(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, letters as they are."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_EXACT[raw] * _power_table(_BASE, n + 1)[:n], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * _power_table(_BASE_INVERSE, n + 1)[starts])


def shapes(texts: list[str], percent: int = PERCENT) -> pa.StructArray:
    """Number of distinct shingles, signature by bands and (of short lines) shingles of each line."""
    sizes = np.cumsum([len(t) for t in texts])
    parts, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] - len(texts[i]) + CHARACTERS, "right")))
        parts.append(_shapes(texts[i:j], percent))
        i = j
    return pa.concat_arrays(parts) if parts else _shapes([], percent)


def _shapes(texts: list[str], percent: int) -> pa.StructArray:
    hashes, many = characters(texts)
    lines = len(many)
    # 44 bits of a shingle below the number of its line: sorted, the distinct shingles of each line in order.
    own = np.sort(np.repeat(np.arange(lines, dtype=np.uint64) << np.uint64(44), many) | hashes >> np.uint64(20))
    own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
    line, gram = (own >> np.uint64(44)).astype(np.int64), own & np.uint64((1 << 44) - 1)
    n = np.bincount(line, minlength=lines)
    cells = np.zeros(lines * BINS, np.uint64)
    at = line * BINS + ((gram & np.uint64(0xFFFFF)) * np.uint64(BINS) >> np.uint64(20)).astype(np.int64)
    # Of several values for a cell the last stays, so in descending order the least.
    cells[at[::-1]] = gram[::-1] + np.uint64(1)
    marks = np.where(cells > 0, mix(cells) % np.uint64(65535) + np.uint64(1), np.uint64(0)).reshape(lines * BANDS, ROWS)
    # The bins of a band side by side in one number; 0 if all are empty.
    bands = marks[:, 0] | marks[:, 1] << np.uint64(16) | marks[:, 2] << np.uint64(32)
    short = n * percent <= 100 * SHORT
    listed = [list_array(bands, np.full(lines, BANDS)), list_array(gram[short[line]], np.where(short, n, 0))]
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), *listed], names=["n", "marks", "grams"])


def described(docs: DataFrame, least_words: int = EVERY, percent: int = PERCENT) -> DataFrame:
    """One row per line that takes part; its shape comes with the first of equal lines of a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            lines = Lines(batch.column(1), least_words)
            classes = lines.classes()
            own, first = np.unique(classes, return_index=True)
            fresh = np.sort(first[[c not in seen for c in own.tolist()]]) if len(own) else first
            seen.update(own.tolist())
            if len(seen) > SEEN_LINES:
                seen = set()
            place = np.full(len(classes), -1)
            place[fresh] = np.arange(len(fresh))
            shape = shapes(lines.texts(fresh), percent).take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(lines.row)) for i in (0, 2)), pa.array(lines.line), pa.array(classes.view(np.int64)), shape],
                names=["doc_id", "row", "line", "class", "shape"],
            )

    return docs.mapInArrow(run, LINES)


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> (44 - ORDER_BITS)).astype(np.int64)


def _gram_counts(short: DataFrame) -> np.ndarray:
    def run(batches):
        counts = np.zeros(1 << ORDER_BITS, np.uint32)
        for batch in batches:
            counts += np.bincount(_bucket(batch.column(0).flatten().to_numpy()), minlength=1 << ORDER_BITS).astype(np.uint32)
        yield sliced(counts)

    return gathered(short.select("grams").mapInArrow(run, PARTS), 1 << ORDER_BITS, "u4", np.add)


def _buckets(classes: DataFrame, percent: int) -> DataFrame:
    """key, member, n: bands of long lines, rare shingles of short ones."""
    shown = classes.select(F.col("class").alias("member"), "shape.*")
    long = shown.where(F.col("n") > SHORT).select("member", "n", F.posexplode("marks").alias("band", "mark")).where("mark <> 0")
    long = long.select(F.xxhash64("band", "mark").alias("key"), "member", "n")
    short = shown.where("size(grams) > 0").select("member", "n", "grams")
    # Counts to orders of magnitude, so that equal ones are ordered by hash.
    counts = _gram_counts(short)
    rank = classes.sparkSession.sparkContext.broadcast(np.frexp(counts.astype(np.float64) + 1)[1].astype(np.uint8))

    def run(batches):
        for batch in batches:
            grams, n = batch.column(2).flatten().to_numpy(), batch.column(1).to_numpy()
            line = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((grams, rank.value[_bucket(grams)], line))
            place = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n)
            first = np.where(n <= 3, 1, n - -(-percent * n // 100) + 1)
            keep = place < first[line]
            keys, row = grams[order][keep], line[keep]
            # Few shingles: the whole set is the key.
            whole = mix(np.add.reduceat(mix(grams.astype(np.uint64)), np.cumsum(n) - n)).view(np.int64) if len(n) else n
            keys = np.where(n[row] <= 3, whole[row], keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(batch.column(i).take(pa.array(row)) for i in range(2))], names=["key", "member", "n"])

    every = long.unionByName(short.mapInArrow(run, long.schema))
    # Most keys have one member; only rows of the others are brought together.
    shared = cut(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    return flagged(every, "key", shared).where("possible").drop("possible")


def _bins(marks: pa.Array) -> np.ndarray:
    return marks.flatten().to_numpy().view(np.uint16).reshape(len(marks), -1)


def _most_unequal(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum(MOST_BINS, np.minimum(n, m) // 4)


def near(pairs: DataFrame, shown: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures (``shown``: member, n, marks) allow a link."""
    both = pairs.select("a", "b")
    for c in ("a", "b"):
        both = both.join(shown.select(F.col("member").alias(c), F.col("n").alias(f"n_{c}"), F.col("marks").alias(f"marks_{c}")), c)
    both = both.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            unequal = (_bins(batch.column(4)) != _bins(batch.column(5))).sum(axis=1) if len(n) else n
            keep = pa.array(unequal <= _most_unequal(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "marks_a", "marks_b").mapInArrow(run, EDGES)


def _near_tables(x: pa.Table, y: pa.Table) -> np.ndarray:
    """``near`` for all pairs of two tiles."""

    n, m = x.column("n").to_numpy()[:, None], y.column("n").to_numpy()[None, :]
    unequal = np.zeros((len(x), len(y)), np.int64)
    for a, b in zip(*(_bins(t.column("marks").combine_chunks()).T for t in (x, y))):
        unequal += a[:, None] != b[None, :]
    return (unequal <= _most_unequal(n, m)) & (x.column("member").to_numpy()[:, None] != y.column("member").to_numpy()[None, :])


def _texts(docs: DataFrame, wanted, least_words: int = EVERY) -> DataFrame:
    """Lines whose class may be among those of a bit set, once per task."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            lines = Lines(batch.column(1), least_words)
            classes = lines.classes()
            own, first = np.unique(classes, return_index=True)
            fresh = first[within(wanted.value, own.view(np.int64)) & np.array([c not in seen for c in own.tolist()], bool)]
            if len(seen) < SEEN_LINES:
                seen.update(classes[fresh].tolist())
            if len(fresh):
                yield pa.RecordBatch.from_arrays([pa.array(classes[fresh].view(np.int64)), pa.array(lines.texts(fresh), pa.string())], names=["member", "text"])

    return docs.mapInArrow(run, linking.TEXTS)


def shared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = EVERY) -> DataFrame:
    """row, line, class and kept of every line that has copies; of rows with one key all have the kept line or none."""
    plain = id_text(docs, doc_id, text)
    lines = cut(described(keyed(docs, doc_id, text), least_words, percent))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line")
    classes = cut(lines.groupBy("class").agg(F.min(place).alias("place"), F.first("shape", True).alias("shape"), F.count(F.lit(1)).alias("lines")))
    pivoted = cut(linking.with_pivots(_buckets(classes, percent)))
    members = pivoted.select("member").distinct()
    shown = classes.select(F.col("class").alias("member"), "shape.n", "shape.marks")
    shown = cut(flagged(shown, "member", cut(members)).where("possible").select("member", "n", "marks"))
    texts = linking.texts_of(plain, members, partial(_texts, least_words=least_words))
    compared = lambda pairs: linking.verified(near(pairs, shown, percent), texts, _shingles, percent)
    groups = components(compared(linking.pivot_pairs(pivoted, percent)))
    visitors, hosts = (side.join(shown, "member") for side in linking.left_over(pivoted, groups))
    sizes = hosts.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    few, many = (cut(sizes.where(w).select("key")) for w in (f"size <= {SMALL_BUCKET}", f"size > {SMALL_BUCKET}"))
    listed = visitors.join(few, "key").select("key", F.col("member").alias("x")).join(hosts.select("key", F.col("member").alias("y")), "key").where("x <> y")
    listed = compared(listed.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    tiles = linking.opened(visitors.join(many, "key"), hosts.join(many, "key"), texts, line_sets, percent, _near_tables)
    found = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(listed).unionByName(tiles))
    found = cut(found)
    roots = found.select(F.col("component").alias("class"), "component").distinct()
    component = F.coalesce("component", "class")
    joined = classes.select("class", "place", "lines").join(found.withColumnRenamed("node", "class").unionByName(roots), "class", "left")
    # A class of one line without links keeps it.
    joined = cut(joined.where("component is not null or lines > 1").select("class", component.alias("component"), "place"))
    keepers = joined.groupBy("component").agg(F.min("place").alias("keeper"))
    of_class = cut(joined.join(keepers, "component").select("class", "keeper"))
    kept = (F.col("row") == F.col("keeper.row")) & (F.col("line") == F.col("keeper.line"))
    possible = flagged(lines.select("row", "line", "class"), "class", of_class.select("class")).where("possible")
    return possible.select("row", "line", "class").join(of_class, "class").select("row", "line", "class", kept.alias("kept"))


def _dropped(docs: DataFrame, out: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct) and ``gone``, the numbers of its lines to take out."""
    every = F.collect_set("line")
    drops = out.groupBy(F.col("row").alias("key")).agg(F.collect_set(F.when(~F.col("kept"), F.col("line"))).alias("gone"), every.alias("every"), F.count(F.lit(1)).alias("n"))
    # Of rows with one key each line is there as often as the row.
    drops = drops.select("key", "gone", F.when(F.col("n") > F.size("every"), F.col("every")).alias("every"))
    drops = cut(drops.where("size(gone) > 0 or every is not null"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key(F.col(doc_id), F.col(text)).alias("key"))
    # Rows that keep all their lines stay where they are. The drops grow with the rows: they are never broadcast.
    marked = flagged(rows, "key", drops.select("key"))
    joined = marked.where("possible").drop("possible").join(drops.hint("merge"), "key", "left")
    whole = marked.where("not possible").select("row", F.lit(None).cast("array<bigint>").alias("gone"))
    repeated = drops.where("every is not null")
    if repeated.isEmpty():
        return whole.unionByName(joined.select("row", "gone"))
    # The first of equal rows keeps its lines, the others lose all that take part. Places are written before they are compared.
    placed = cut(rows.join(repeated, "key").withColumn("place", F.monotonically_increasing_id()))
    first = placed.groupBy("key").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    decided = placed.join(first, "place", "left").select("row", F.when(F.col("first"), F.col("gone")).otherwise(F.col("every")).alias("gone"))
    return whole.unionByName(joined.where("every is null").select("row", "gone")).unionByName(decided)


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = EVERY) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), ``text`` without surplus lines, n_lines and n_dropped."""
    joined = _dropped(docs, shared(docs, doc_id, text, percent, least_words), doc_id, text)
    whole = F.col("row").getField(text).cast("string")
    n_lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), whole).otherwise(F.arrow_udf(_without, "string")(whole, F.col("gone"))).alias("text"),
        F.when(whole.isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"),
        F.size(F.coalesce("gone", F.array().cast("array<bigint>"))).cast("bigint").alias("n_dropped"),
    )


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of these numbers."""

    def rest(text, numbers):
        if text is None or not numbers:
            return text
        out = set(numbers)
        return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in out])

    return pa.array([rest(t, g) for t, g in zip(texts.to_pylist(), gone.to_pylist())], pa.string())


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = EVERY) -> DataFrame:
    """``docs`` with surplus lines taken out of their texts."""
    done = counted(docs, doc_id, text, percent, least_words)
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
