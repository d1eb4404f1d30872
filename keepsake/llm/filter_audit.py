"""Filter interaction audit: which filters fail together, and what each one removes in every order.

1. One scan gives each document its part, the failure bits of all filters that look at
   the document alone, and a content hash. Texts go further only where the hash may
   occur twice (``copies``).
2. An existential self-join marks copies: a left-semi join on hash, exact text and a
   smaller doc_id. Its right side has one row per text, the least id; texts with many
   rows are dealt out in parts on the left and copied to the parts on the right.
3. The ids so marked are united with those of the other filters; bits are or-ed per
   document, and combinations of bits counted per part, with labels. A part has at
   most 2 ** filters combinations, whatever the number of documents.
4. What a filter removes depends on the set of filters before it only. Each pair of
   a filter and such a set is counted from the combinations, then dealt to the orders.

Defined cases: a null text counts as empty, and all empty texts as equal; a null part as
the empty string; a document with a null doc_id is no copy and makes none. Rows that
repeat id and text count one by one. Of several label rows of an id one that says so is
enough; a label without an id belongs to no row. Null or missing labels are 0. Empty tables give an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.copies import Repeated, hash128, same_text
from keepsake.session import cut


@dataclass(frozen=True)
class Filter:
    """``fails`` is a condition on the measurements of ``measured``; without one the filter fails copies of smaller ids."""

    letter: str
    fails: str | None


COPIES = None
FILTERS = [
    Filter("A", "n_words < 200"),
    Filter("B", "100 * n_distinct < 50 * n_words"),
    Filter("C", "100 * n_capitals > 2 * n_chars"),
    Filter("D", "has_symbol"),
    Filter("E", COPIES),
]
SYMBOL = r"[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column ``text``) and the measurements of their texts that conditions can use."""
    text = F.col("text")
    words = rows.withColumn("_words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    return words.withColumns(
        {
            "n_words": F.size("_words"),
            "n_distinct": F.size(F.array_distinct("_words")),
            "n_chars": F.length(text),
            "n_capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
            "has_symbol": text.rlike(SYMBOL),
        }
    ).drop("_words")


def _bits(filters: list[Filter]) -> Column:
    bits = F.lit(0)
    for i, f in enumerate(filters):
        if f.fails is not None:
            bits = bits.bitwiseOR(F.when(F.expr(f.fails), F.lit(1 << i)).otherwise(F.lit(0)))
    return bits


def failures(docs: DataFrame, filters: list[Filter] = FILTERS, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, part, doc_id and bits of every document; bit i is set where filter i fails it."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = rows.withColumn("hash", hash128(F.col("text")))
    repeated = Repeated.of(rows.select("hash"))
    known = repeated.flagged(measured(rows).select("doc_id", "part", "hash", "text", _bits(filters).alias("bits")))
    # Numbers of rows are written before they are compared.
    known = cut(known.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", "bits", "hash", F.when(F.col("possible"), F.col("text")).alias("text")))
    shown = ["row", "part", "doc_id", "bits"]
    possible = known.where("text is not null")
    found = possible.select(*shown)
    for i, f in enumerate(filters):
        if f.fails is None:
            found = found.unionByName(copies(possible, repeated).select("row", "part", "doc_id", F.lit(1 << i).alias("bits")))
    # A text that occurs once is no copy; its row keeps its bits.
    combined = found.groupBy("row", "part", "doc_id").agg(F.bit_or("bits").alias("bits"))
    return known.where("text is null").select(*shown).unionByName(combined)


def copies(possible: DataFrame, repeated: Repeated) -> DataFrame:
    """Rows (with doc_id, hash, text, row) whose text a smaller doc_id has too."""
    hot = repeated.hot()
    parts = F.coalesce("parts", F.lit(1))
    every = possible.join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("row"), parts).cast("int"))
    least = same_text(possible, "least", F.min, F.col("doc_id")).where("n > 1")
    right = least.join(hot, "hash", "left").select("hash", "text", "least", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    a, b = every.alias("a"), right.alias("b")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.text") == F.col("b.text"))
    return a.join(b, same & (F.col("b.least") < F.col("a.doc_id")), "left_semi")


def combinations(failed: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """part, bits, n, good, toxic: documents of each combination of failures, and those labelled."""
    # Rows of one id meet its label as one row per part and combination.
    held = failed.groupBy("part", "doc_id", "bits").agg(F.count(F.lit(1)).alias("n"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    labelled = held.join(known.where("quality = 1 or toxic = 1"), "doc_id", "left")
    total = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return labelled.groupBy("part", "bits").agg(F.sum("n").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def interactions(combined: DataFrame, filters: list[Filter] = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part and all orders of the filters.

    ``shapley``: what the filter of the step removes, summed over all orders.
    """
    spark = combined.sparkSession
    places = range(len(filters))
    sets = [(i, before) for i in places for before in range(1 << len(filters)) if not before >> i & 1]
    weight = lambda before: factorial(before.bit_count()) * factorial(len(filters) - 1 - before.bit_count())
    orders = [
        ("".join(filters[i].letter for i in order), step + 1, order[step], sum(1 << i for i in order[:step])) for order in permutations(places) for step in places
    ]
    # Tables of fixed size: (filter, set before it), and the steps of all orders.
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("filter"), F.lit(before).alias("before"), F.lit(weight(before)).alias("weight")) for i, before in sets]))
    steps = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter int, before int"))
    of_set = combined.select("*", pairs.alias("pair")).select("part", "bits", "n", "good", "toxic", "pair.*")
    own = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    fails, gone = F.col("bits").bitwiseAND(own) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    total = lambda which, what="n": F.sum(F.when(which, F.col(what)).otherwise(0)).cast("bigint")
    counted = of_set.groupBy("part", "filter", "before", "weight").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("bits") == own).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"),
        total(~gone & fails, "toxic").alias("toxic_lost"),
    )
    shapley = counted.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("weight")).cast("bigint").alias("shapley"))
    return counted.join(shapley, ["part", "filter"]).join(steps, ["filter", "before"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame, filters: list[Filter] = FILTERS, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``interactions`` of the filters over ``docs``; ``labels``: id, quality, toxic."""
    return interactions(cut(combinations(failures(docs, filters, part, doc_id, text), labels, doc_id)), filters)
