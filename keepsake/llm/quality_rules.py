"""Quality rules as a ledger: measure once, store failure bits, judge by policies of bits.

``ledger`` reads each text once and stores its measurements and one failure bit
per rule. ``apply_policy`` keeps a document if none of the policy's bits is set.
``ablations`` tells what each rule of a policy costs, with one aggregate over the
stored bits; no text is read again when a policy changes.

Everything is built-in column functions inside the scan; no row is shuffled.

Defined cases: a null text has no words; an empty table gives an empty ledger;
repeated rows are judged one by one; other columns are ignored. Lines are parts
between ``\\n``; lines without a word are no lines here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import id_text

WINDOW = 5
SYMBOLS = "#*$%&|<>"

# Rule -> fails when; the place in this list is the rule's bit, so new rules go at the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("long_words", "n_words > 0 and word_chars > 40 * n_words"),
    ("short_words", "n_words > 0 and word_chars < 2 * n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}

# Policies are never changed, only added, so that a stored verdict can be explained later.
POLICIES: dict[str, int] = {
    "base": BITS["few_words"] | BITS["repeated_windows"],
    "v1": BITS["few_words"] | BITS["repeated_windows"] | BITS["symbols"] | BITS["repeated_lines"],
    "v2": sum(BITS.values()),
}
BASE = POLICIES["base"]


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column ``text``) and the columns n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    words = docs.withColumns(
        {
            "_words": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        }
    )
    hashed = words.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")
    windows = hashed.withColumn("_windows", _windows("_hash", F.col("n_words"))).drop("_hash")
    # Most texts repeat nothing; only the others are sorted.
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = windows.withColumn("_sorted", F.when(repeats, _by_hash("_windows"))).drop("_windows")
    found = placed.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), _repeated_starts("_sorted"))).drop("_sorted")
    return found.withColumn("n_repeat_words", F.coalesce(_covered("_starts"), F.lit(0)).cast("bigint")).drop("_starts")


def _windows(hashes: str, n: Column) -> Column:
    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])

    starts = F.sequence(F.lit(0), (n - WINDOW).cast("int"))
    return F.when(n >= WINDOW, F.transform(starts, one)).otherwise(F.array().cast("array<bigint>"))


def _by_hash(windows: str) -> Column:
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated_starts(ordered: str) -> Column:
    """Starts of the windows whose hash has an equal neighbour in hash order, ascending."""

    def start(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(ordered, i - 1).getField("h"))
        after = F.get(ordered, i + 1).getField("h")
        same = F.coalesce(before == x.getField("h"), F.lit(False)) | F.coalesce(after == x.getField("h"), F.lit(False))
        return F.when(same, x.getField("i"))

    return F.sort_array(F.filter(F.transform(ordered, start), lambda i: i.isNotNull()))


def _covered(starts: str) -> Column:
    """Words under at least one of the windows: each adds what lies before the next start."""
    gaps = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


def failure_bits() -> Column:
    bits = F.lit(0)
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)))
    return bits


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the measurements and ``fail_bits``."""
    return measured(id_text(docs, doc_id, text)).withColumn("fail_bits", failure_bits()).drop("text")


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """Add ``base_failed`` and ``kept`` under ``policy``."""
    return book.withColumns({"base_failed": ~passes("base"), "kept": passes(policy)})


def accepted(docs: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
    judged = measured(rows).withColumn("fail_bits", failure_bits())
    # A filter would be pushed below the measurements and repeat them; a generator stays above.
    kept = judged.select(F.explode(F.when(passes(policy), F.array("row"))).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: documents failing it, failing it alone, and kept if it were left out."""
    mask = POLICIES[policy]
    failing = F.col("fail_bits").bitwiseAND(F.lit(mask))
    combined = book.groupBy(failing.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).alias("bit")) for n, _ in RULES if BITS[n] & mask])
    row = combined.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    others = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return row.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
        total(F.col("bits") == F.col("bit")).alias("n_failing_alone"),
        total(others == 0).alias("n_kept_without"),
    )
