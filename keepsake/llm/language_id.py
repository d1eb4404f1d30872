"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of presence: for every order 1
to 4, the number of character n-grams both hold, divided by the root of the
product of how many each holds, summed over the orders. N-grams are hashed to
``SIZES`` buckets per order; letters are lower-cased, all else is a blank.

Training takes a bounded sample, the ``PER_LANGUAGE`` labelled documents of each
language with the smallest hash of their id. ``LANDMARKS`` of them span the
Nyström approximation of the kernel, in which one ridge regression per language
against the rest is solved. Executors make the n-gram sets; the driver gets them
as packed bits, ``PER_LANGUAGE`` x 7 KB a language. Since the kernel is linear in
the presence of n-grams once a text's sizes are known, landmarks and weights fold
into one matrix, and whole texts are scored by batched products with it.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and
so is every text if nothing was learned. Rows with null id are scored and never
learned from. Of equal scores the first language by alphabet wins. Repeated rows
get equal results; an empty table gives an empty result; other columns are
ignored. Label, source and id are never read when a text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import kept_in_worker, slices

SIZES = (1 << 10, 1 << 12, 1 << 14, 1 << 15)
PER_LANGUAGE = 300
LANDMARKS = 256
RIDGE = 0.01
SHARPNESS = 4.0
# Texts of one product: bounds the block of presence flags.
ROWS = 32

_STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters() -> np.ndarray:
    """Lower-cased code point of every letter, 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


def presence(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the hashed n-grams of every text (rows), orders side by side; and whether it has a letter."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    many = np.array([len(p) for p in parts])
    code = letters[np.concatenate([*parts, np.zeros(0, np.uint32)])].astype(np.uint64)
    ends = np.cumsum(many)
    flags = np.zeros((len(texts), sum(SIZES)), bool)
    row = np.repeat(np.arange(len(texts)) * sum(SIZES), many)
    last = np.repeat(ends, many)
    flat, base, value = flags.reshape(-1), 0, np.zeros(len(code), np.uint64)
    place = np.arange(len(code))
    for order, size in enumerate(SIZES, 1):
        # The value of the n-gram at i: that of its first n-1 characters, carried on by the n-th.
        n = max(0, len(code) - order + 1)
        value = (value[:n] * _STEP + code[order - 1 :] + np.uint64(1)) * _STEP
        bucket = (value >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
        inside = place[:n] + order <= last[:n]
        flat[row[:n][inside] + base + bucket[inside]] = True
        base += size
    has_letter = np.array([bool((code[e - n : e] != 0).any()) for e, n in zip(ends, many)], bool)
    return flags, has_letter


def normed(flags: np.ndarray) -> np.ndarray:
    """Flags as numbers, each order divided by the root of its count: products of rows are the kernel."""
    out, base = flags.astype(np.float32), 0
    for size in SIZES:
        count = np.maximum(np.count_nonzero(flags[:, base : base + size], axis=1), 1)
        out[:, base : base + size] /= np.sqrt(count, dtype=np.float32)[:, None]
        base += size
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages

    def score(self, flags: np.ndarray) -> np.ndarray:
        """One row of numbers per text that sum to 1."""
        raw = SHARPNESS * (normed(flags) @ self.weights).astype(np.float64)
        raw = np.exp(raw - raw.max(axis=1, keepdims=True))
        return raw / raw.sum(axis=1, keepdims=True)


def train(flags: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``flags`` in an order in which the languages alternate; the first rows are the landmarks."""
    languages = sorted(set(labels))
    x = normed(flags)
    marks = x[:landmarks]
    values, basis = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = basis[:, keep] / np.sqrt(values[keep])
    features = (x @ marks.T).astype(np.float64) @ root
    target = np.array([[1.0 if label == name else -1.0 for name in languages] for label in labels])
    system = features.T @ features + ridge * len(labels) * np.eye(features.shape[1])
    solved = np.linalg.solve(system, features.T @ target)
    return Model(languages, (marks.T @ (root @ solved)).astype(np.float32))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from rows of ``docs`` that have an id, a text and a label and aren't held out; None if there is none."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    # Ids are chosen first, so that texts of other rows are not sorted.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "lang").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    # One text of each chosen id, however many rows have it.
    sample = rows.join(F.broadcast(chosen), ["id", "lang"]).groupBy("rank", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches):
        letters = kept_in_worker("letters", _letters)
        for batch in slices(batches):
            flags, has_letter = presence(batch.column(2).to_pylist(), letters)
            bits = [np.packbits(f).tobytes() if h else None for f, h in zip(flags, has_letter)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["rank", "lang", "bits"])

    found = sorted((r.rank, r.lang, r.bits) for r in sample.mapInArrow(run, "rank int, lang string, bits binary").where("bits is not null").collect())
    if not found:
        return None
    flags = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for _, _, b in found]), axis=1)[:, : sum(SIZES)].astype(bool)
    return train(flags, [lang for _, lang, _ in found])


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))

    def run(batches):
        letters, known = kept_in_worker("letters", _letters), shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            names, scores = [], []
            for i in range(0, len(texts), ROWS):
                flags, has_letter = presence(texts[i : i + ROWS], letters)
                if known is None:
                    has_letter[:] = False
                made = known.score(flags) if has_letter.any() else np.zeros((len(flags), 1))
                best = made.argmax(axis=1)
                names += [known.languages[b] if h else "und" for b, h in zip(best, has_letter)]
                scores += np.where(has_letter, made[np.arange(len(best)), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = dict(plain.dtypes)["doc_id"]
    return plain.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
