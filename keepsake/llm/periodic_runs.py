"""Periodic runs: maximal repetitions of words, found by internal pattern matching.

A run is a stretch of words with smallest period q, at least two periods (and
``least`` words) long, that no neighbouring word extends. The words of a slice of
texts become one sequence of numbers with a separator of its own after each text.

1. Prefix doubling ranks all factors whose lengths are powers of two, and gives the
   suffix array. Equal factors have equal ranks, so the longest common extension of
   two places, forwards or backwards, takes one comparison a power.
2. A run of period p in [2b, 4b) holds an aligned block of b words (a dyadic block)
   that occurs again p words later. The block's occurrences are one interval of the
   suffix array; those in the window [2b, 4b) behind the block come one by one from
   range-successor queries of a wavelet matrix over that interval.
3. Two occurrences at most b/2 apart start an arithmetic progression, whose end an
   extension gives; it is passed in one step. A progression in the repetition the
   block itself lies in gives no period; of one in another repetition, those members
   are candidates that align both ends, both starts, or reach across the gap.
4. Each candidate is extended both ways. What is long enough is a repetition; of equal
   stretches the smallest period counts.

All steps run over arrays of a slice; memory is some 150 bytes a word of the slice, or
of the longest text. All comparisons are of words, none of hashes.

Defined cases: a null or blank text has no words and no runs; rows are treated one by
one, so repeated rows and null ids need no care; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keepsake.llm.common import id_text, slices

LEAST = 12
FOUND = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Factors:
    """Ranks of all factors of a power of two words: the number of smaller factors of that length.

    ``ids`` ends with a separator that occurs once, as does the one after each text; so a
    factor that occurs twice lies inside its texts.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        self.ranks = [self._first_places(order, ids[order], np.zeros(n, np.int64))]
        self.sizes = [np.bincount(self.ranks[0], minlength=n).astype(np.int32)]
        while True:
            rank, width = self.ranks[-1], 1 << len(self.ranks) - 1
            open_ = np.flatnonzero(self.sizes[-1][rank] > 1)
            if not len(open_):
                break
            # Only factors that occur twice are ordered on, inside the places of their rank.
            own = rank[open_].astype(np.int64)
            key = own * n + rank[open_ + width]
            order = np.argsort(key)
            own, key = own[order], key[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            base = own - np.repeat(first, np.diff(np.append(first, len(own))))
            ranks = rank.copy()
            ranks[open_] = self._first_places(order, key, base)
            self.ranks.append(ranks)
            self.sizes.append(np.bincount(ranks, minlength=n).astype(np.int32))
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[self.ranks[-1]] = np.arange(n)

    @staticmethod
    def _first_places(order: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
        """For each sorted entry the place of the first one with its key, in the order of the entries."""
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        out = np.empty(len(key), np.int32)
        out[order] = base + np.repeat(first, np.diff(np.append(first, len(key))))
        return out

    def forwards(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that follow alike from two different places each."""
        x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][x] == self.ranks[k][y]).astype(np.int64) << k
            x += step
            y += step
            out += step
        return out

    def backwards(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words alike before two different places each."""
        x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = x - (1 << k), y - (1 << k)
            inside = (a >= 0) & (b >= 0)
            step = (inside & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])).astype(np.int64) << k
            x -= step
            y -= step
            out += step
        return out


class WaveletMatrix:
    """Values below a power of two in a fixed order; bits are packed, with a count before each 64."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            flags = (values >> bit & 1).astype(bool)
            packed = np.packbits(flags, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            before = np.concatenate([[0], counts[:-1]])
            self.levels.append((words, before, self.n - int(counts[-1])))
            values = np.concatenate([values[~flags], values[flags]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        words, before, _ = level
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & mask)

    def successors(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``least`` (below the power of two) at places low..high, or -1."""
        smaller = np.zeros(len(low), np.int64)
        a, b = low, high
        for k, level in enumerate(self.levels):
            one = (least >> (self.bits - 1 - k) & 1).astype(bool)
            ones_a, ones_b = self._ones(level, a), self._ones(level, b)
            smaller += np.where(one, (b - ones_b) - (a - ones_a), 0)
            a = np.where(one, level[2] + ones_a, a - ones_a)
            b = np.where(one, level[2] + ones_b, b - ones_b)
        out = np.full(len(low), -1, np.int64)
        there = np.flatnonzero(smaller < high - low)
        a, b, k_th, value = low[there], high[there], smaller[there], np.zeros(len(there), np.int64)
        for level in self.levels:
            ones_a, ones_b = self._ones(level, a), self._ones(level, b)
            zeros = (b - ones_b) - (a - ones_a)
            one = k_th >= zeros
            k_th = np.where(one, k_th - zeros, k_th)
            a = np.where(one, level[2] + ones_a, a - ones_a)
            b = np.where(one, level[2] + ones_b, b - ones_b)
            value = value << 1 | one
        out[there] = value
        return out


def _candidates(factors: Factors, index: WaveletMatrix, k: int, least_period: int, past_period: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of 2**k words and candidate periods of runs around them, in [least_period, past_period)."""
    n, width = index.n, 1 << k
    block = np.arange(0, n, width)
    low = factors.ranks[k][block].astype(np.int64)
    size = factors.sizes[k][low]
    use = (size > 1) & (block + least_period < n)
    block, low = block[use], low[use]
    high = low + size[use]
    at = block + least_period
    before = np.full(len(block), -n, np.int64)
    found = []
    while len(block):
        place = index.successors(low, high, at)
        use = (place >= 0) & (place < block + past_period)
        block, low, high, before, place = block[use], low[use], high[use], before[use], place[use]
        found.append((block, place - block))
        near = np.flatnonzero(2 * (place - before) <= width)
        last = place.copy()
        if len(near):
            step = place[near] - before[near]
            end = before[near] + step + factors.forwards(before[near], place[near])
            last[near] = before[near] + (end - width - before[near]) // step * step
            found.append(_of_progressions(factors, block[near], before[near], step, last[near], end, past_period))
        at, before = last + 1, last
        inside = at < n
        block, low, high, at, before = block[inside], low[inside], high[inside], at[inside], before[inside]
    if not found:
        return block, block
    return np.concatenate([b for b, _ in found]), np.concatenate([p for _, p in found])


def _of_progressions(factors, block, first, step, last, end, past_period) -> tuple[np.ndarray, np.ndarray]:
    """Members of the progressions first, first + step .. last that can be a period away from their block."""
    own_end = block + step + factors.forwards(block, block + step)
    own_start = block - factors.backwards(block, block + step)
    start = first - factors.backwards(first, first + step)
    use = own_start != start
    block, first, step, last, end, own_end, own_start, start = (x[use] for x in (block, first, step, last, end, own_end, own_start, start))
    many = (np.minimum(last, block + past_period - 1) - first) // step + 1
    row = np.repeat(np.arange(len(many)), many)
    member = first[row] + step[row] * (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
    period = member - block[row]
    across = np.minimum(own_end[row], end[row] - period) - np.maximum(own_start[row], start[row] - period) >= period
    use = across | (period == (end - own_end)[row]) | (period == (start - own_start)[row])
    return block[row][use], period[use]


def runs_of(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of ``ids`` (whose last is a separator), by start, then period."""
    none = (np.zeros(0, np.int64),) * 3
    if len(ids) < 3:
        return none
    factors = Factors(ids)
    if len(factors.ranks) == 1:
        return none
    index = WaveletMatrix(factors.suffixes)
    found = []
    # Short periods share one level; its blocks fit into what a run has beyond its last period.
    base = 1 if least >= 5 else 0
    levels = [(base, 1, 8)] + [(k, 2 << k, 4 << k) for k in range(2, len(factors.ranks))]
    for k, least_period, past_period in levels:
        if k >= len(factors.ranks):
            break
        block, period = _candidates(factors, index, k, least_period, past_period)
        start = block - factors.backwards(block, block + period)
        end = block + period + factors.forwards(block, block + period)
        use = end - start >= np.maximum(least, 2 * period)
        found.append(np.stack([start[use], end[use], period[use]]))
    every = np.concatenate(found, axis=1)
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    first = np.append(True, (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1])) if every.shape[1] else np.zeros(0, bool)
    every = every[:, first]
    return tuple(every[:, np.lexsort((every[2], every[0]))])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _described(texts: list[str | None], least: int) -> tuple[list[int], pa.Array, list[str]]:
    """Number of words, runs and collapsed text of each text."""
    own = [(t or "").encode().split() for t in texts]
    counts = np.array([len(w) for w in own], np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    numbers = _Numbers()
    ids = np.empty(offsets[-1], np.int64)
    for at, w in zip(offsets.tolist(), own):
        ids[at : at + len(w)] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
    ids[offsets[1:] - 1] = len(numbers) + np.arange(len(own))
    start, end, period = runs_of(ids, least)
    row = np.searchsorted(offsets, start, "right") - 1
    change = np.bincount(start + period, minlength=len(ids) + 1) - np.bincount(end, minlength=len(ids) + 1)
    keep = np.cumsum(change) == 0
    many = np.bincount(row, minlength=len(own))
    fields = [pa.array(x) for x in (start - offsets[row], end - start, period)]
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(RUN)))
    collapsed = [b" ".join(compress(w, keep[at : at + len(w)].tolist()) if m else w).decode() for at, w, m in zip(offsets.tolist(), own, many.tolist())]
    return counts, listed, collapsed


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; words are counted from 0) and ``collapsed`` of every row.

    Of each run only the first period stays in ``collapsed``, the words joined by one space.
    """

    def run(batches):
        for batch in slices(batches):
            counts, runs, collapsed = _described(batch.column(1).to_pylist(), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), runs, pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs, doc_id, text).mapInArrow(run, FOUND)
