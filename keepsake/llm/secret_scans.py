"""Secret scans: known forms by pattern, random strings by their token efficiency.

Known forms are three patterns. Beyond them, a long unbroken run of key
characters is suspected: a byte-pair vocabulary spends many tokens on a random
string, so few characters per token expose it. Digests, UUIDs and identifiers
made of words are excluded, as are runs that meet a known form.

One pass over the texts without a shuffle. A text is searched only if a plain
substring or word-length test allows a match; those tests lose nothing, since
each pattern needs the tested substring or a word of that length.

Defined cases: a null text is empty and has no span; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored. Places
are code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from keepsake.llm.common import id_text, kept_in_worker, slices

# The known forms, least lengths and kinds in reporting order.
ASSIGN = rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

# Random runs: least length, and fewer characters per token than this.
LEAST_RUN = 16
CHARS_PER_TOKEN = 2.0
RUN = rb"[A-Za-z0-9+/_=-]{%d,}"
DIGEST = rb"[0-9a-fA-F]+"
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
# Words, numbers or camel-case words between separators. No part gives back what it
# took, so a run is read once: capitals belong together, as do the letters after them.
BLOCK = rb"(?:(?:[a-z]++|[0-9]++)(?:[A-Z]++[a-z]*+)*+|(?:[A-Z]++[a-z]*+)++)"
IDENTIFIER = BLOCK + rb"(?:[_/=+-]++" + BLOCK + rb")*+[_/=+-]*+"

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"


def tiktoken_encoding(path: str):
    """A tiktoken encoding from a file of ranks; its own name keeps it apart from any other."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Scanner:
    """Finds the spans of one text; ``encoding`` gives the tokens of a run.

    Runs of fewer than ``least_run`` characters are not judged, nor are those without a
    letter unless ``digits_too``: long numbers cost many tokens as well.
    """

    def __init__(self, encoding, chars_per_token: float = CHARS_PER_TOKEN, least_run: int = LEAST_RUN, digits_too: bool = False):
        self.encoding, self.chars_per_token, self.least_run, self.digits_too = encoding, chars_per_token, least_run, digits_too
        self.assign, self.access, self.hex = (re.compile(p) for p in (ASSIGN, ACCESS, HEX))
        self.run, self.digest, self.uuid, self.identifier = (re.compile(p) for p in (RUN % least_run, DIGEST, UUID, IDENTIFIER))

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, kind, end) in code points, ascending."""
        found = []
        lower = text.lower()
        if any(k in lower for k in KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
        if b"AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        if any(len(w) >= min(self.least_run, LEAST_HEX) for w in text.split()):
            found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text) if m.end() - m.start() >= LEAST_HEX]
            known = _Known(found)
            found += [(m.start(), 3, m.end()) for m in self.run.finditer(text) if not known.meet(m.start(), m.end()) and self.is_random(m.group())]
        return self._in_code_points(text, sorted(found))

    def is_random(self, run: bytes) -> bool:
        if self.uuid.fullmatch(run) or (self.digest.fullmatch(run) and len(run) in DIGEST_LENGTHS):
            return False
        if not self.digits_too and not re.search(rb"[A-Za-z]", run):
            return False
        if self.identifier.fullmatch(run) and len(re.findall(rb"[A-Za-z]{4,}", run)) * 12 >= len(run):
            return False
        return len(run) < self.chars_per_token * len(self.encoding.encode_ordinary(run.decode("ascii")))

    @staticmethod
    def _in_code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if not found or text.isascii():
            return found
        places, at, chars = {}, 0, 0
        for place in sorted({p for s, _, e in found for p in (s, e)}):
            chars += len(text[at:place].decode("utf-8"))
            places[place], at = chars, place
        return [(places[s], k, places[e]) for s, k, e in found]


class _Known:
    """Spans in order of their starts, and how far those up to each one reach."""

    def __init__(self, found: list[tuple[int, int, int]]):
        spans = sorted((s, e) for s, _, e in found)
        self.starts, self.reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def meet(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    chars_per_token: float = CHARS_PER_TOKEN,
    least_run: int = LEAST_RUN,
    digits_too: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: counts by kind, the digest of the known spans, and all spans.

    ``vocabulary`` is the path of a tiktoken rank file, the same on all machines.
    """

    def run(batches):
        scanner = Scanner(kept_in_worker(f"ranks {vocabulary}", lambda: tiktoken_encoding(vocabulary)), chars_per_token, least_run, digits_too)
        for batch in slices(batches):
            rows = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                spans = scanner.spans(t or b"")
                base = _joined(x for x in spans if x[1] < 3)
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return id_text(docs, doc_id, text).mapInArrow(run, SCHEMA)
