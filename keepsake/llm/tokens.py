"""Token ids of whole texts by a tokenizers file, with a cache of words.

Byte-pair merges never cross the border between a word and the white space
before it, so a text's ids are its words' ids in order, and a word needs the
tokenizer once per worker. Words are cut at single spaces and line ends only;
a text where that cut is not exact (white space of other kinds or in runs, for
a vocabulary that keeps white space) is given to the tokenizer whole.
"""

from __future__ import annotations

import re

import numpy as np

# Beyond so many words (some 200 bytes each), and beyond fewer at the end of a task, when the
# worker may wait, the cache keeps its most frequent words only; that costs time, never results.
CACHE_WORDS = 400_000
KEPT_WORDS = 200_000
# Words that aren't plain letters go to the tokenizer joined, so many at a time.
JOIN = 512
# Letters that are the same in all normal forms and in lower case one letter again, and a closing mark.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([,.]?)")
# A line end, as a word; the first word of a line has a line end before it.
LINE_END = "\n\n"


class _Cache(dict):
    """Word -> its place in the store; a missing word gets the next number and waits for its ids."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self.waiting.append(word)
        self[word] = place = len(self)
        return place


def _room(array: np.ndarray, least: int) -> np.ndarray:
    """The array, longer by half or more if it has fewer than ``least`` places; new ones are 0."""
    return array if least <= len(array) else np.concatenate([array, np.zeros(max(least - len(array), len(array) // 2), array.dtype)])


class WordTokenizer:
    """``encode`` gives the ids of texts as the tokenizer itself would, without special tokens."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        # Either white space is dropped, or it stays with the word that follows.
        self.drops_space = kind["model"].get("end_of_word_suffix") is not None
        # How the vocabulary shows bytes: printable ones as they are, the others from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.shown = {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}
        self.closing = {c: self._plain("a" + c)[1:] for c in ",."}
        if self.drops_space:
            self.mark = self._plain("~")
        else:
            vocabulary = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.cache = _Cache()
        self.ids = np.zeros(1 << 18, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.seen = np.zeros(1 << 16, np.int64)
        self.used = self.words = 0

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keep(self, most: int) -> None:
        """Forget all but the ``most`` words seen most often; those seen once go too, and earlier counts weigh half."""
        seen = self.seen[: self.words]
        kept = np.flatnonzero(seen > 1)
        if len(kept) > most:
            kept = np.sort(kept[np.argpartition(-seen[kept], most)[:most]])
        lengths, ends, ids = self._ids_of(kept)
        # The cache's words are in the order of their places.
        words = list(self.cache)
        self.cache = _Cache()
        self.cache.update(zip(map(words.__getitem__, kept.tolist()), range(len(kept))))
        self.used, self.words = len(ids), len(kept)
        # Only as large as needed: a worker that waits holds no more.
        self.starts, self.lengths, self.seen = ends - np.maximum(lengths, 0), lengths, seen[kept] >> 1
        self.ids = ids

    def _ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of the words at ``places`` (-1 for one that makes its text go whole), the ends of their ids, and all ids."""
        lengths = self.lengths[places]
        held = np.maximum(lengths, 0).astype(np.int64)
        ends = np.cumsum(held)
        return lengths, ends, self.ids[np.repeat(self.starts[places] - (ends - held), held) + np.arange(ends[-1] if len(ends) else 0)]

    def rest(self) -> None:
        """At the end of a task: keep a small cache only."""
        if len(self.cache) > KEPT_WORDS:
            self._keep(KEPT_WORDS)

    def _store(self, many: list[list[int]]) -> None:
        """Ids of the waiting words in order; None for a word that makes its text go whole."""
        lengths = np.array([-1 if x is None else len(x) for x in many], np.int32)
        flat = np.array([i for x in many if x for i in x], np.uint32)
        self.ids = _room(self.ids, self.used + len(flat))
        self.lengths, self.starts, self.seen = (_room(x, self.words + len(many)) for x in (self.lengths, self.starts, self.seen))
        held = np.maximum(lengths, 0)
        self.ids[self.used : self.used + len(flat)] = flat
        self.lengths[self.words : self.words + len(many)] = lengths
        self.starts[self.words : self.words + len(many)] = self.used + np.cumsum(held) - held
        self.used += len(flat)
        self.words += len(many)

    def _tokenize(self, words: list[str]) -> list[list[int] | None]:
        """Ids of waiting words in their order."""
        out: list = [None] * len(words)
        rest = []
        match, tokenize, cache, drops, closing = PLAIN.fullmatch, self.model.tokenize, self.cache, self.drops_space, self.closing
        for k, word in enumerate(words):
            opens = word[:1] == "\n"
            bare = word[1:] if opens else word
            if word == LINE_END:
                out[k] = [] if drops else self._plain("\n")
                continue
            if not bare:
                out[k] = [] if drops else None
                continue
            found = match(bare)
            if found:
                # A word with a closing mark is the word and the mark.
                letters, mark = found.groups()
                shown = letters.lower() if drops else letters
                if not shown.isascii():
                    shown = shown.encode().decode("latin-1").translate(self.shown)
                if not drops and not opens:
                    shown = "Ġ" + shown
                known = cache.get(word[:-1], self.words) if mark else self.words
                if known < self.words:
                    at = self.starts[known]
                    ids = self.ids[at : at + self.lengths[known]].tolist()
                else:
                    ids = [t.id for t in tokenize(shown)]
                out[k] = ids + closing[mark] if mark else ids
            elif not drops and (bare[0].isspace() or bare[-1].isspace()):
                out[k] = None
            else:
                rest.append(k)
        texts = [words[k] if drops else words[k][1:] if words[k][0] == "\n" else " " + words[k] for k in rest]
        for i in range(0, len(rest), JOIN):
            for k, ids in zip(rest[i : i + JOIN], self._joined(texts[i : i + JOIN])):
                out[k] = ids
        return out

    def _joined(self, words: list[str]) -> list[list[int]]:
        if self.drops_space:
            simple = not any("~" in w for w in words)
            if simple:
                ids = np.array(self._plain(" ~ ".join(words)), np.int64)
                cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else np.zeros(0)
                if len(cuts) == len(words) - 1:
                    return [x[1:].tolist() if i else x.tolist() for i, x in enumerate(np.split(ids, cuts))]
        elif all(w[0] == " " and not any(c.isspace() for c in w[1:]) for w in words):
            ids = np.array(self._plain("".join(words)), np.int64)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(words):
                return [x.tolist() for x in np.split(ids, cuts)[1:]]
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and their number in each text."""
        if len(self.cache) > CACHE_WORDS:
            self._keep(KEPT_WORDS)
        places, counts = [], []
        getitem = self.cache.__getitem__
        for text in texts:
            before = len(places)
            if not text:
                pass
            elif self.drops_space:
                places += map(getitem, text.replace("\n", " ").split(" "))
            else:
                for n, line in enumerate(text.split("\n")):
                    if n:
                        places.append(getitem(LINE_END))
                    words = line.split(" ")
                    places.append(getitem("\n" + words[0]))
                    places += map(getitem, words[1:])
            counts.append(len(places) - before)
        if self.cache.waiting:
            self._store(self._tokenize(self.cache.waiting))
            self.cache.waiting = []
        flat = np.fromiter(places, np.int64, len(places))
        self.seen[: self.words] += np.bincount(flat, minlength=self.words)
        lengths, ends, ids = self._ids_of(flat)
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        whole = np.unique(np.searchsorted(bounds, np.flatnonzero(lengths < 0), "right") - 1) if len(flat) else flat
        many = np.diff(np.concatenate([[0], ends]).astype(np.int64)[bounds])
        return (ids, many) if not len(whole) else self._with_whole(texts, ids, many, whole)

    def _with_whole(self, texts, ids, many, whole):
        parts, ends = [], np.cumsum(many)
        known = set(whole.tolist())
        fresh = dict(zip(whole.tolist(), self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)))
        for i in range(len(texts)):
            parts.append(np.array(fresh[i].ids, np.uint32) if i in known else ids[ends[i] - many[i] : ends[i]])
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
