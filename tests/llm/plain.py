"""Plain versions and small texts for the tests of this folder."""

import re

WORDS = [a + b for a in "ba ce di fo gu la me ni po ru".split() for b in "ra te li mo nu sa ve ki".split()]
SHINGLES = 5


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    """Brute-force shingle set of a text, A-Z lower-cased."""
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + SHINGLES]) for i in range(max(1, len(w) - SHINGLES + 1))} if w else set()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, rate):
    return " ".join(rng.choice(WORDS) if rng.random() < rate else w for w in text.split(" "))
