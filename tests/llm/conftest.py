import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plain import WORDS, edited, sentence  # noqa: E402


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): originals, copies, near copies, shared passages, odd and empty texts."""
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "One two three", "one two three", "ünder œuvre ñandú élan ßtraße", "x" * 5000]
    passage = sentence(rng, 60)
    base = [sentence(rng, rng.randint(30, 200)) for _ in range(25)]
    for text in base:
        texts += [text, text, edited(rng, text, 0.01), edited(rng, text, 0.02), edited(rng, text, 0.2)]
    hot = sentence(rng, 120)
    texts += [edited(rng, hot, 0.01) for _ in range(60)] + [hot] * 10
    texts += [sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 40) for _ in range(30)]
    texts += [sentence(rng, 6000) + "\n" + passage]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "xx", f"s{i % 3}", None if t is None else len(t)) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and columns whose names the operators use inside."""
    long = " ".join(WORDS)
    rows = [(None, long, 1, 2, "a"), (7, long, 3, 4, "b"), (7, long, 3, 4, "b"), (8, None, 5, 6, "c"), (8, "", 5, 6, "d"), (9, long + " extra", 1, 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words bigint, class bigint, row string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
