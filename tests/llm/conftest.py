"""Small tables for the corpus operators."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, rate string, _key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) rows, with extra columns whose names operators use for their results."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), "mine", "mine", "mine", None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    """Sentences of invented words, the same for the same seed."""

    def make(seed, n, letters="abcdefghij"):
        rng = random.Random(str(seed))
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def hard_rows(words):
    """Nulls, empty and blank texts, ties, repeated rows and a very long text."""
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, words(4, 30)),
        (4, words(4, 30)),
        (5, words(4, 30)),
        (None, words(6, 30)),
        (None, None),
        (7, words(7, 60_000)),
        (8, "one"),
    ]
