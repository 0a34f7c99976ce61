import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with extra columns of clashing names."""

    def build(rows, lang="en"):
        data = [(i, t, lang, "s", None, 1, "x", True) for i, t in rows]
        return spark.createDataFrame(data, SCHEMA + ", full int, key string, kept boolean")

    return build


@pytest.fixture(scope="session")
def prose():
    """A maker of invented texts of ``n`` words."""

    def build(n, seed):
        r = random.Random(seed)
        parts = ["an", "er", "the", "on", "tion", "re", "ed", "in", "st", "ou", "ing", "ly"]
        return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))

    return build
