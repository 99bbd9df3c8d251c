import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, taken int, `key` string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators use themselves."""

    def make(texts, ids=None, langs=None, sources=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], None if t is None else len(t), k, "x") for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    def make(seed, n, vocabulary=200):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return make


#: Null, empty, blank, one word, equal texts, a long one.
ODD = [None, "", " \n\t", "one", "Same text here", "same TEXT here", "Same text here", "ß é 腾讯   x", "long " * 20_000]


@pytest.fixture
def odd():
    return list(ODD)
