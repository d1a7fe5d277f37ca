import random

import pytest

STRANGE = [
    (None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three four"), (5, "one two three four"),
    (6, "café ñandú ÉCOLE 日本 𝔘nicode ▁mark"), (7, "word " * 6000), (8, "x" * 30000), (None, "one two three four five six"),
    (9, "one two three four five six"), (10, "!!! ... ???"),
]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def strange(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns that clash with results."""
    rows = [(i, t, "lang" if k % 2 else None, None, "s") for k, (i, t) in enumerate(STRANGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, key string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score double, key string")
