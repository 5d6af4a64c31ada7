from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long, score double, label string, entry string"


def words(r: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; other columns have names that the operators use."""
    r = random.Random(5)
    base = " ".join(words(r, 120))
    near = base.replace(base.split()[7], "changed").replace(base.split()[60], "other")
    long = " ".join(words(r, 30_000))
    texts = [(1, base), (2, base), (2, base), (3, near), (4, ""), (5, None), (6, "  \n\t "), (7, long), (8, long + " end"), (None, base), (None, None), (9, "123 456"), (10, "one two three"), (11, "x" * 50_000), (12, "Ünïcödé 😀 日本語\u0000 <|endoftext|> <s>"), (0, near + "\n" + near)]
    out = []
    for k, (i, t) in enumerate(texts):
        out.append((i, t, [None, "en", "de"][k % 3], [None, "s0", "s1", "s0"][k % 4], None if t is None else len(t), k % 2, 0.5, None, "e"))
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (7, 1, 0), (7, 0, 1), (8, 0, 0), (10, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
