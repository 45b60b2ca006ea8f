"""Small tables that hold every awkward case, shared by the tests of this folder."""

import random

import pytest
from pyspark.sql import types as T

NAMES = ["doc_id", "text", "lang", "source", "kept", "row", "carried", "size", "path", "key"]
DOCS = T.StructType([
    T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in NAMES
])


def passage(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghiklmnoprstu") for _ in range(draw.randint(2, 8))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows; the other columns have names operators use inside."""
    shared, long_ = passage(1, 60), passage(2, 30_000)
    words = shared.split()
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (5, shared), (5, shared), (6, shared.upper()),
        (7, shared + " " + passage(3, 5)), (8, " ".join([*words[:30], "changed", *words[31:]])),
        (9, passage(4, 40) + "\n" + shared + "\n" + passage(5, 40)), (10, long_), (11, long_ + " end"),
        (12, "12345 %%% ###"), (13, "été à Noël, 你好 世界 \u0085 x y <|endoftext|>"), (None, shared), (None, None), (14, None),
        (15, passage(6, 25)), (16, passage(6, 25)), (17, "the same line of several words\nthe same line of several word\n\nthe same line of several words"),
        (18, "mail a.b@mail.example.com or A.B@mail.example.com"), (19, shared + " " + shared),
    ]
    sources = [None, "a", "b", "", "a", "a", "é", "b", "b", None]
    langs = ["en", None, "fr"]
    return [
        (i, t, langs[n % 3], sources[n % len(sources)], "x", "y", "z", "s", "p", "k") for n, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def documents(rows: list[tuple]) -> list[tuple]:
    """(doc_id, text) of rows of the awkward table."""
    return [(r[0], r[1]) for r in rows]
