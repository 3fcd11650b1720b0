import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) + rng.choice(["", "", "", ".", ","])
                    for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, copies, repeated rows, a long text."""
    rng = random.Random(5)
    long_text = prose(rng, 6000)
    base = prose(rng, 300)
    near = base.split()
    near[5] = "changed"
    return [
        (1, base, "en", "s1", len(base)), (2, base, "en", "s1", len(base)), (3, " ".join(near), None, None, None),
        (4, None, "en", "s2", None), (5, "", "en", "s2", 0), (6, " \n\t ", "en", "s2", 4), (None, base, "en", "s1", 1),
        (None, None, None, None, None), (7, long_text, "en", "s1", len(long_text)), (8, "one", "en", "s3", 3),
        (8, "one", "en", "s3", 3), (9, "one two", "fr", "s3", 7), (9, "other text of this id", "fr", "s3", 7),
        (10, prose(rng, 400), "en", "s1", 1), (11, "Été déjà vu — “ok” x.y'z 日本語", "fr", "\U0001f600", 30),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture
def empty(spark):
    return frame(spark, [])


@pytest.fixture
def clashing(odd):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    for c in ("size", "key", "cls", "root", "shard", "bucket", "pos", "u", "w", "part", "_id", "hash", "label", "a b.c"):
        odd = odd.withColumn(c, F.lit("x"))
    return odd
