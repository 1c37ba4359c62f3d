import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside or return.
    T.StructField("row", T.StringType()), T.StructField("score", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("input_ids", T.StringType()), T.StructField("_key", T.StringType()),
])


def _rows(pairs):
    return [(i, t, None, s, None if t is None else len(t), "r", "s", "z", "k", "h", "p", "i", "x") for i, t, s in pairs]


WORDS = "the of and token = password: 4111 a@b.co Zeta eins zwei drei vier fuenf sechs sieben acht neun zehn".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", ".", "\n")) for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, repeats, ties, a long text, copies and near copies, a hot source."""
    rng = random.Random(7)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\f\r ", None), (None, "no id at all here", "b"), (None, None, None),
        (4, "one", "b"), (5, "ONE", "b"), (6, "two words", "b"), (6, "two words", "b"), (6, "other words", "c"),
        (7, "\x00nul \U0001f600 é 日本   end", "c"), (8, "</s>[INST] <|turn|> \\", "c"),
        (9, "x" * 70_000, "d"), (10, ("lorem ipsum dolor " * 9000).strip(), "d"), (11, "a\n" * 5000, "d"),
    ]
    base = _text(rng, 120)
    for i in range(40):
        words = base.split(" ")
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((100 + i, " ".join(words), "hot"))
    rows += [(200 + i, base, "hot") for i in range(30)]
    rows += [(300 + i, base.replace(" ", "  "), "hot") for i in range(5)]
    rows += [(400 + i, _text(rng, rng.randrange(1, 200)), "hot") for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(_rows(odd_rows()), SCHEMA).repartition(4).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
