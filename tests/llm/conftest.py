import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # Names that operators use themselves.
        T.StructField("row", T.StringType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("size", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("class", T.StringType()),
    ]
)


def edge_rows():
    """Nulls, blank and very long texts, repeated rows, near copies, ties."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[7], near[60] = "changed", "words"
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One  TWO\tthree"), (5, "one two three"),
        (6, base), (7, base), (8, " ".join(near)), (9, base.upper()), (None, base), (None, None),
        (10, prose(30_000)), (11, "same line here\n" * 40), (12, "é ñ ß 中文 😀 " + prose(60)),
        (13, "x" * 200_000), (14, "### $$$ " * 60), (15, prose(50)), (15, prose(50)), (16, prose(40) + "\n" + prose(40)),
        (17, "<|endoftext|> the 's it's\r\n\r\n"), (18, "..." + prose(25)),
    ]
    texts += [(20, base)] * 3
    texts += [(100 + i, prose(r.randint(1, 80))) for i in range(60)]
    out = []
    for i, (doc, text) in enumerate(texts):
        out.append((doc, text, ["en", "de", None][i % 3], ["a", "b", None, "Z"][i % 4], "r", i, "s", None, "k", "c"))
    return out


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
