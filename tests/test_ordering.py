import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ordering


def skewed(n, seed):
    """Scores with one hot value, a crowd near zero and some outside [0, 1]."""
    rng = random.Random(seed)
    return [rng.choice([0.5, rng.random(), rng.random() * 1e-6, -rng.random(), 1 + rng.random(), 0.0, 1.0]) for _ in range(n)]


@pytest.mark.parametrize("depth", [1, 2])
def test_running_sums(spark, depth):
    rows = {}
    for key in ("a", "b"):
        for v in skewed(300, key):
            rows[(key, v)] = rows.get((key, v), 0) + 1
    df = spark.createDataFrame([(k, v, c) for (k, v), c in rows.items()], "k string, v double, c long")
    out = ordering.running_sums(df, ["k"], ordering.score_levels(F.col("v"), depth), ["v"], ["c"]).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["cum_c"] == sum(c for (k, v), c in rows.items() if k == r["k"] and v <= r["v"])
        assert r["all_c"] == 300


def test_levels_never_fall(spark):
    values = sorted(skewed(2000, 1) + [5e-324, 1 - 1e-16, 1e-300])
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumns(ordering.score_levels(F.col("v"), 2))
    got = [(r["lv1"], r["lv2"]) for r in df.orderBy("v").collect()]
    assert got == sorted(got)


def test_nth_rows_with_weights(spark):
    rng = random.Random(5)
    rows = {v: rng.randint(1, 4) for v in set(skewed(200, 9))}
    df = spark.createDataFrame(list(rows.items()), "v double, w long")
    flat = sorted(v for v, w in rows.items() for _ in range(w))
    ranks = {"first": lambda n: F.lit(1), "mid": lambda n: F.ceil(n / 2), "last": lambda n: n, "none": lambda n: n + 1}
    out = ordering.nth_rows(df, [], ordering.score_levels(F.col("v")), ["v"], ranks, weight="w").collect()
    assert {r["rank_name"]: r["v"] for r in out} == {
        "first": flat[0], "mid": flat[-(-len(flat) // 2) - 1], "last": flat[-1],
    }


@pytest.mark.parametrize("k", [1, 7, 50, 1000])
def test_first_k(spark, k):
    rng = random.Random(k)
    words = {"".join(rng.choice("abcé ") for _ in range(rng.randint(1, 8))) for _ in range(300)}
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = {r["t"] for r in ordering.first_k(df, ordering.text_levels(F.col("t")), ["t"], k).collect()}
    assert got == set(sorted(words, key=lambda w: w.encode())[:k])


def test_exact_quantiles(spark):
    cols = {"a": [1.0, 2.0, 3.0, 4.0], "b": [7.0] * 4, "c": [0.0, 0.0, 1e9, 5.5]}
    df = spark.createDataFrame(list(zip(*cols.values())), "a double, b double, c double")
    out = {(r["name"], r["share"]): r["quantile"] for r in ordering.exact_quantiles(df, list(cols), [0.0, 0.25, 0.5, 1.0]).collect()}
    assert len(out) == 12
    for (name, share), got in out.items():
        assert got == pytest.approx(np.quantile(cols[name], share))
    assert out[("a", 0.25)] == 1.75
