"""Hot terms, tied scores, crowded values and one beginning for all terms: same results on every way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import storage
from cohortlens.operators import describe, evaluate, features, ordering


def test_heavy_terms_meet_their_weight_map_side_with_the_same_result(spark, monkeypatch):
    docs = spark.range(300).select(
        F.col("id").alias("row_id"),
        F.concat_ws(" ", F.lit("hot hot warm"), F.concat(F.lit("a"), F.col("id") % 7), F.concat(F.lit("b"), F.col("id") % 90), F.when(F.col("id") % 2 == 0, "warm")).alias("processed_note"),
    )
    weighting = features.Weighting(features.text.whitespace_tokens, binary=False)
    rows = lambda: {(r["row_id"], r["term"], r["idx"]): r["weight"] for r in features.tfidf(docs, weighting).collect()}
    whole = rows()
    monkeypatch.setattr(features, "HEAVY_TERMS", 3)
    split = features.tfidf(docs, weighting)
    assert "BroadcastHashJoin" in split._jdf.queryExecution().toString()
    assert rows() == pytest.approx(whole) and len(whole) == 300 * 4


@pytest.mark.parametrize("k", [0, 1, 40, 41, 700, 2_000])
def test_top_terms_cut_inside_a_crowd_with_one_beginning(spark, k):
    terms = [(f"acommonbeginning{i:05d}", 3 if i < 40 else 1) for i in range(1_500)]
    df = spark.createDataFrame(terms, "term string, df long").repartition(4)
    got = {r["term"] for r in features.top_terms(df, k).collect()}
    assert got == {t for t, _ in sorted(terms, key=lambda t: (-t[1], t[0]))[:k]}


def test_positions_follow_the_order_over_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([(f"same{'é' if i % 3 else 'z'}{(i * 7919) % 5_000:05d}",) for i in range(5_000)], "term string").repartition(6)
        got = features.with_index(df).collect()
        parts = df.repartitionByRange("term").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = sorted((r["term"] for r in got), key=lambda t: t.encode())
    assert [r["term"] for r in sorted(got, key=lambda r: r["idx"])] == want
    assert sorted(r["idx"] for r in got) == list(range(5_000))
    sizes = sorted(r["count"] for r in parts)
    assert len(sizes) > 1 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert features.with_index(df.limit(0)).collect() == []


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_ranks_where_most_rows_tie(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(evaluate, "HEAVY_TIE", 50)
    scores = [0.5 if i % 10 else (i % 70) / 70 for i in range(1_000)]
    preds = spark.createDataFrame([("ia", "lr", 1, i, i % 2, p) for i, p in enumerate(scores)], "task string, model string, run int, row_id long, target int, prob double")
    got = {r["row_id"]: r["avg_rank"] for r in evaluate.rank_rows(preds).collect()}
    x = np.array(scores)
    assert got == {i: (x < p).sum() + ((x == p).sum() + 1) / 2 for i, p in enumerate(scores)}


def test_quantiles_of_crowds_and_far_values(spark):
    rng = np.random.default_rng(2)
    a = np.concatenate([np.full(700, 2.5), rng.normal(0, 1e-6, 200), [-1e300, 1e300], rng.normal(0, 50, 98)])
    df = spark.createDataFrame([(float(v), None if i % 4 else float(i)) for i, v in enumerate(a)], "a double, b double").repartition(3)
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    got = {(r["name"], r["share"]): r["quantile"] for r in ordering.exact_quantiles(df, ["a", "b"], shares).collect()}
    for q in shares:
        assert got["a", q] == pytest.approx(np.quantile(a, q), rel=1e-12)
        assert got["b", q] == pytest.approx(np.quantile(np.arange(0, 1000, 4), q))


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_histograms_by_group_with_and_without_broadcast(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", broadcast_rows)
    df = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("k"), (F.col("id") % 20).alias("v"))
    got = {(r["k"], r["bin"]): r["n"] for r in describe.grouped_histogram(df, "k", "v", 4).collect()}
    assert {b: n for (k, b), n in got.items() if k == "hot"} == {0: 100, 1: 100, 2: 100, 3: 100}
    assert sum(got.values()) == 500
