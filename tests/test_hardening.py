"""Repeated writes, stratified folds, crowded scores, refused tables."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import evaluate, ordering, vectors
from cohortlens.plans import search
from cohortlens.sources import tables


def test_repeated_write_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "preds")
    base = spark.range(50).select(
        F.lit("ia").alias("task"), F.lit("lr").alias("model"), F.lit(1).alias("run"), F.col("id").alias("row_id"),
        F.lit(1).alias("target"), (F.col("id") / 50.0).alias("prob"), F.lit(1).alias("pred"),
    )
    other = base.withColumn("model", F.lit("rf"))
    for df in (base, other, base):
        tables.sink_predictions(df, path)
    got = {r.model: r.n for r in tables.scan_predictions(spark, path).groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert got == {"lr": 50, "rf": 50}


def test_folds_are_stratified(spark):
    rows = spark.range(103).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    counts = search.with_folds(rows, 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_scores_that_crowd_are_spread(spark):
    rows = spark.range(20_000).select((0.4999 + F.col("id") / 20_000 * 0.0002).alias("p"))
    levels = ordering.score_levels(F.col("p"))
    largest = rows.withColumns(levels).groupBy(*levels).count().agg(F.max("count")).first()[0]
    assert largest <= 20_000 * 0.1


def test_area_with_one_heavy_score(spark):
    rows = spark.range(1000).select(
        F.lit("ia").alias("task"), F.lit("lr").alias("model"), F.lit(1).alias("run"),
        F.when(F.col("id") % 10 == 0, F.col("id") / 1000.0).otherwise(0.5).alias("prob"), (F.col("id") % 3 == 0).cast("int").alias("target"),
        F.col("id").alias("row_id"),
    )
    data = [(r.prob, r.target) for r in rows.collect()]
    pos, neg = [p for p, t in data if t], [p for p, t in data if not t]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = evaluate.auroc(rows).first()["auroc"]
    assert got == pytest.approx(want)


def test_duplicate_tokens_are_refused(spark):
    table = spark.createDataFrame([(0, "a", [1.0]), (1, "a", [2.0])], "idx long, token string, vec array<double>")
    with pytest.raises(Exception, match="occurs twice"):
        vectors.unique_tokens(table).collect()
