import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import splits
from cohortlens.operators.reshape import shared_groups
from cohortlens.plans.training import held_out, seed_cuts


def rows(spark, groups):
    return spark.createDataFrame([(i, i % groups) for i in range(groups * 3)], "row_id long, g long")


def members(df, name="test"):
    return {r["g"] for r in df.filter(F.col("split") == name).collect()}


def test_share_is_of_groups_and_rounds_up(spark):
    df = splits.split_group(rows(spark, 100), "g", 0.15, seed=3)
    assert len(members(df)) == 15
    assert members(df).isdisjoint(members(df, "train"))
    assert shared_groups(df, "g", "train", "test").first()["n_shared"] == 0
    assert df.count() == 300


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=st.integers(1, 60), seed=st.integers(0, 10**6), share=st.sampled_from([0.05, 0.15, 0.5, 1.0]))
def test_split_properties(spark, groups, seed, share):
    df = rows(spark, groups)
    got = members(splits.split_group(df, "g", share, seed=seed))
    assert len(got) == math.ceil(share * groups)
    assert got == members(splits.split_group(df.repartition(7, "row_id"), "g", share, seed=seed))
    assert got <= members(splits.split_group(df, "g", min(1.0, share * 2), seed=seed))


def test_three_way_split(spark):
    df = splits.split_group_three(rows(spark, 100), "g", 0.2, 0.2, seed=1)
    sizes = {name: len(members(df, name)) for name in ("train", "val", "test")}
    assert sizes == {"train": 60, "val": 20, "test": 20}
    checks = splits.split_check(df, {"train": 0.6, "val": 0.2, "test": 0.2}, "g").collect()
    assert all(r["passed"] for r in checks) and len(checks) == 4
    assert not all(r["passed"] for r in splits.split_check(df, {"train": 0.2, "val": 0.2, "test": 0.6}).collect())
    assert splits.split_group_three(rows(spark, 10), "g", 0.3, 0.0, seed=1).filter("split = 'test'").count() == 0


def test_sample_flag_lies_in_train(spark):
    df = splits.split_three_sample(rows(spark, 100), 0.1, 0.1, 0.25, seed=2)
    assert df.filter("is_sample").count() == 60
    assert df.filter("is_sample and split <> 'train'").count() == 0


def test_seed_loop_matches_single_splits(spark):
    df = rows(spark, 40)
    many = splits.split_many_seeds(df, "g", [1, 2, 3]).collect()
    cuts = seed_cuts(df, "g", [1, 2, 3])
    for seed in (1, 2, 3):
        one = members(splits.split_group(df, "g", seed=seed))
        assert {r["g"] for r in many if r["seed"] == seed and r["split"] == "test"} == one
        assert {r["g"] for r in df.filter(held_out("g", seed, cuts[seed])).collect()} == one
    assert splits.split_bool(df, seed=1).filter("is_valid").count() == 18


def test_stratified_holdout(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "row_id long, label int")
    got = splits.stratified_holdout(df, "label", 0.15, 5).filter("is_valid").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 27, 1: 3}


def test_prevalence_over_seeds(spark):
    df = rows(spark, 30).withColumn("label", (F.col("g") % 2).cast("int"))
    by_seed = {r["seed"]: r["prevalence"] for r in splits.prevalence_by_seed(df, "g", "label", [1, 2]).collect()}
    for seed, got in by_seed.items():
        test = splits.split_group(df, "g", seed=seed).filter("split = 'test'")
        assert got == pytest.approx(test.agg(F.avg("label")).first()[0])
