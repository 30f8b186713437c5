"""Deterministic train/validation/test splits by hash rank.

Groups are ordered by ``md5(seed:group)``; the first ``ceil(share * n)`` of them
form the held-out split. The group at the boundary is all a split needs, so a
split is one row per seed (a *cut*), and membership is a comparison inside a
projection: rows are neither joined with a group list nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.config import TEST_SHARE
from cohortlens.operators.ordering import hex_levels, nth_rows

Rank = Callable[[Column], Column]


def group_hash(seed: Column, group: Column) -> Column:
    return F.md5(F.concat_ws(":", seed.cast("string"), group.cast("string")))


def _share(share: float) -> Rank:
    return lambda n: F.ceil(n * F.lit(float(share)))


def _cut_levels() -> dict[str, Column]:
    return hex_levels(F.col("h"))


def split_cuts(
    groups: DataFrame, group: str, seeds: Sequence[int], ranks: Mapping[str, Rank]
) -> DataFrame:
    """Boundary group per seed and cut name: (seed, rank_name, rank, n, h, g).

    ``groups`` holds each group once. All seeds are computed in one job.
    """
    hashed = groups.select(
        F.col(group).alias("g"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    ).withColumn("h", group_hash(F.col("seed"), F.col("g")))
    return nth_rows(hashed, ["seed"], _cut_levels(), ["h", "g"], dict(ranks))


def _cut_map(cuts: DataFrame) -> DataFrame:
    """One row per seed, a struct column per cut name; a cut at rank 0 stays null."""
    return cuts.groupBy("seed").agg(
        F.map_from_entries(F.collect_list(F.struct("rank_name", F.struct("h", "g")))).alias("cuts")
    )


def _side(place: Column, cuts: Column, names: Mapping[str, str], rest: str) -> Column:
    """Name of the first cut at or above a place, else ``rest``."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for cut, name in names.items():
        out = out.when(F.coalesce(place <= F.try_element_at(cuts, F.lit(cut)), F.lit(False)), name)
    return out.otherwise(rest)


def _one_seed(
    df: DataFrame, group: str, seed: int, ranks: Mapping[str, Rank], names: Mapping[str, str], to: str
) -> DataFrame:
    groups = df.select(group).distinct()
    cuts = _cut_map(split_cuts(groups, group, [seed], ranks)).select("cuts").scalar()
    place = F.struct(group_hash(F.lit(seed), F.col(group)).alias("h"), F.col(group).alias("g"))
    return df.withColumn(to, _side(place, cuts, names, "train"))


def split_group(
    df: DataFrame, group: str, share: float = TEST_SHARE, name: str = "test", seed: int = 0
) -> DataFrame:
    """Whole groups go to ``name``; the share is one of groups, rounded up."""
    return _one_seed(df, group, seed, {"test": _share(share)}, {"test": name}, "split")


def _three_ranks(val: float, test: float) -> dict[str, Rank]:
    """Test first, then validation, both below the cut of the held-out part."""
    inner = round(test / (val + test), 2)
    held = _share(val + test)
    return {"test": lambda n: F.ceil(held(n) * F.lit(float(inner))), "val": held}


def split_group_three(df: DataFrame, group: str, val: float, test: float, seed: int = 0) -> DataFrame:
    """Groups split into train, val and test with one rank and two cut points."""
    return _one_seed(df, group, seed, _three_ranks(val, test), {"test": "test", "val": "val"}, "split")


def split_three(df: DataFrame, val: float, test: float = 0.0, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """Row-level train, val and test."""
    return split_group_three(df, row_id, val, test, seed)


def split_three_sample(
    df: DataFrame, val: float, test: float, sample: float, seed: int = 0, row_id: str = "row_id"
) -> DataFrame:
    """Row-level split with a flag on a share of the train rows.

    The sample takes the train rows next to the held-out ones in hash order.
    """
    ranks = _three_ranks(val, test)
    held = ranks["val"]
    ranks["sample"] = lambda n: held(n) + F.ceil((n - held(n)) * F.lit(float(sample)))
    names = {"test": "test", "val": "val", "sample": "sample"}
    sided = _one_seed(df, row_id, seed, ranks, names, "split")
    return sided.withColumn("is_sample", F.col("split") == "sample").withColumn(
        "split", F.when(F.col("split") == "sample", "train").otherwise(F.col("split"))
    )


def split_two(df: DataFrame, name: str, share: float = TEST_SHARE, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    return split_group(df, row_id, share, name, seed)


def split_bool(df: DataFrame, share: float = TEST_SHARE, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    sided = split_group(df, row_id, share, "valid", seed)
    return sided.withColumn("is_valid", F.col("split") == "valid").drop("split")


def split_many_seeds(
    df: DataFrame, group: str, seeds: Sequence[int], share: float = TEST_SHARE, name: str = "test"
) -> DataFrame:
    """Membership of every group for every seed: (seed, group, split), one job."""
    groups = df.select(group).distinct()
    cuts = _cut_map(split_cuts(groups, group, seeds, {"test": _share(share)}))
    many = groups.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    place = F.struct(group_hash(F.col("seed"), F.col(group)).alias("h"), F.col(group).alias("g"))
    # The cuts hold one row per seed.
    return many.join(F.broadcast(cuts), "seed").select(
        "seed", group, _side(place, F.col("cuts"), {"test": name}, "train").alias("split")
    )


def stratified_holdout(
    df: DataFrame, label: str, share: float = TEST_SHARE, seed: int = 0, row_id: str = "row_id"
) -> DataFrame:
    """Flag ``is_valid`` on a share of the rows of each label."""
    hashed = df.select(F.col(label).alias("k"), F.col(row_id).alias("g")).withColumn(
        "h", group_hash(F.lit(seed), F.col("g"))
    )
    cuts = nth_rows(hashed, ["k"], _cut_levels(), ["h", "g"], {"valid": _share(share)})
    # One row per label value.
    cut = F.broadcast(cuts.select(F.col("k").alias(label), F.struct("h", "g").alias("cut")))
    place = F.struct(group_hash(F.lit(seed), F.col(row_id)).alias("h"), F.col(row_id).alias("g"))
    return df.join(cut, label, "left").withColumn("is_valid", place <= F.col("cut")).drop("cut")


def near(actual: Column, wanted: Column | float) -> Column:
    wanted = wanted if isinstance(wanted, Column) else F.lit(float(wanted))
    return F.abs(actual - wanted) <= 0.1 + 0.1 * F.abs(wanted)


def split_check(df: DataFrame, shares: Mapping[str, float], group: str | None = None) -> DataFrame:
    """One row per check: achieved shares near the wanted ones, and no group in two splits."""
    counts = df.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in shares]
    )
    share_rows = counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f"share:{s}").alias("check"),
                        near(F.try_divide(F.col(s), F.col("n")), want).alias("passed"),
                    )
                    for s, want in shares.items()
                ]
            )
        ).alias("r")
    ).select("r.*")
    if group is None:
        return share_rows
    # The smallest and largest split name of a group differ when it is in two splits.
    overlap = (
        df.groupBy(group)
        .agg((F.min("split") != F.max("split")).alias("mixed"))
        .agg((F.count_if("mixed") == 0).alias("passed"))
        .select(F.lit("disjoint").alias("check"), "passed")
    )
    return share_rows.unionByName(overlap)


def prevalence_by_seed(
    df: DataFrame, group: str, label: str, seeds: Sequence[int], share: float = TEST_SHARE
) -> DataFrame:
    """Share of positive rows in the test split of each seed: (seed, prevalence).

    Rows are counted once per group; only the group counts meet the seeds.
    """
    groups = df.groupBy(group).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(label) == 1).alias("n_pos")
    )
    cuts = split_cuts(groups, group, seeds, {"test": _share(share)}).select(
        "seed", F.struct("h", "g").alias("cut")
    )
    many = groups.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    place = F.struct(group_hash(F.col("seed"), F.col(group)).alias("h"), F.col(group).alias("g"))
    return (
        many.join(F.broadcast(cuts), "seed")
        .filter(place <= F.col("cut"))
        .groupBy("seed")
        .agg(F.try_divide(F.sum("n_pos"), F.sum("n_rows")).alias("prevalence"))
    )


def prevalence_over_seeds(
    df: DataFrame, group: str, label: str, seeds: Sequence[int], share: float = TEST_SHARE
) -> DataFrame:
    return prevalence_by_seed(df, group, label, seeds, share).agg(
        F.count("*").alias("n_seeds"),
        F.avg("prevalence").alias("mean"),
        F.stddev_pop("prevalence").alias("std"),
    )
