"""Descriptive statistics of a cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import clip_upper
from cohortlens.operators.ordering import exact_quantiles
from cohortlens.storage import small_side


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def group_distinct(df: DataFrame, key: Column, name: str, counted: str) -> DataFrame:
    """Distinct ids per group, groups without a key left out."""
    return (
        df.select(key.alias(name), counted)
        .filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count_distinct(counted).alias(f"n_{counted}"))
    )


def group_count(df: DataFrame, *keys: str, to: str = "n_notes") -> DataFrame:
    present = df
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    return present.groupBy(*keys).agg(F.count("*").alias(to))


def filtered_group_counts(df: DataFrame, key: str, conditions: Mapping[str, Column]) -> DataFrame:
    """One count per condition and group, in one pass."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])
    )


def two_key_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Rows per pair of keys, with the total of the outer key."""
    counts = group_count(df, outer, inner)
    return counts.withColumn("n_total", F.sum("n_notes").over(Window.partitionBy(outer)))


def first_per_group(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first value of each group that is not null."""
    return (
        df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
        .groupBy(key)
        .agg(F.min_by(value, order).alias(value))
    )


def mean_quartiles(df: DataFrame, value: str, upper: float | None = None) -> DataFrame:
    """Mean, median and quartiles, after an optional upper clip."""
    clipped = df.select(
        (clip_upper(F.col(value), upper) if upper is not None else F.col(value)).alias(value)
    )
    quantiles = exact_quantiles(clipped, [value], (0.25, 0.5, 0.75)).agg(
        F.max(F.when(F.col("share") == 0.25, F.col("quantile"))).alias("q25"),
        F.max(F.when(F.col("share") == 0.5, F.col("quantile"))).alias("median"),
        F.max(F.when(F.col("share") == 0.75, F.col("quantile"))).alias("q75"),
    )
    picked = quantiles.agg(F.max(F.struct("*"))).scalar()
    return clipped.agg(
        F.avg(value).alias("mean"),
        picked["median"].alias("median"),
        picked["q25"].alias("q25"),
        picked["q75"].alias("q75"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum: (name, stat, value)."""
    stats = {
        "count": lambda c: F.count(c).cast("double"),
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    row = df.agg(*[fn(c).alias(f"{c}:{stat}") for c in columns for stat, fn in stats.items()])
    parts = F.split("key", ":")
    moments = row.unpivot([], list(row.columns), "key", "value").select(
        parts[0].alias("name"), parts[1].alias("stat"), "value"
    )
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75)).select(
        "name",
        F.concat(F.round(F.col("share") * 100).cast("int"), F.lit("%")).alias("stat"),
        F.col("quantile").alias("value"),
    )
    return moments.unionByName(quartiles)


def mean_group_size(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().agg(F.avg("count").alias("mean_size"))


def prevalence(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == 1).cast("double")).alias("prevalence"))


def _bounds(value: Column) -> Column:
    """Lowest and highest value; half a unit to each side when they are the same."""
    low, high = F.min(value), F.max(value)
    return F.struct(
        F.when(low == high, low - 0.5).otherwise(low).alias("lo"),
        F.when(low == high, high + 0.5).otherwise(high).alias("hi"),
    )


def _bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin; the maximum belongs to the last one."""
    return F.least(F.floor((value - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Rows per equal-width bin between minimum and maximum; empty bins count zero."""
    rows = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    bounds = rows.agg(_bounds(F.col("v"))).scalar()
    counts = rows.groupBy(_bin_of(F.col("v"), bounds["lo"], bounds["hi"], bins).alias("bin")).agg(
        F.count("*").alias("n")
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (bounds["hi"] - bounds["lo"]) / bins
    return every.join(counts, "bin", "left").select(
        "bin",
        (bounds["lo"] + F.col("bin") * width).alias("bin_low"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def grouped_histogram(df: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """Histogram per group, each with its own minimum and maximum; only filled bins.

    Bounds, one row per group, are broadcast if these, counted, are few.
    """
    rows = df.select(key, F.col(value).cast("double").alias("v")).filter(
        F.col("v").isNotNull() & F.col(key).isNotNull()
    )
    bounds = small_side(rows.groupBy(key).agg(_bounds(F.col("v")).alias("b")), "bounds")
    return (
        rows.join(bounds, key)
        .groupBy(key, _bin_of(F.col("v"), F.col("b.lo"), F.col("b.hi"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
