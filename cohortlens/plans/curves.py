"""Model probability against the time before intensive care."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import scalar
from cohortlens.operators.cohort import time_range_filter
from cohortlens.operators.evaluate import self_weighted_mean


def with_interval(df: DataFrame, interval_hours: float, strict: bool = False, latest_of: DataFrame | None = None) -> DataFrame:
    """Add ``interval``, counted back from the latest time of the table (or of another one)."""
    latest = (df if latest_of is None else latest_of).agg(F.max("relative_seconds")).scalar()
    return df.withColumn(
        "interval", scalar.interval_bucket(F.col("relative_seconds"), latest, interval_hours, strict)
    )


def prob_by_interval(
    df: DataFrame,
    start_day: float = -20,
    end_day: float = -1,
    interval_hours: float = 12,
    self_weighted: bool = False,
    log_axis: bool = False,
    strict: bool = False,
) -> DataFrame:
    """(interval, prob): mean score, or the mean weighted by itself, per interval.

    The latest time comes from all rows; only then the range is cut out.
    """
    placed = with_interval(time_range_filter(df, start_day, end_day), interval_hours, strict, df)
    mean = self_weighted_mean(F.col("prob")) if self_weighted else F.avg("prob")
    out = placed.groupBy("interval").agg(mean.alias("prob"))
    return out.withColumn("interval", scalar.interval_log(F.col("interval"))) if log_axis else out
