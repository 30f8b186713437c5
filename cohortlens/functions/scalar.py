"""Small numeric and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400.0


def clip_upper(x: Column, limit: float) -> Column:
    """Values above the limit become the limit; null stays null."""
    return F.when(x > limit, F.lit(limit)).otherwise(x)


def relative_time(moment: Column, anchor: Column) -> Column:
    """``moment - anchor`` as a day-time interval, for both timestamp types."""
    return moment - anchor


def interval_seconds(interval: Column) -> Column:
    """Length of a day-time interval in seconds, to the microsecond."""
    days = F.extract(F.lit("DAY"), interval).cast("double")
    hours = F.extract(F.lit("HOUR"), interval).cast("double")
    minutes = F.extract(F.lit("MINUTE"), interval).cast("double")
    return days * DAY_SECONDS + hours * 3600.0 + minutes * 60.0 + F.extract(
        F.lit("SECOND"), interval
    ).cast("double")


def relative_seconds(moment: Column, anchor: Column) -> Column:
    return interval_seconds(relative_time(moment, anchor))


def interval_bucket(seconds: Column, latest: Column, interval_hours: float, strict: bool = False) -> Column:
    """Whole intervals before the latest time, in days of two half-day intervals.

    The divisor two is right for 12 hours only; ``strict`` divides by the number of
    intervals in a day instead.
    """
    steps = ((seconds - latest) / (interval_hours * 3600.0)).cast("long")
    return steps / F.lit(24.0 / interval_hours if strict else 2.0)


def interval_log(interval: Column) -> Column:
    return -F.log1p(-interval)


def round_metric(x: Column, places: int = 3) -> Column:
    """Round half to even."""
    return F.bround(x, places)


def threshold_predict(prob: Column, threshold: Column | float) -> Column:
    return (prob > threshold).cast("int")


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the parts: the same on every engine and for every partitioning."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
