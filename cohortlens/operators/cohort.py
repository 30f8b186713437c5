"""Cohort selection, label decoding and other row-wise table operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.config import INTERVAL_NAMES, LABEL_COLUMN, LABEL_NAMES
from cohortlens.functions import scalar

COHORT_COLUMNS = ("row_id", "hadm_id", "processed_note")


def cohort_ia(notes: DataFrame, *extra: str) -> DataFrame:
    """Notes with a usable imminent-admission label."""
    label = LABEL_COLUMN["ia"]
    return notes.filter(F.col(label) != -1).select(*COHORT_COLUMNS, label, *extra)


def cohort_ps(notes: DataFrame, *extra: str) -> DataFrame:
    """Notes charted before the last day, for the prolonged-stay task."""
    return notes.filter(F.col("chartinterval") != 0).select(*COHORT_COLUMNS, LABEL_COLUMN["ps"], *extra)


def cohort_ps_unfiltered(notes: DataFrame, *extra: str) -> DataFrame:
    return notes.select(*COHORT_COLUMNS, LABEL_COLUMN["ps"], *extra)


def cohort(notes: DataFrame, task: str, *extra: str, filtered: bool = True) -> DataFrame:
    if task == "ia":
        return cohort_ia(notes, *extra)
    return cohort_ps(notes, *extra) if filtered else cohort_ps_unfiltered(notes, *extra)


def with_relative_time(notes: DataFrame) -> DataFrame:
    """Add ``relative_charttime`` (interval) and ``relative_seconds`` (double)."""
    return notes.withColumn(
        "relative_charttime", scalar.relative_time(F.col("charttime"), F.col("intime"))
    ).withColumn("relative_seconds", scalar.interval_seconds(F.col("relative_charttime")))


def cohort_with_time(notes: DataFrame, task: str, *extra: str) -> DataFrame:
    return cohort(with_relative_time(notes), task, "relative_charttime", "relative_seconds", *extra)


def split_filter(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name)


def day_range(start: float, end: float) -> tuple[float, float]:
    """Day bounds before the anchor: made negative, then put in order."""
    start, end = (-abs(start) if start > 0 else start), (-abs(end) if end > 0 else end)
    return (start, end) if start <= end else (end, start)


def time_range_filter(df: DataFrame, start_day: float, end_day: float, seconds: str = "relative_seconds") -> DataFrame:
    """Rows strictly inside a range of days."""
    low, high = day_range(start_day, end_day)
    return df.filter(
        (F.col(seconds) > low * scalar.DAY_SECONDS) & (F.col(seconds) < high * scalar.DAY_SECONDS)
    )


def decode(value: Column, names: Mapping[int, str]) -> Column:
    """Text of an ordinal; null when the ordinal has none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in names.items():
        out = out.when(value == code, name)
    return out


def decode_label(df: DataFrame, label: str) -> DataFrame:
    """Replace a label by its text, the positive class first."""
    return (
        df.orderBy(F.col(label).desc()).withColumn(label, decode(F.col(label), LABEL_NAMES[label]))
    )


def decode_interval(df: DataFrame, index: str = "chartinterval", to: str = "days") -> DataFrame:
    names = F.array(*[F.lit(name) for name in INTERVAL_NAMES])
    return df.withColumn(to, F.try_element_at(names, F.col(index).cast("int") + 1))


def drop_rename(df: DataFrame, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(dict(rename or {}))


def scatter_scores(df: DataFrame, scores: DataFrame, missing: float = -1.0) -> DataFrame:
    """Put the scores of some rows next to all rows; the others get a constant."""
    return df.join(scores.select("row_id", "prob"), "row_id", "left").withColumn(
        "prob", F.coalesce("prob", F.lit(missing))
    )
