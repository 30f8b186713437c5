"""Sorting, top-n, set operations and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_by_score(df: DataFrame, score: str = "score", tie: str = "term") -> DataFrame:
    return df.orderBy(score, tie)


def first_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def head_tail_n(df: DataFrame, n: int, score: str = "score", tie: str = "term") -> DataFrame:
    """First and last rows of the sorted table, tagged by side."""
    head = first_rows(df, [F.col(score).asc(), F.col(tie).asc()], n).withColumn("side", F.lit("head"))
    tail = first_rows(df, [F.col(score).desc(), F.col(tie).desc()], n).withColumn("side", F.lit("tail"))
    return head.unionByName(tail)


def top_words_pos_neg(df: DataFrame, n: int, score: str = "score", term: str = "term") -> DataFrame:
    """Highest and lowest scored terms, with the score rounded to two places."""
    sides = head_tail_n(df.select(term, score), n, score, term)
    return sides.select(
        F.when(F.col("side") == "tail", "pos").otherwise("neg").alias("side"),
        term,
        F.bround(score, 2).alias(score),
    )


def first_row(df: DataFrame, order: str = "row_id") -> DataFrame:
    return df.orderBy(order).limit(1)


def distinct_groups(df: DataFrame, group: str, split: str | None = None) -> DataFrame:
    rows = df if split is None else df.filter(F.col("split") == split)
    return rows.select(group).distinct()


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def union_splits(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def intersect_groups(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    return left.select(group).intersect(right.select(group))


def shared_groups(df: DataFrame, group: str, one: str, other: str) -> DataFrame:
    """Number of groups that occur in both splits; zero when they are disjoint."""
    left = df.filter(F.col("split") == one).select(group).distinct()
    right = df.filter(F.col("split") == other).select(group)
    return left.join(right, group, "left_semi").agg(F.count("*").alias("n_shared"))


def melt(df: DataFrame, ids: Sequence[str], names: Sequence[str], variable: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(names), variable, value)


def transpose_metrics(df: DataFrame, row: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long (.., metric, value) to one column per metric."""
    return df.groupBy(*row).pivot("metric", list(metrics)).agg(F.first("value"))


def count_and_distinct(df: DataFrame, key: str, counted: str) -> DataFrame:
    """Row count and distinct ids per key.

    Both measures of a joined pair of group tables in one aggregation, so nothing
    has to be joined.
    """
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n_notes"), F.count_distinct(counted).alias(f"n_{counted}"))
    )


def equi_inner(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")
