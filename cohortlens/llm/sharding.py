"""Sharding: contiguous shards of ordered atomic groups with the smallest largest shard.

Rows of equal text form a group that no cut divides. Groups are ordered by the digest
of their text, and running sizes come from bucket totals, so no task sorts the table.
The smallest feasible capacity is found by bisection; a capacity is feasible when a
greedy fill needs no more shards than asked for. One pass over the running sizes looks
up the next cut of several capacities at once, which settles several bisection steps.

A hot group is numbered in cells of bounded size. Edge cases: a null text has no bytes
and belongs with the empty texts; rows with a null or repeated doc_id are placed like
any other; an empty table gives an empty table; fewer groups than shards leave shards
empty. The driver holds one number per shard and capacity tried.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import storage
from cohortlens.operators import ordering

PROBES = 63  # capacities tried in one pass: six bisection steps
FETCH = 100_000  # running sizes that the driver may hold
ROWS_PER_CELL = 10_000


def _sized(docs: DataFrame, keep: Sequence[str], doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"),
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.sha2(body, 256).alias("digest"),
    )


def _next_cuts(groups: DataFrame, reach: list[int], largest: int) -> list[int]:
    """For each number, the largest running size that does not exceed it.

    That lies within one group of the number, so only a window of groups is looked at.
    """
    marks = sorted(set(reach))
    near = groups.filter((F.col("cum_size") <= marks[-1]) & (F.col("cum_size") >= marks[0] - largest))
    under = F.size(F.filter(F.lit(marks), lambda m: m < F.col("cum_size")))
    best = {r[0]: r[1] for r in near.groupBy(under.alias("at")).agg(F.max("cum_size")).collect()}
    ends, end = {}, 0
    for i, mark in enumerate(marks):
        end = max(end, best.get(i, 0))
        ends[mark] = end
    return [ends[x] for x in reach]


def _greedy(groups: DataFrame, capacities: list[int], shards: int, largest: int) -> list[list[int]]:
    """Where a greedy fill with each capacity ends its shards."""
    cuts = [[0] for _ in capacities]
    for _ in range(shards):
        ends = _next_cuts(groups, [c[-1] + size for c, size in zip(cuts, capacities)], largest)
        for c, end in zip(cuts, ends):
            c.append(max(end, c[-1]))
    return cuts


def _bisect(sums: list[int], low: int, high: int, shards: int, total: int) -> list[int]:
    """The same on the driver, once all running sizes that a cut can take are few."""

    def fill(capacity: int) -> list[int]:
        cuts = [0]
        for _ in range(shards):
            cuts.append(max(cuts[-1], sums[bisect.bisect_right(sums, cuts[-1] + capacity) - 1]))
        return cuts

    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if fill(middle)[-1] >= total else (middle, high)
    return fill(high)


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Ends of all shards but the last, under the smallest feasible capacity.

    ``groups`` has ``size`` and its running sum ``cum_size``. Every capacity of at least
    an even share plus the largest group is feasible, none below both of them is. A cut
    never moves back as the capacity grows, so the cuts of the largest infeasible and of
    the smallest feasible capacity so far bound all cuts in between; when few groups lie
    there they are fetched, at most ``FETCH``, else they are bisected once more.
    """
    total, largest = groups.agg(F.max("cum_size"), F.max("size")).first()
    if total is None:
        return []
    even = -(-total // shards)
    low, high = max(even, largest) - 1, even + largest  # low is infeasible, high is feasible
    while True:
        tried = sorted({low, high, *(low + (high - low) * i // (PROBES + 1) for i in range(1, PROBES + 1))})
        cuts = _greedy(groups, tried, shards, largest)
        first = next(i for i, c in enumerate(cuts) if c[-1] >= total)
        low, high = tried[first - 1], tried[first]
        if high - low == 1:
            return cuts[first][1:shards]
        between = F.lit(False)
        for a, b in zip(cuts[first - 1][1:], cuts[first][1:]):
            between = between | F.col("cum_size").between(a, b)
        open_sums = groups.filter(between).select("cum_size")
        if open_sums.count() <= FETCH:
            sums = sorted({0, *(r[0] for r in open_sums.collect())})
            return _bisect(sums, low, high, shards, total)[1:shards]


def shard(
    docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Struct ``row`` of kept columns with doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    sized = _sized(docs, keep or [doc_id], doc_id, text)
    cells = max(1, docs.count() // ROWS_PER_CELL)
    sized = sized.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    placed_cells = sized.groupBy("digest", "cell").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    groups = placed_cells.groupBy("digest").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"))
    levels = ordering.hex_levels(F.col("digest"), (2, 5))
    groups = ordering.running_sums(groups, [], levels, ["digest"], ["size", "rows"])
    groups = storage.materialize(groups.select("digest", "size", "rows", "cum_size", "cum_rows"), "shard_groups")

    cuts = minimax_cuts(groups, shards)
    place = F.lit(0)
    for cut in cuts:
        place = place + (F.col("cum_size") > cut).cast("int")
    starts = groups.agg(
        *[F.coalesce(F.max(F.when(F.col("cum_size") <= c, F.col("cum_rows"))), F.lit(0)) for c in cuts]
    ).first() if cuts else []
    before = F.array(F.lit(0).cast("long"), *[F.lit(int(n)).cast("long") for n in starts])
    numbered = groups.select("digest", place.alias("shard"), (F.col("cum_rows") - F.col("rows")).alias("first"))
    numbered = numbered.withColumn("first", F.col("first") - F.get(before, F.col("shard")))
    earlier = Window.partitionBy("digest").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed_cells = placed_cells.select(
        "digest", "cell", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("inside")
    ).join(numbered, "digest")
    within = Window.partitionBy("digest", "cell").orderBy("doc_id")
    return (
        sized.withColumn("nth", F.row_number().over(within) - 1)
        .join(placed_cells, ["digest", "cell"])
        .select(
            "row",
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("first") + F.col("inside") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
