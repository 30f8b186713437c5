"""Exact ranks, running totals and k-th rows without a single-task sort.

A window over a whole group puts that group into one task. The operators here
first cut a group into buckets by *levels*: integer columns that never decrease
along the sort order, coarse to fine. Bucket totals are small, so sums over all
earlier buckets come from windows over a bounded number of rows, and only rows
inside one finest bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.storage import materialize

# Buckets per doubling of the odds, coarse to fine.
ODDS_STEPS = (64, 32_768)
OUTSIDE = 1_000_000_000


def score_levels(x: Column, depth: int = 2) -> dict[str, Column]:
    """Levels for a score in [0, 1], and any number outside it.

    Buckets are even in log odds: fine near 0 and 1, where scores of rare or
    frequent classes crowd. Depth two cuts each bucket once more, for scores that
    crowd elsewhere, as those of balanced models do around one half.
    """
    odds = F.log2(x / (1 - x))
    return {
        f"lv{i}": F.when(x <= 0, F.floor(x * 1024.0) - OUTSIDE)
        .when(x >= 1, F.floor(x * 1024.0) + OUTSIDE)
        .otherwise(F.floor(odds * float(steps)))
        .cast("long")
        for i, steps in enumerate(ODDS_STEPS[:depth], start=1)
    }


def falling_levels(x: Column, depth: int = 2) -> dict[str, Column]:
    """Levels for scores from high to low."""
    return {name: -level for name, level in score_levels(x, depth).items()}


def span_levels(x: Column, low: Column, high: Column, depth: int = 1) -> dict[str, Column]:
    """Levels for a number known to lie between two bounds."""
    return score_levels(F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)), depth)


def hex_levels(digest: Column, digits: Sequence[int] = (2, 5)) -> dict[str, Column]:
    """Levels for a lowercase hexadecimal digest: ever longer prefixes."""
    return {
        f"lv{i}": F.conv(F.substring(digest, 1, d), 16, 10).cast("long")
        for i, d in enumerate(digits, start=1)
    }


def text_levels(term: Column, chars: Sequence[int] = (2, 6)) -> dict[str, Column]:
    """Levels for a string sorted by its bytes: ever longer prefixes."""
    return {f"lv{i}": F.substring(term, 1, n) for i, n in enumerate(chars, start=1)}


def _keyed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with all of these columns. Said up front, the same filter holds on both
    sides of the later join, so both read one shuffle."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def _join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, list(cols), how)


def bucket_offsets(
    df: DataFrame, keys: Sequence[str], levels: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Per finest bucket: its sums, ``before_*`` over earlier buckets, ``all_*`` per key."""
    keys, levels = list(keys), list(levels)
    totals = {}
    finest = df.groupBy(*keys, *levels).agg(*[F.sum(s).alias(s) for s in sums])
    totals[len(levels)] = finest
    for depth in range(len(levels) - 1, 0, -1):
        totals[depth] = (
            totals[depth + 1].groupBy(*keys, *levels[:depth]).agg(*[F.sum(s).alias(s) for s in sums])
        )

    out = None
    for depth in range(1, len(levels) + 1):
        parents = keys + levels[: depth - 1]
        earlier = (
            Window.partitionBy(*parents)
            .orderBy(levels[depth - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        whole = Window.partitionBy(*parents)
        step = totals[depth]
        cols = [F.col(c) for c in keys + levels[:depth]]
        cols += [F.col(s) for s in sums]
        cols += [F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"before_{s}") for s in sums]
        if depth == 1:
            cols += [F.sum(s).over(whole).alias(f"all_{s}") for s in sums]
            out = step.select(*cols)
            continue
        step = step.select(*cols)
        parent = out.select(
            *parents,
            *[F.col(f"before_{s}").alias(f"_up_{s}") for s in sums],
            *[f"all_{s}" for s in sums],
        )
        out = _join_on(step, parent, parents).select(
            *keys,
            *levels[:depth],
            *sums,
            *[(F.col(f"before_{s}") + F.col(f"_up_{s}")).alias(f"before_{s}") for s in sums],
            *[f"all_{s}" for s in sums],
        )
    return out


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    levels: dict[str, Column],
    order: Sequence[str],
    sums: Sequence[str],
    source: DataFrame | None = None,
) -> DataFrame:
    """Add ``cum_*`` (up to and including the row) and ``all_*`` (whole key) per key.

    ``order`` must be unique inside a key: aggregate equal rows first. Bucket totals
    may come from a ``source`` with the same sums before that aggregation: they then
    shuffle next to nothing.
    """
    names = list(levels)
    rows = _keyed(df.withColumns(levels), [*keys, *names])
    totals = rows if source is None else _keyed(source.withColumns(levels), [*keys, *names])
    offsets = bucket_offsets(totals, keys, names, sums).drop(*sums)
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    cum = rows.withColumns({f"_in_{s}": F.sum(s).over(inside) for s in sums})
    joined = _join_on(cum, offsets, [*keys, *names])
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{s}") + F.col(f"before_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
    )


def nth_rows(
    df: DataFrame,
    keys: Sequence[str],
    levels: dict[str, Column],
    order: Sequence[str],
    ranks: dict[str, Callable[[Column], Column]],
    weight: str | None = None,
    equal: bool = False,
) -> DataFrame:
    """The rows that hold given 1-based ranks: one row per key and rank name.

    ``ranks`` maps a name to a function of the group size. A row counts ``weight``
    times. The result has the keys, ``rank_name``, ``rank``, ``n`` and the row.
    Only the finest bucket around each wanted rank is sorted. With ``equal``, rows
    that agree in ``order`` are one and the same: those of the wanted buckets are
    counted map-side before they move, and the result has the ``order`` columns only.
    """
    names = list(levels)
    rows = df.withColumns(levels).withColumn("_w", F.col(weight) if weight else F.lit(1).cast("long"))
    rows = _keyed(rows, [*keys, *names])
    offsets = bucket_offsets(rows, keys, names, ["_w"])
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("rank_name"), rank(F.col("all__w")).cast("long").alias("rank"))
            for name, rank in ranks.items()
        ]
    )
    # At most one bucket per key and rank name, so this side is as small as keys x ranks.
    targets = (
        offsets.withColumn("_t", F.explode(wanted))
        .select(*keys, *names, "before__w", "_w", F.col("all__w").alias("n"), "_t.rank_name", "_t.rank")
        .filter((F.col("rank") > F.col("before__w")) & (F.col("rank") <= F.col("before__w") + F.col("_w")))
        .drop("_w")
    )
    near = _join_on(rows, F.broadcast(targets), [*keys, *names])
    left = [c for c in df.columns if c not in keys]
    if equal:
        near = near.groupBy(*keys, *names, "rank_name", "rank", "n", "before__w", *order).agg(F.sum("_w").alias("_w"))
        left = list(order)
    inside = Window.partitionBy(*keys, *names, "rank_name").orderBy(*order)
    upto = F.col("before__w") + F.sum("_w").over(inside)
    return (
        near.withColumn("_upto", upto)
        .filter((F.col("rank") > F.col("_upto") - F.col("_w")) & (F.col("rank") <= F.col("_upto")))
        .select(*keys, "rank_name", "rank", "n", *left)
    )


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the position of each row under a unique order, from zero.

    Spark cuts the order into ranges at splitters it samples, so a crowd of rows with one
    beginning is spread like any other; exact counts per range give the positions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row per range
    before, total = [], 0
    for row in sizes:
        before.append((row["_part"], total))
        total += row["n"]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, (F.col("_before") + inside).alias(name))


def first_k(
    df: DataFrame, levels: dict[str, Column], order: Sequence[str], k: int
) -> DataFrame:
    """The first ``k`` rows of a table under a unique order, all of them if there are fewer.

    The k-th row becomes a scalar, so the second pass is a plain filter.
    """
    cut = nth_rows(df, [], levels, order, {"k": lambda n: F.least(n, F.lit(k))})
    last = cut.agg(F.max(F.struct(*order))).scalar()
    return df.filter(F.struct(*order) <= last)


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles of numeric columns: (name, share, quantile).

    All columns share one plan. Rows are counted per value bucket, map-side; then only
    the values inside the buckets around the wanted ranks are counted and sorted, so
    next to nothing of the table is shuffled, however many distinct values it has.
    """
    entries = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]
    )
    rows = df.select(F.explode(entries).alias("e")).select("e.*").filter(F.col("v").isNotNull())
    spans = rows.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # One row per column name.
    placed = rows.join(F.broadcast(spans), "name")
    levels = span_levels(F.col("v"), F.col("lo"), F.col("hi"), depth=2)
    ranks: dict[str, Callable[[Column], Column]] = {}
    for i, share in enumerate(shares):
        at = lambda n, q=share: (n - 1) * F.lit(float(q))
        ranks[f"{i}:lo"] = lambda n, at=at: F.floor(at(n)) + 1
        ranks[f"{i}:hi"] = lambda n, at=at: F.least(F.floor(at(n)) + 2, n)
    picked = nth_rows(placed, ["name"], levels, ["v"], ranks, equal=True)
    parts = F.split("rank_name", ":")
    place = (F.col("n") - 1) * F.col("share")
    return (
        picked.withColumn("share", F.array(*[F.lit(float(q)) for q in shares])[parts[0].cast("int")])
        .groupBy("name", "share")
        .agg(
            F.max(F.when(parts[1] == "lo", F.col("v"))).alias("lo"),
            F.max(F.when(parts[1] == "hi", F.col("v"))).alias("hi"),
            F.max("n").alias("n"),
        )
        .select(
            "name",
            "share",
            (F.col("lo") + (F.col("hi") - F.col("lo")) * (place - F.floor(place))).alias("quantile"),
        )
    )
