"""Mixing sources to target weights: pivotal dependent rounding over a reduction tree.

Every row of a source is wanted ``target / source_size`` times. Whole copies are taken
at once; the fractions are rounded together: two fractional rows meet, mass moves from
one to the other at random until one of them is integral, and the other goes on. The
move keeps ``size x fraction`` summed over the pair, so the words taken from a source
differ from its target by less than one row, and each row keeps its expected share.

A cell of the tree meets its rows one after the other and passes on at most one
fractional row; a level shuffles cells of about ``CELL`` rows, so a source of any size
is spread, and the levels are as many as the logarithm of the rows. All of it are
built-in functions. Randomness is a hash of the rows that meet, so reruns agree.

Edge cases: a null text has size 0 and is never taken; a null source is one source, the
last; rows that agree in doc_id, source and size are numbered and rounded on their own;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import storage

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
CELL = 128
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source: ``source_size`` and ``target``, from rows (source, size).

    Sources in code point order take the weights in turn. Sorted by how soon they reach
    ``most`` times their size, the full sources are a prefix, so the level at which the
    excess comes to rest is read from running sums over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), nth))
    per = per.withColumn("cap", F.col("source_size") * float(most))
    whole = Window.partitionBy()
    soonest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_weight)
    # The level rises from one full source to the next, and falls from the first that is not full.
    level = F.max("level").over(whole)
    return per.select("source", "source_size", F.least(level * F.col("weight"), F.col("cap")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _pivot(carry: Column, item: Column, seed: int) -> Column:
    """What becomes of two fractional rows: (settled row, settled copies, row that goes on).

    Mass ``up`` can flow to the item and ``down`` from it before one side is integral;
    the odds keep each row's expectation.
    """
    a, b = carry["w"].cast("double"), item["w"].cast("double")
    p, q = carry["p"], item["p"]
    up = F.least(p * a, (1 - q) * b)
    down = F.least((1 - p) * a, q * b)
    moved = F.when(
        _uniform(F.lit(seed), carry["h"], item["h"]) * (up + down) < down, up
    ).otherwise(-down)
    new_p, new_q = p - moved / a, q + moved / b
    flows_up = moved > 0
    # The side that limited the flow is integral now, by construction and not by rounding.
    first = F.when(flows_up, p * a <= (1 - q) * b).otherwise((1 - p) * a <= q * b)
    first_to, second_to = F.when(flows_up, 0).otherwise(1), F.when(flows_up, 1).otherwise(0)
    both = F.when(flows_up, p * a == (1 - q) * b).otherwise((1 - p) * a == q * b)
    return F.struct(
        F.when(first, carry["h"]).otherwise(item["h"]).alias("h"),
        F.when(first, first_to).otherwise(second_to).cast("int").alias("x"),
        F.struct(
            F.when(first, item["h"]).otherwise(carry["h"]).alias("h"),
            F.when(first, item["w"]).otherwise(carry["w"]).alias("w"),
            F.when(both, second_to.cast("double")).when(first, new_q).otherwise(new_p).alias("p"),
        ).alias("on"),
    )


_CARRY = "struct<h:bigint,w:bigint,p:double>"
_STATE = f"struct<carry:{_CARRY},step:struct<h:bigint,x:int,on:{_CARRY}>,done:array<struct<h:bigint,x:int>>>"


def _meet(items: Column, seed: int) -> Column:
    """Let the rows of one cell meet in order: settled rows, and what is left over."""

    def settle(done: Column, h: Column, x: Column) -> Column:
        return F.concat(done, F.array(F.struct(h.alias("h"), x.cast("int").alias("x"))))

    def whole(c: Column) -> Column:
        return (c["p"] <= 0) | (c["p"] >= 1)

    def state(carry: Column, step: Column, done: Column) -> Column:
        return F.struct(carry.alias("carry"), step.alias("step"), done.alias("done")).cast(_STATE)

    none = F.lit(None).cast(_CARRY)
    no_step = F.lit(None).cast(f"struct<h:bigint,x:int,on:{_CARRY}>")

    def merge(acc: Column, item: Column) -> Column:
        # Two steps a row: odd elements compute the meeting, even ones book it.
        start = state(item["i"], no_step, acc["done"])
        book = F.when(
            whole(acc["step"]["on"]),
            state(
                none,
                no_step,
                settle(
                    settle(acc["done"], acc["step"]["h"], acc["step"]["x"]),
                    acc["step"]["on"]["h"],
                    acc["step"]["on"]["p"],
                ),
            ),
        ).otherwise(state(acc["step"]["on"], no_step, settle(acc["done"], acc["step"]["h"], acc["step"]["x"])))
        return (
            F.when(item["book"], F.when(acc["step"].isNull(), acc).otherwise(book))
            .when(acc["carry"].isNull(), start)
            .otherwise(state(acc["carry"], _pivot(acc["carry"], item["i"], seed), acc["done"]))
        )

    twice = F.flatten(
        F.transform(
            items,
            lambda i: F.array(
                F.struct(F.lit(False).alias("book"), i.alias("i")), F.struct(F.lit(True).alias("book"), i.alias("i"))
            ),
        )
    )
    empty = state(none, no_step, F.array().cast("array<struct<h:bigint,x:int>>"))
    return F.aggregate(twice, empty, merge)


def round_fractions(items: DataFrame, seed: int = 17, cell: int = CELL) -> DataFrame:
    """Copies 0 or 1 of fractional rows (h, source, w, p) with 0 < p < 1 and w > 0.

    ``h`` tells rows apart. Each level is written to the shared folder, so a lost
    executor costs one level.
    """
    settled, level = [], 0
    open_rows = items
    counts = items.groupBy("source").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    while most > 0:
        keyed = open_rows.join(
            counts.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))
        ).drop("_s")
        cells = F.ceil(F.col("n") / cell).cast("long")
        keyed = keyed.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + level), F.col("h")), cells))
        met = keyed.groupBy("source", "cell").agg(
            F.array_sort(F.collect_list(F.struct("h", "w", "p"))).alias("items")
        )
        met = met.select("source", _meet(F.col("items"), seed + level).alias("m"))
        met = storage.materialize(met.select("source", "m.carry", "m.done"), f"mix_level_{level}")
        settled.append(met.select("source", F.explode("done").alias("d")).select("source", "d.h", "d.x"))
        open_rows = met.filter(F.col("carry").isNotNull()).select("source", "carry.h", "carry.w", "carry.p")
        if most <= cell:
            break
        counts = open_rows.groupBy("source").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        level += 1
    # At most one row per source is still fractional: it is drawn with its own odds.
    last = open_rows.select("source", "h", (_uniform(F.lit(seed - 1), F.col("h")) < F.col("p")).cast("int").alias("x"))
    for part in settled:
        last = last.unionByName(part)
    return last


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 17,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
) -> DataFrame:
    """doc_id, source, size, copy_no, source_size, target, copies, taken: one row per row of ``docs``.

    ``copy_no`` tells rows apart that agree in doc_id, source and size.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    same = storage.materialize(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix_rows")
    per = targets(same.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    per = storage.materialize(per, "mix_targets").withColumnRenamed("source", "_s")
    rows = same.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn(
        "wanted", F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    )
    rows = rows.withColumn("floor", F.floor("wanted").cast("int")).withColumn(
        # Two hashes of one row: rows are told apart by 64 bits within a source.
        "h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size"), F.col("copy_no"))
    )
    fractional = rows.filter(F.col("wanted") > F.col("floor")).select(
        "h", "source", F.col("size").alias("w"), (F.col("wanted") - F.col("floor")).alias("p")
    )
    extra = round_fractions(fractional, seed)
    extra = extra.select(F.col("h").alias("_h"), F.col("source").alias("_s"), "x")
    joined = rows.join(extra, (F.col("h") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    copies = F.col("floor") + F.coalesce(F.col("x"), F.lit(0))
    return joined.select(
        "doc_id",
        "source",
        "size",
        "copy_no",
        "source_size",
        F.col("target").cast("double").alias("target"),
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed, so that rows are told apart the same way in every run."""
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema]
    return F.xxhash64(F.lit(0), *[F.col(f"`{name}`") for name, kind in kinds if "map<" not in kind and "variant" not in kind])


def take_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as the mix takes it.

    Rows that agree in doc_id, source and size are numbered by a hash of the whole row; rows of
    one hash are equal, so it does not matter which is which.
    """
    mixed = mix(docs, doc_id, text, source, seed).filter("copies > 0")
    mixed = mixed.select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("copy_no").alias("_c"), "copies"
    )
    same = Window.partitionBy("_doc", "_source", "_size").orderBy("_tie")
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.col(doc_id).alias("_doc"),
        F.col(source).alias("_source"),
        word_count(F.col(text)).alias("_size"),
        row_hash(docs).alias("_tie"),
    ).withColumn("_no", F.row_number().over(same))
    match = (
        F.col("_doc").eqNullSafe(F.col("_d"))
        & F.col("_source").eqNullSafe(F.col("_s"))
        & (F.col("_size") == F.col("_z"))
        & (F.col("_no") == F.col("_c"))
    )
    return rows.join(mixed, match).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
