"""Confusion cells and the exact ROC area of many runs, from packed scores.

A task sorts the scores it has of each run and writes them as one row: different scores,
and the positives and negatives at each. Equal scores are counted there, so a crowd of
one score is one entry. A run with many scores is cut into ranges at points taken from
its rows, of about ``RANGE_SCORES`` scores whatever their distribution; equal scores
share a range. Pairs are counted inside ranges, then between the ranges of a run.

A score that is null lies below all others, one that is not a number above.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.storage import materialize

PACK_ROWS = 1 << 20
RANGE_SCORES = 1 << 21
POINTS = 64
CELLS = ("tn", "fp", "fn", "tp")
PACKED = ("scores", "pos", "neg", "points", *CELLS)


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Consecutive parts of an array as one binary each."""
    offsets = (at * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= (c[1:] != c[:-1]) & ~((c[1:] != c[1:]) & (c[:-1] != c[:-1]))
    return np.flatnonzero(new)


def _groups(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number per row, equal for equal keys."""
    group, width = np.zeros(table.num_rows, dtype=np.int64), 1
    for key in keys:
        coded = table.column(key).combine_chunks().dictionary_encode("encode")
        width *= max(1, len(coded.dictionary))
        group = group * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        if width > 1 << 40:
            known, group = np.unique(group, return_inverse=True)
            width = len(known)
    return group


def _packs(table: pa.Table, keys: Sequence[str]) -> pa.RecordBatch:
    group = _groups(table, keys)
    column = table.column("prob").combine_chunks()
    prob = np.where(column.is_null().to_numpy(zero_copy_only=False), -np.inf, column.to_numpy(zero_copy_only=False).astype(float))
    cell = table.column("cell").to_numpy().astype(np.int64)
    order = np.lexsort((prob, group))
    group, prob, cell = group[order], prob[order], cell[order]
    first = _changes(group)
    number = np.zeros(len(group), dtype=np.int64)
    number[first[1:]] = 1
    number = np.cumsum(number)
    n = len(first)
    cells = np.bincount(number * 5 + cell, minlength=5 * n).reshape(n, 5)
    counted = cell < 4
    number, prob, positive = number[counted], prob[counted], cell[counted] >= 2
    starts = _changes(number, prob)
    pos = np.add.reduceat(positive, starts, dtype=np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
    neg = np.diff(np.append(starts, len(number))) - pos
    scores = prob[starts]
    size = np.bincount(number[starts], minlength=n)
    at = np.append(0, np.cumsum(size))
    step = -(-size // POINTS)
    picked = [scores[a : a + k : max(1, s)] for a, k, s in zip(at.tolist(), size.tolist(), step.tolist())]
    columns = [table.column(k).combine_chunks().take(pa.array(order[first])) for k in keys]
    columns += [_binary(x, at) for x in (scores, pos.astype(np.int32), neg.astype(np.int32))]
    columns += [pa.array(picked, pa.list_(pa.float64())), *(pa.array(cells[:, i]) for i in range(4))]
    return pa.RecordBatch.from_arrays(columns, [*keys, *PACKED])


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def packed_scores(preds: DataFrame, keys: Sequence[str], cells: dict[str, Column]) -> DataFrame:
    """Scores of a run that one task has, at most ``PACK_ROWS`` rows of all runs at a time, as one row."""
    cell = F.when(F.lit(False), F.lit(4))
    for i, name in enumerate(CELLS):
        cell = cell.when(cells[name], F.lit(i))
    base = preds.select(*keys, F.col("prob").cast("double").alias("prob"), cell.otherwise(4).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if held and n + batch.num_rows > PACK_ROWS:
                yield _packs(pa.Table.from_batches(held), keys)
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield _packs(pa.Table.from_batches(held), keys)

    counts = ", ".join(f"{c} long" for c in CELLS)
    return base.mapInArrow(run, f"{_key_types(preds, keys)}, scores binary, pos binary, neg binary, points array<double>, {counts}")


def _bounds(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least scores of the ranges of runs that have more than one: as few as scores by ``RANGE_SCORES``."""
    n = F.octet_length("scores") / 8
    points = packed.select(*keys, (n / F.size("points")).alias("n"), F.explode("points").alias("point"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("point"))
    ranged = points.withColumn("range", F.floor((upto - F.col("n")) / RANGE_SCORES))
    least = ranged.groupBy(*keys, "range").agg(F.min("point").alias("point")).filter(F.col("range") > 0)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_set("point")).alias("bounds"))


def _ranges(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packed rows, cut at the bounds of their run."""
    bounds = _bounds(packed, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "bounds")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    met = packed.join(F.broadcast(bounds), same, "left").select(*keys, "bounds", "scores", "pos", "neg", *CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(batch.column("bounds").is_null()).drop_columns(["bounds"])
            yield whole.append_column("range", pa.array(np.zeros(whole.num_rows, dtype=np.int32)))
            for i in np.flatnonzero(batch.column("bounds").is_valid().to_numpy(zero_copy_only=False)).tolist():
                row = batch.slice(i, 1)
                at = np.array(row.column("bounds")[0].as_py())
                scores = np.frombuffer(row.column("scores")[0].as_py())
                cut = np.concatenate([[0], np.searchsorted(scores, at), [len(scores)]])
                n = len(cut) - 1
                columns = [pa.concat_arrays([row.column(k)] * n) for k in keys]
                columns += [_binary(scores, cut)] + [_binary(np.frombuffer(row.column(c)[0].as_py(), dtype=np.int32), cut) for c in ("pos", "neg")]
                columns += [pa.array([row.column(c)[0].as_py()] + [0] * (n - 1), pa.int64()) for c in CELLS]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n, dtype=np.int32))], [*keys, "scores", "pos", "neg", *CELLS, "range"])

    counts = ", ".join(f"{c} long" for c in CELLS)
    return met.mapInArrow(run, f"{_key_types(packed, keys)}, scores binary, pos binary, neg binary, {counts}, range int")


def count_pairs(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run its cells, positives, negatives, and ``won``: negatives below each positive, half of those equal to it."""
    keys = list(keys)

    def merge(table: pa.Table) -> pa.Table:
        whole = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t)
        scores, pos, neg = whole("scores", np.float64), whole("pos", np.int32), whole("neg", np.int32)
        order = np.argsort(scores, kind="stable")
        starts = _changes(scores[order])
        add = lambda x: np.add.reduceat(x[order], starts, dtype=np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
        pos, neg = add(pos), add(neg)
        won = float((pos * (np.cumsum(neg) - neg + neg / 2.0)).sum())
        out = {k: table.column(k).slice(0, 1) for k in [*keys, "range"]}
        out |= {c: pa.array([int(table.column(c).to_numpy().sum())]) for c in CELLS}
        return pa.table(out | {"pos": pa.array([int(pos.sum())]), "neg": pa.array([int(neg.sum())]), "won": pa.array([won])})

    sums = (*CELLS, "pos", "neg")
    schema = f"{_key_types(packed, keys)}, range int, {', '.join(f'{c} long' for c in sums)}, won double"
    ranges = _ranges(packed, keys).groupBy(*keys, "range").applyInArrow(merge, schema)
    earlier = F.sum("neg").over(Window.partitionBy(*keys).orderBy("range")) - F.col("neg")
    step = ranges.withColumn("won", F.col("won") + F.col("pos").cast("double") * earlier)
    return step.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*sums, "won")])


def cells_and_pairs(preds: DataFrame, keys: Sequence[str], cells: dict[str, Column]) -> DataFrame:
    """``count_pairs`` of predictions; ``cells`` says which of the four cells a row counts in."""
    return count_pairs(materialize(packed_scores(preds, list(keys), cells), "packed_scores"), keys)
