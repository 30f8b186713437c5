"""Nearest neighbours of many queries: exact in blocks, or through a forest of random split planes.

Both ways end in the same step. Queries and rows meet in cells of bounded size, a cell
keeps the n nearest rows of each of its queries, and these short lists are merged. For
the exact answer every query meets every row. With a forest, rows and queries are dealt
to the leaves of its trees, and a query meets only the rows of the leaves next to it.

Rows and queries whose vector is null, has another length than most or holds a null or
NaN take no part. Equal distances go by idx.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import hash_uniform
from cohortlens.storage import materialize

ROWS_PER_CELL = 20_000
QUERIES_PER_CELL = 2_000
FIT_ROWS = 20_000
CELL = ["tree", "leaf", "row_cell", "query_cell"]
FOREST = "tree long, dim long, depth long, top long, normals binary, offsets binary, directions binary, below binary"


def usable(table: DataFrame, dimension: Column | int) -> DataFrame:
    broken = F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    return table.filter(F.col("vec").isNotNull() & (F.size("vec") == dimension) & ~broken)


def dimension_of(table: DataFrame) -> int:
    """The most frequent length of a vector, the greater of two; zero without rows."""
    sizes = table.filter(F.size("vec") > 0).groupBy(F.size("vec").alias("dim")).count()
    row = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    return row["dim"] if row else 0


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _cell_lists(queries: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(query, idx, token, distance): the n nearest rows of each query in each cell."""
    schema = pa.schema(
        [pa.field("query", pa.int64()), pa.field("idx", pa.int64()), pa.field("token", pa.string()), pa.field("distance", pa.float64())]
    )
    kind = queries.schema["query"].dataType.simpleString()

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({f: [] for f in names}, schema=schema.set(0, pa.field("query", left.schema.field("query").type)))
        points, idx = _matrix(right.column("vec"), right.num_rows), right.column("idx").to_numpy()
        asked = _matrix(left.column("vec"), left.num_rows)
        owner, at, far = [], [], []
        for i, point in enumerate(asked):
            d = np.sqrt(((points - point) ** 2).sum(axis=1))
            near = np.arange(len(d)) if len(d) <= n else np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
            near = near[np.lexsort((idx[near], d[near]))[:n]]
            owner.append(np.full(len(near), i))
            at.append(near)
            far.append(d[near])
        at = np.concatenate(at)
        return pa.table(
            [left.column("query").take(pa.array(np.concatenate(owner))), pa.array(idx[at]), right.column("token").take(pa.array(at)), pa.array(np.concatenate(far))],
            names=names,
        )

    names = schema.names
    out = f"query {kind}, idx long, token string, distance double"
    return queries.groupBy(*CELL).cogroup(rows.groupBy(*CELL)).applyInArrow(nearest, out)


def _merge(found: DataFrame, n: int) -> DataFrame:
    """Ranks of the n nearest of all lists; a list is cut before rows move."""
    order = Window.partitionBy("query").orderBy("distance", "idx", "token")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _spread(name: str, cells: Column, key: Column) -> Column:
    return F.pmod(F.xxhash64(key), cells).cast("int").alias(name)


def _every(name: str, cells: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), cells.cast("int") - 1)).alias(name)


def _cells(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / F.lit(size))).cast("long")


def exact_neighbors(queries: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """(query, idx, token, distance, rank) of the n nearest rows of every query (query, vec).

    Blocks of queries meet blocks of rows, so neither side is held whole anywhere.
    """
    dim = table.filter(F.col("vec").isNotNull()).agg(F.mode(F.size("vec"))).scalar()
    rows, asked = usable(table, dim), usable(queries, dim)
    row_cells = _cells(table.agg(F.count("*")).scalar(), ROWS_PER_CELL)
    query_cells = _cells(queries.agg(F.count("*")).scalar(), QUERIES_PER_CELL)
    one = [F.lit(0).alias("tree"), F.lit(0).cast("long").alias("leaf")]
    rows = rows.select(*one, "idx", "token", "vec", _spread("row_cell", row_cells, F.struct("idx", "token")), _every("query_cell", query_cells))
    asked = asked.select(*one, "query", "vec", _spread("query_cell", query_cells, F.col("query")), _every("row_cell", row_cells))
    return _merge(_cell_lists(asked, rows, n), n)


class _Tree:
    """One tree: planes between pairs of fitted rows above, shared random directions below.

    The upper ``top`` levels have a plane per node. Below them, where the fitted rows
    no longer tell nodes apart, each level has one direction, cut at the median of the
    upper leaf's fitted rows. So a tree stays small however deep it is.
    """

    def __init__(self, row: dict):
        self.depth, self.top, dim = row["depth"], row["top"], row["dim"]
        self.normals = np.frombuffer(row["normals"]).reshape(-1, dim)
        self.offsets = np.frombuffer(row["offsets"])
        self.directions = np.frombuffer(row["directions"]).reshape(-1, dim)
        self.below = np.frombuffer(row["below"]).reshape(1 << self.top, -1)

    def leaves(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest leaves of each row, by the squared distances to the planes crossed."""
        nodes, cost = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
        for level in range(self.depth):
            if level < self.top:
                at = (1 << level) - 1 + nodes
                side = np.einsum("mpd,md->mp", self.normals[at], x) - self.offsets[at]
            else:
                k = level - self.top
                side = (x @ self.directions[k])[:, None] - self.below[nodes >> k, k]
            right = (side > 0).astype(np.int64)
            nodes = np.concatenate([2 * nodes + right, 2 * nodes + 1 - right], axis=1)
            cost = np.concatenate([cost, cost + side**2], axis=1)
            kept = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            nodes, cost = np.take_along_axis(nodes, kept, 1), np.take_along_axis(cost, kept, 1)
        return nodes


def _grow(x: np.ndarray, tree: int, depth: int, top: int, seed: int) -> dict:
    rng, dim = np.random.default_rng([seed, tree]), x.shape[1]
    unit = lambda v: v / max(1e-300, np.linalg.norm(v))
    normals, offsets = np.zeros(((1 << top) - 1, dim)), np.zeros((1 << top) - 1)
    members = [np.arange(len(x))]
    for level in range(top):
        halves = []
        for k, own in enumerate(members):
            gap = np.subtract(*x[rng.choice(own, 2, replace=False)]) if len(own) > 1 else np.zeros(dim)
            normal = unit(gap if gap.any() else rng.standard_normal(dim))
            side = x[own] @ normal
            at = (1 << level) - 1 + k
            normals[at], offsets[at] = normal, np.median(side) if len(own) else 0.0
            halves += [own[side <= offsets[at]], own[side > offsets[at]]]
        members = halves
    directions = np.array([unit(rng.standard_normal(dim)) for _ in range(depth - top)]).reshape(depth - top, dim)
    middle = np.median(x @ directions.T, axis=0)
    below = np.array([np.median(x[own] @ directions.T, axis=0) if len(own) else middle for own in members])
    return {
        "tree": tree, "dim": dim, "depth": depth, "top": top,
        **{name: a.astype(float).tobytes() for name, a in (("normals", normals), ("offsets", offsets), ("directions", directions), ("below", below))},
    }


def fit_forest(table: DataFrame, trees: int = 20, leaf_rows: int = 64, fit_rows: int = FIT_ROWS, seed: int = 1) -> DataFrame:
    """A forest over (idx, token, vec), one row per tree, written once.

    Planes come from ``fit_rows`` rows with the least hashes, whatever the size of the
    table; the depth grows with its logarithm. Every tree is grown by a task of its own.
    """
    dim = dimension_of(table)
    rows = usable(table, dim)
    n = rows.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf_rows)))
    top = min(depth, max(0, math.floor(math.log2(max(1, min(n, fit_rows)) / leaf_rows))) + 1)
    share = min(1.0, 1.5 * fit_rows / max(1, n))
    drawn = rows.withColumn("u", hash_uniform(F.lit(seed), F.col("idx"), F.col("token"))).filter(F.col("u") <= share)
    sample = materialize(drawn.orderBy("u", "idx").limit(fit_rows).select("u", "idx", "vec"), "forest_sample")

    def grow(group: pa.Table) -> pa.Table:
        group = group.sort_by([("u", "ascending"), ("idx", "ascending")])
        return pa.Table.from_pylist([_grow(_matrix(group.column("vec"), group.num_rows), group.column("tree")[0].as_py(), depth, top, seed)])

    each = sample.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).repartition(trees, "tree")
    return materialize(each.groupBy("tree").applyInArrow(grow, FOREST), "forest")


def _dealt(df: DataFrame, forest: list[dict], columns: list[str], probes: int) -> DataFrame:
    """Rows with ``leaves``: the leaves they are dealt to, one list per tree."""
    shared = df.sparkSession.sparkContext.broadcast(forest)  # bounded by trees and fitted rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [_Tree(row) for row in shared.value]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(columns.index("vec")), part.num_rows)
                found = [[{"tree": row["tree"], "leaf": leaf} for row, own in zip(shared.value, per_tree) for leaf in own]
                         for per_tree in zip(*(t.leaves(x, probes).tolist() for t in trees))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int64())])))], [*columns, "leaves"]
                )

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns).mapInArrow(run, f"{kinds}, leaves array<struct<tree:int,leaf:bigint>>")


def first_of_equal(table: DataFrame, n: int) -> DataFrame:
    """At most n rows of each vector, the least idx: no others can be among n neighbours."""
    order = Window.partitionBy("vec").orderBy("idx", "token")
    return table.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= n).drop("_at")


def forest_neighbors(queries: DataFrame, table: DataFrame, n: int, forest: DataFrame | None = None, probes: int = 4) -> DataFrame:
    """About the n nearest rows of every query: (query, idx, token, distance, rank).

    Each query meets the rows of its ``probes`` nearest leaves of every tree, at exact
    distances. Every row is in one leaf of every tree. A leaf or the queries at it that
    outgrow a cell are split into several, so no group of equal or close vectors
    outgrows a task and none is cut off.
    """
    planes = forest if forest is not None else fit_forest(table)
    grown = sorted((r.asDict() for r in planes.collect()), key=lambda r: r["tree"])  # one row per tree
    if not grown:
        return exact_neighbors(queries, table, n)
    dim = grown[0]["dim"]
    kept = first_of_equal(usable(table, dim), n)
    rows = materialize(_dealt(kept, grown, ["idx", "token", "vec"], 1), "forest_rows")
    asked = materialize(_dealt(usable(queries, dim), grown, ["query", "vec"], probes), "forest_queries")

    place = ["tree", "leaf"]
    in_leaf = lambda df: df.select(F.explode("leaves").alias("at")).select("at.*").groupBy(*place)
    crowd = in_leaf(rows).agg(_cells(F.count("*"), ROWS_PER_CELL).alias("row_cells")).filter("row_cells > 1")
    rush = in_leaf(asked).agg(_cells(F.count("*"), QUERIES_PER_CELL).alias("query_cells")).filter("query_cells > 1")
    split = crowd.join(rush, place, "full")
    split = materialize(split.select(*place, F.coalesce("row_cells", F.lit(1)).alias("row_cells"), F.coalesce("query_cells", F.lit(1)).alias("query_cells")), "forest_split")
    one = lambda c: F.coalesce(F.col(c), F.lit(1).cast("long"))
    rows = rows.withColumn("at", F.explode("leaves")).select("at.*", "idx", "token", "vec").join(split, place, "left")
    rows = rows.select(*place, "idx", "token", "vec", _spread("row_cell", one("row_cells"), F.struct("idx", "token")), _every("query_cell", one("query_cells")))
    asked = asked.withColumn("at", F.explode("leaves")).select("at.*", "query", "vec").join(split, place, "left")
    asked = asked.select(*place, "query", "vec", _spread("query_cell", one("query_cells"), F.col("query")), _every("row_cell", one("row_cells")))
    found = _cell_lists(asked, rows, n).groupBy("query", "idx", "token").agg(F.min("distance").alias("distance"))
    return _merge(found, n)
