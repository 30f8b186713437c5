"""Neighbours of many queries against plain arithmetic, with copies, broken vectors and split cells."""

import math

import numpy as np
import pytest

from cohortlens.operators import neighbors

SCHEMA = "idx long, token string, vec array<double>"


def points(n=400, dim=8, copies=130):
    """Clustered points, one vector on a third of the rows."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, dim)) * 3
    x = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dim))
    x[rng.choice(n, copies, replace=False)] = x[0]
    return x


def frames(spark, x, step=7):
    table = spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(5)
    queries = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in range(0, len(x), step)], "query string, vec array<double>")
    return queries, table


def brute(x, n, step=7):
    out = {}
    for i in range(0, len(x), step):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[f"q{i}"] = np.lexsort((np.arange(len(x)), d))[:n].tolist()
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r["idx"])
        assert r["rank"] == len(out[r["query"]])
    return out


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(neighbors, "ROWS_PER_CELL", 50)
    monkeypatch.setattr(neighbors, "QUERIES_PER_CELL", 9)


def test_blocks_give_the_exact_lists(spark, small_cells):
    x = points()
    queries, table = frames(spark, x)
    assert listed(neighbors.exact_neighbors(queries, table, 6)) == brute(x, 6)
    assert listed(neighbors.exact_neighbors(queries, table, 1000)) == brute(x, 1000)


def test_a_forest_of_one_leaf_is_exact(spark, small_cells):
    x = points(150, copies=50)
    queries, table = frames(spark, x)
    forest = neighbors.fit_forest(table, trees=2, leaf_rows=1000)
    assert listed(neighbors.forest_neighbors(queries, table, 6, forest)) == brute(x, 6)


@pytest.mark.parametrize("fit_rows", [neighbors.FIT_ROWS, 64])
def test_a_forest_finds_most_neighbours(spark, small_cells, fit_rows):
    """Also where the fitted rows are few and the lower levels go by shared directions."""
    x = points()
    queries, table = frames(spark, x)
    forest = neighbors.fit_forest(table, trees=10, leaf_rows=16, fit_rows=fit_rows)
    first = forest.first()
    assert first["depth"] == math.ceil(math.log2(len(x) / 16)) and (first["top"] < first["depth"]) == (fit_rows == 64)
    found, want = listed(neighbors.forest_neighbors(queries, table, 6, forest)), brute(x, 6)
    assert set(found) == set(want) and all(len(v) == 6 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 6 * len(want)
    assert listed(neighbors.forest_neighbors(queries, table, 6, neighbors.fit_forest(table, 10, 16, fit_rows))) == found


def test_every_row_is_in_one_leaf_of_each_tree(spark):
    x = points(200, copies=70)
    _, table = frames(spark, x)
    grown = [r.asDict() for r in neighbors.fit_forest(table, trees=3, leaf_rows=16).collect()]
    for row in neighbors._dealt(table, grown, ["idx", "token", "vec"], 1).collect():
        assert sorted(at["tree"] for at in row["leaves"]) == [0, 1, 2]
    tree = neighbors._Tree(grown[0])
    probed = tree.leaves(x, 3)
    assert probed.shape == (200, 3) and (probed[:, 0] == tree.leaves(x, 1)[:, 0]).all()
    assert all(len(set(p)) == 3 for p in probed.tolist()) and probed.max() < 1 << grown[0]["depth"]


def test_broken_vectors_and_empty_tables(spark):
    rows = [(0, "a", [0.0, 0.0]), (1, "b", None), (2, "c", [1.0]), (3, "d", [math.nan, 0.0]), (4, "e", [None, 1.0]), (5, None, [1.0, 0.0]), (5, "f", [1.0, 0.0])]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("rank", neighbors.F.lit("x")).withColumn("leaf", neighbors.F.lit(1))
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("null", None), ("short", [1.0])], "query string, vec array<double>")
    for ways in (neighbors.exact_neighbors, neighbors.forest_neighbors):
        got = [(r["query"], r["idx"], r["token"], r["distance"], r["rank"]) for r in ways(asked, table, 3).orderBy("rank").collect()]
        assert got == [("q", 5, None, 0.0, 1), ("q", 5, "f", 0.0, 2), ("q", 0, "a", 1.0, 3)]
        assert ways(asked.limit(0), table, 3).count() == 0
        assert ways(asked, table.limit(0), 3).count() == 0
