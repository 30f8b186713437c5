"""Every query with SQL gives the same rows in both engines."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from contract.check import compare, duck
from contract.registry import ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert compare(got, want) == ""
    assert len(got) > 0 or len(want) == 0


def test_nullable_integers_compare_as_such():
    spark_side = pd.DataFrame({"k": [1.0, None, 3.0], "x": [0.5, 1.0, 2.0]})
    sql_side = pd.DataFrame({"k": pd.array([1, None, 3], dtype="Int64"), "x": [0.5, 1.0, 2.0]})
    assert compare(spark_side, sql_side) == ""
    assert compare(spark_side.assign(k=[1.0, None, 4.0]), sql_side) != ""
    assert compare(spark_side.assign(k=[1.5, None, 3.0]), sql_side) != ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 2 * 4 * 6
