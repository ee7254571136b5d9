"""Every catalogued query against its DuckDB equivalent."""

import glob
import os

import duckdb
import pytest

from keyflow import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names)))) if names else []


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, name):
    ours, theirs = catalogue.queries()[name](spark, SF).toArrow(), duck.sql(catalogue.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_reduce_chain_holds_no_whole_key(spark):
    """Sums in parts come before the shuffle, and no step takes a key's rows at once."""
    plan = catalogue.queries()["reduce_chain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "partial_sum" in plan and "collect_list" not in plan


def test_whole_mean_by_hand(spark):
    from keyflow.operators import merge

    states = spark.createDataFrame([(0, 1), (1, 2), (2, 4)], "part int, n int")
    # halves: {1} and {2, 4} -> 3; then 1 * 1/3 + 3 * 2/3 = 2.33 -> 2
    assert merge.whole_mean(states, "n").first()[0] == 2
