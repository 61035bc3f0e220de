"""Registered queries of the engine itself against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from ovelia import queries as q


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{at}')")
    return c


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, duck, sf_dir, name):
    a, b = q.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(q.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    order = lambda x: x[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(a), order(b), check_dtype=False)


def test_entry_has_the_queries():
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_neigh_sep_has_all_resolutions(spark, sf_dir):
    x = q.cut(q.table_d(spark, sf_dir))
    assert q.QUERIES["neigh_sep"](spark, sf_dir).collect() == q.st.neighbourhood_separability(x, 32).collect()
