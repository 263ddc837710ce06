"""Every registered query gives the rows of its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from curvemill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(df: pd.DataFrame) -> list:
    cells = lambda x: "null" if x is None or x is pd.NA or (isinstance(x, float) and x != x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cells, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = tables.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
