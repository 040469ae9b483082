"""Every registered query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(frame, cols):
    # pandas shows whole numbers with nulls among them as floats
    said = lambda x: "" if pd.isna(x) else str(int(x) if isinstance(x, float) and x.is_integer() else x)
    return sorted(tuple(map(said, r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got, cols) == plain(want, cols)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
