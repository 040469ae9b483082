"""Queries against their SQL on tables that have what the given ones lack: rows that share a key, nulls."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_queries import DATA, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def check(spark, tmp_path, name, **tables):
    """The query over the test data with these tables in place of its own."""
    c = duckdb.connect()
    for f in os.listdir(DATA):
        table = f.removesuffix(".parquet")
        if table in tables:
            tables[table].coalesce(1).write.parquet(str(tmp_path / f))
            c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path / f}/*.parquet'")
        else:
            (tmp_path / f).symlink_to(f"{DATA}/{f}")
            c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{f}'")
    got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), c.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(want)
    assert plain(got, cols) == plain(want, cols)


def test_pages_that_share_a_url(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    again = pages.withColumn("page_id", F.col("page_id") + 1)
    check(spark, tmp_path, "numbers_blocks", pages=pages.unionByName(again).unionByName(pages.limit(9)).unionByName(pages.limit(8).withColumns({"url": F.lit(None).cast("string"), "html": F.lit(None).cast("string")})))
