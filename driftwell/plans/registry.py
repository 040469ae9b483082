"""The registered queries and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(columns: str, rows: Sequence[tuple]) -> str:
    """SQL for literal rows; columns: 'name type, ...' with DuckDB's types."""
    pairs = [c.strip().split(" ", 1) for c in columns.split(",")]
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in pairs)
    return f"SELECT {casts} FROM (VALUES {body}) v({', '.join(n for n, _ in pairs)})"
