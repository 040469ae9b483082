"""Numbers and running values over groups of any size.

A group lies in many tasks: each scans its own stretch, which begins with a row that holds
what the stretches before it come to (there is one such row a stretch).  So a document, a
session or a key that holds a third of all rows is scanned by as many tasks as it has
stretches, where a plain window would put it into one.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.sources.shared import written

#: Rows of a stretch of ``running``.
BLOCK = 1 << 16

#: Kinds of running values: the function of a stretch.
_KINDS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "xor": F.bit_xor, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def _scanned(rows: DataFrame, group: Sequence[str], stretch: str, at: str, kinds: Sequence[str], backwards: bool) -> DataFrame:
    """rows with _h0, _h1, ...: the running values of _v0, _v1, ... over group, scanned stretch by stretch."""
    turned = F.desc if backwards else F.asc
    ends = Window.partitionBy(*group).orderBy(turned(stretch)).rowsBetween(Window.unboundedPreceding, -1)
    value = lambda i: F.col(f"_v{i}")
    last = F.min_by if backwards else F.max_by
    sums = [last(value(i), F.when(value(i).isNotNull(), F.col(at))) if k == "last" else _KINDS[k](value(i)) for i, k in enumerate(kinds)]
    found = rows.groupBy(*group, stretch).agg(*[s.alias(f"_s{i}") for i, s in enumerate(sums)])
    heads = found.select(*group, stretch, *[_KINDS[k](F.col(f"_s{i}")).over(ends).alias(f"_v{i}") for i, k in enumerate(kinds)])
    heads = heads.where(F.greatest(*[value(i).isNotNull() for i in range(len(kinds))], F.lit(False)))
    both = rows.withColumn("_row", F.lit(1)).unionByName(heads.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*group, stretch).orderBy("_row", turned(at)).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({f"_h{i}": _KINDS[k](value(i)).over(w) for i, k in enumerate(kinds)}).where("_row = 1")


def dealt(df: DataFrame, group: Sequence[str], order: Sequence[str], at: str = "at") -> DataFrame:
    """df, written by ranges of (group, order), with a number that rises in that order (nulls first) over all rows; in a task (the number's bits from 33 on) it has no gaps.

    A tie-breaker deals equal rows too, so no group and no run of equal rows is one task's.
    The rows are written because their ranges come from a sample."""
    by = [*group, *order, "_tie"]
    ranged = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by).sortWithinPartitions(*by)
    return written(ranged.drop("_tie").withColumn(at, F.monotonically_increasing_id()), "dealt")


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """df and its rows' places in their group, from 0 without gaps, by order (nulls first); rows equal in it are numbered in any order.

    Null is a group like others; an empty table gives an empty one."""
    rows = dealt(df, group, order, "_at").withColumns({"_task": F.shiftright("_at", 33), "_v0": F.lit(1).cast("long")})
    return _scanned(rows, group, "_task", "_at", ["sum"], False).select(*df.columns, (F.col("_h0") - 1).alias(name))


def running(df: DataFrame, group: Sequence[str], at: str, values: dict[str, tuple[str, Column]], block: int = BLOCK, backwards: bool = False) -> DataFrame:
    """df and, by name, running values (kind, column) from the start of the group to each row, by the whole number `at`, which no two rows of a group share.

    kind: sum, xor, max, or last (the last that is not null); a value is null until there is
    one that is not.  backwards: from the end of the group to each row.  A stretch is the
    rows whose number has the same quotient by `block`.  A row without a number has no place
    and is left out; null is a group like others."""
    rows = df.where(F.col(at).isNotNull()).withColumns({"_block": F.floor(F.col(at) / block).cast("long"), **{f"_v{i}": c for i, (_, c) in enumerate(values.values())}})
    out = _scanned(rows, group, "_block", at, [k for k, _ in values.values()], backwards)
    return out.select(*df.columns, *[F.col(f"_h{i}").alias(n) for i, n in enumerate(values)])
