"""The problem relation, verdicts, scores and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a problem. Severity is FAIL, WARN or INFO.
PROBLEM = "check_id int, severity string, type string, subject string, path string, line long, detail string"
_CHECKS: dict[int, Callable[..., DataFrame]] = {}


def check(number: int) -> Callable:
    """Registers a function (of whatever inputs) that returns problems as check `number`."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if number in _CHECKS:
            raise ValueError(f"check {number} is registered already")
        _CHECKS[number] = f
        return f

    return keep


def selected(numbers: Iterable[int] | None = None) -> dict[int, Callable[..., DataFrame]]:
    """The checks of these numbers (all by default); an empty selection is an error, since nothing would be checked."""
    out = {n: f for n, f in sorted(_CHECKS.items()) if numbers is None or n in set(numbers)}
    if not out:
        raise ValueError("no check is selected")
    return out


def problems(df: DataFrame, number: int, type_: Column | str, subject: Column | str, severity: str = "FAIL", path: Column | None = None, line: Column | None = None, detail: Column | None = None) -> DataFrame:
    c = lambda x, t: (F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x).cast(t)
    return df.select(F.lit(number).cast("int").alias("check_id"), F.lit(severity).alias("severity"), c(type_, "string").alias("type"), c(subject, "string").alias("subject"), c(path, "string").alias("path"), c(line, "long").alias("line"), c(detail, "string").alias("detail"))


def verdict(found: DataFrame, examined: DataFrame) -> DataFrame:
    """One row: counts by severity, rows examined, and PASS, FAIL or EMPTY (nothing was examined)."""
    n = examined.agg(F.count("*").alias("n_examined"))
    s = found.agg(*[F.count_if(F.col("severity") == x).alias(f"n_{x.lower()}") for x in ("FAIL", "WARN", "INFO")])
    v = F.when(F.col("n_examined") == 0, "EMPTY").when(F.col("n_fail") > 0, "FAIL").otherwise("PASS")
    return s.crossJoin(F.broadcast(n)).withColumn("verdict", v)  # one row each


def check_numbers(text: Column) -> Column:
    """The distinct numbers of checks that a script registers, in order; a check registered twice counts once."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^_check_on ([0-9]+) "), F.lit(1)), lambda x: x.cast("int"))))


def count_of_key(counts: DataFrame, key: str, column: str = "key", value: str = "n") -> int:
    """The count of one key; an unknown key is an error."""
    row = counts.where(F.col(column) == key).select(value).head()
    if row is None:
        raise KeyError(key)
    return row[0]


def weighted(parts: Sequence[tuple[str, str]]) -> Column:
    """Sum of weight times column, as a decimal; parts: (column, weight as text)."""
    total = F.lit(Decimal(0)).cast("decimal(18,4)")
    for column, weight in parts:
        total = total + F.col(column).cast("decimal(10,2)") * F.lit(Decimal(weight)).cast("decimal(6,2)")
    return total.cast("decimal(18,4)")


def band(score: Column, bands: Sequence[tuple[int, str]], lowest: str) -> Column:
    """The name of the first band (from the highest) that the score reaches."""
    out = F.lit(lowest)
    for least, name in sorted(bands):
        out = F.when(score >= least, name).otherwise(out)
    return out


def plateau(scores: DataFrame, key: str, order: Sequence[str], score: str, gain: int = 3, most: int = 3, enough: int = 90) -> DataFrame:
    """The row at which each key's loop stops, and why: enough, plateau (gain under `gain`) or limit."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = scores.withColumn("iteration", F.row_number().over(w)).withColumn("before", F.lag(score).over(w))
    why = F.when(F.col(score) >= enough, "enough").when(F.col(score) - F.col("before") < gain, "plateau").when(F.col("iteration") >= most, "limit")
    stops = rows.where(F.col("iteration") <= most).withColumn("reason", why).where("reason is not null")
    rest = [c for c in stops.columns if c not in (key, "before")]
    return stops.groupBy(key).agg(F.min_by(F.struct(*rest), "iteration").alias("r")).select(key, "r.*")
