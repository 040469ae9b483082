"""Delimited regions, frontmatter and pipe tables of documents: validate, extract, replace, compare."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.text import computed


def count_of(text: Column, literal: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def region_problem(text: Column, begin: str, end: str) -> Column:
    """null if there is one begin before one end; else what is wrong."""
    b, e = count_of(text, begin), count_of(text, end)
    return F.when(b == 0, "missing-begin").when(e == 0, "missing-end").when(b > 1, "duplicate-begin").when(e > 1, "duplicate-end").when(F.locate(begin, text) > F.locate(end, text), "misordered")


def region(text: Column, begin: str, end: str) -> Column:
    """What stands between the markers; null where they are not sound."""
    inner = F.substring_index(F.substring_index(text, begin, -1), end, 1)
    return F.when(region_problem(text, begin, end).isNull(), inner)


def replaced(text: Column, begin: str, end: str, payload: Column) -> Column:
    """The text with its region replaced (idempotent); unsound texts stay, CR goes."""
    clean = F.translate(text, "\r", "")
    new = F.concat(F.substring_index(clean, begin, 1), F.lit(begin), payload, F.lit(end), F.substring_index(clean, end, -1))
    return F.when(region_problem(clean, begin, end).isNull(), new).otherwise(clean)


def freshness(current: Column, rendered: Column) -> Column:
    """FRESH or STALE; newlines at the end don't count."""
    trim = lambda c: F.regexp_replace(c, r"\n+\z", "")
    return F.when(trim(current).eqNullSafe(trim(rendered)), "FRESH").otherwise("STALE")


def inside_lines(lines: DataFrame, group: str, begin: str, end: str) -> DataFrame:
    """Lines strictly between the first begin line and the end line of each group; a group's bounds are combined before the shuffle."""
    at = lines.groupBy(group).agg(F.min(F.when(F.col("line") == begin, F.col("line_no"))).alias("b"), F.max(F.when(F.col("line") == end, F.col("line_no"))).alias("e"), F.count_if(F.col("line") == begin).alias("nb"), F.count_if(F.col("line") == end).alias("ne"))
    return lines.join(at.where("nb = 1 and ne = 1"), group).where("line_no > b and line_no < e").drop("b", "e", "nb", "ne")


#: A fence is a line of three dashes and blanks; the pattern of one within a text, and of one that begins it.
_FENCE, _FIRST = r"(?md)^---[ \t]*(?:\n|\z)", r"\A\x{FEFF}?---[ \t]*(?:\n|\z)"


def _fences(text: Column) -> tuple[Column, Column, Column]:
    """Whether the first line of a text is a fence, what follows that line, and the place of the next fence in it (from 1; 0 without one)."""
    clean = F.translate(text, "\r", "")
    feed = F.locate("\n", clean)
    body = F.when(feed > 0, F.substr(clean, feed + 1)).otherwise("")
    return clean.rlike(_FIRST), body, F.regexp_instr(body, F.lit(_FENCE))


def frontmatter(text: Column) -> Column:
    """The lines of the block between a fence in the first line and the next one; null without one.  Nothing behind the block is looked at."""
    first, body, at = _fences(text)
    return F.when(first & (at > 0), F.substr(body, F.lit(1), at - 1))


def frontmatter_problem(text: Column) -> Column:
    """null, missing-frontmatter (no fence in the first line; a null text) or unterminated-frontmatter."""
    first, _, at = _fences(text)
    return F.when(~F.coalesce(first, F.lit(False)), "missing-frontmatter").when(at == 0, "unterminated-frontmatter")


def with_frontmatter(df: DataFrame, text: str, block: str = "block", problem: str = "problem") -> DataFrame:
    """df with the block of a text and its problem, each computed once a row however often it is read."""
    return computed(df, **{block: frontmatter(F.col(text)), problem: frontmatter_problem(F.col(text))})


def front_value(block: Column, key: str) -> Column:
    """A key's value without comment and quotes; null if the key is not there, '' if it is empty."""
    raw = F.regexp_extract(block, rf"(?m)^{re.escape(key)}:[ \t]*([^\n]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(raw, r"[ \t]*#[^\n]*\z", ""), r"\s+\z", "")
    return F.when(block.rlike(rf"(?m)^{re.escape(key)}:"), F.regexp_replace(bare, r"""^["']|["']\z""", ""))


def fields_of(text: Column, key: str) -> Column:
    """The first line 'key: value' of a whole text, wherever it stands, without quotes; null without one."""
    line = rf"(?m)^{re.escape(key)}:[ \t]*([^\n]*)"
    clean = F.translate(text, "\r", "")
    return F.when(clean.rlike(line), F.regexp_replace(F.regexp_extract(clean, line, 1), r"""^["']|["']?\s*\z""", ""))


def front_list(value: Column) -> Column:
    """Items of a flow, comma or blank separated list."""
    return F.filter(F.split(F.translate(value, "[]\"'", ""), r"[,\s]+"), lambda x: x != "")


def table_rows(lines: DataFrame, columns: int) -> DataFrame:
    """Cells of pipe-table rows with this many columns, trimmed; ruler rows are left out."""
    cells = F.transform(F.split(F.regexp_replace(F.col("line"), r"^\s*\||\|\s*\z", ""), r"\|"), lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+\z", ""))
    return lines.where(F.col("line").rlike(r"^\s*\|")).withColumn("cells", cells).where((F.size("cells") == columns) & ~F.col("line").rlike(r"^[\s|:\-]+\z"))
