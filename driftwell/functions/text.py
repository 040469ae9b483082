"""Scalar helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trim_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t]+|[ \t]+\z", "")


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]*)\z", 1))


def counter(c: Column) -> Column:
    """A stored count: blanks trimmed; empty or not a number counts as 1."""
    t = trim_blanks(c)
    return F.when(t.rlike(r"\A[0-9]+\z"), t.cast("long")).otherwise(F.lit(1).cast("long"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssZ")


def relative(path: Column, root: str) -> Column:
    """The path below root, with slashes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^" + re.escape(root.replace("\\", "/").rstrip("/")) + "/", ""))


def padded(c: Column, width: int) -> Column:
    """At least width characters: blanks follow, nothing is cut."""
    return F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c)


def nth(c: Column, i: int) -> Column:
    """The i-th element (from 0) of an array; null beyond its end."""
    return F.get(c, F.lit(i))


def version(text: Column, default: str = "0.0.0") -> Column:
    """The version of a JSON text; the default where it has none."""
    return F.coalesce(F.nullif(F.get_json_object(text, "$.version"), F.lit("")), F.lit(default))


def text_field(v: Column, path: str) -> Column:
    """Whether a variant's field is a string that is not blank."""
    x = F.try_variant_get(v, path, "variant")
    return F.coalesce((F.schema_of_variant(x) == "STRING") & (F.trim(F.try_variant_get(v, path, "string")) != ""), F.lit(False))


def filled_object(v: Column, path: str) -> Column:
    """Whether a variant's field is an object with a key at least."""
    x = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT<")) & (F.to_json(x) != "{}"), F.lit(False))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are computed once a row: they pass a generator, over which no later filter or projection is moved, so none repeats them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
