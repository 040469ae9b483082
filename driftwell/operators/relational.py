"""Integrity checks as joins and aggregations: every violation is a row, none stops the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.segments import running


def parity(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keys on one side only, tagged left_only or right_only; null keys match nothing."""
    keys = [on] if isinstance(on, str) else list(on)
    a, b = left.select(*keys), right.select(*keys)
    return a.join(b, keys, "left_anti").withColumn("problem", F.lit("left_only")).unionByName(b.join(a, keys, "left_anti").withColumn("problem", F.lit("right_only")))


def duplicates(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count n."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def roster(listed: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Problems of a list against a roster: duplicate, unknown, missing."""
    listed, known = listed.select(on), known.select(on)
    one = listed.distinct()
    return (
        duplicates(listed, on).select(on, F.lit("duplicate").alias("problem"))
        .unionByName(one.join(known, on, "left_anti").withColumn("problem", F.lit("unknown")))
        .unionByName(known.distinct().join(one, on, "left_anti").withColumn("problem", F.lit("missing")))
    )


def partition_check(members: DataFrame, universe: DataFrame, on: str) -> DataFrame:
    """A partition holds each member of the universe once and nothing else: rows where it doesn't."""
    return roster(members, universe, on)


def outside_vocabulary(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is none of the allowed ones (exact; null counts as outside)."""
    return df.where(~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))


def looked_up(left: DataFrame, right: DataFrame, on: str, a: str, b: str) -> DataFrame:
    """Rows of the left side whose column differs from the right one's, as differs, or that have none there, as missing."""
    r = right.select(on, F.col(b).alias("_b"), F.lit(True).alias("_there"))
    rows = left.select(on, F.col(a).alias("_a")).join(r, on, "left").where(~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_there").isNull())
    return rows.select(on, F.when(F.col("_there").isNull(), "missing").otherwise("differs").alias("problem"))


def pairs_by_stem(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Rows of the left side that have a file of the same stem on the right."""
    stem = lambda: F.regexp_replace(name, r"\.[^.]*\z", "")
    return left.withColumn("_stem", stem()).join(right.select(stem().alias("_stem")).distinct(), "_stem", "left_semi").drop("_stem")


def column_parity(left: DataFrame, right: DataFrame, on: str, a: str, b: str) -> DataFrame:
    """Keys on both sides whose columns differ; null equals null."""
    return left.select(on, a).join(right.select(on, b), on).where(~F.col(a).eqNullSafe(F.col(b)))


def stated_counts(df: DataFrame, group: str, stated: Column) -> DataFrame:
    """Groups whose stated size differs from their rows."""
    return df.groupBy(group).agg(stated.alias("stated"), F.count("*").alias("actual")).where("stated <> actual")


def all_equal(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: number of distinct values and whether all are equal and none is missing."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values"), F.count_if(F.col(value).isNull() | (F.col(value).cast("string") == "")).alias("n_missing")).withColumn("all_equal", (F.col("n_values") == 1) & (F.col("n_missing") == 0))


def holds_all(df: DataFrame, group: Sequence[str], member: str, required: Sequence[str]) -> DataFrame:
    """Relational division with the lack told: groups that hold a required member, how many, and whether all."""
    hit = df.where(F.col(member).isin(list(required)))
    return hit.groupBy(*group).agg(F.countDistinct(member).cast("int").alias("n_held")).withColumn("complete", F.col("n_held") == len(set(required)))


def upsert(user: DataFrame, framework: DataFrame, key: str, value: str) -> DataFrame:
    """User wins: keys of both sides (compared without case) with the value that stays, and added, identical, kept or user_only."""
    u = user.select(F.lower(F.col(key).cast("string")).alias("k"), F.lit(True).alias("in_user"), F.col(value).alias("mine"))
    f = framework.select(F.lower(F.col(key).cast("string")).alias("k"), F.lit(True).alias("in_framework"), F.col(value).alias("theirs"))
    status = F.when(F.col("in_user").isNull(), "added").when(F.col("in_framework").isNull(), "user_only").when(F.col("mine").eqNullSafe(F.col("theirs")), "identical").otherwise("kept")
    return u.join(f, "k", "full_outer").select(F.col("k").alias("key"), F.when(F.col("in_user"), F.col("mine")).otherwise(F.col("theirs")).alias("value"), status.alias("status"))


def first_by_name(df: DataFrame, wanted: DataFrame, name: str, order: str) -> DataFrame:
    """For each wanted name the first row (by order) whose name is equal without case."""
    w = Window.partitionBy("folded").orderBy(order)
    hits = df.withColumn("folded", F.lower(name)).join(wanted.select(F.lower(name).alias("folded")).distinct(), "folded", "left_semi")
    return hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "folded")


def sync_status(source: DataFrame, target: DataFrame, key: str, content: str) -> DataFrame:
    """new, updated or unchanged for each source row, by the hash of its content."""
    a = source.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("a"))
    b = target.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("b"), F.lit(True).alias("there"))
    return a.join(b, key, "left").select(key, F.when(F.col("there").isNull(), "new").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("updated").alias("status"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (as often as they differ) of either side only."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def sizes_of_groups(groups: DataFrame, members: DataFrame, group: str, on: str) -> DataFrame:
    """Group sums over nested groups, a group without members being 0: groups has (group, on), members has on."""
    n = members.groupBy(on).agg(F.count("*").alias("n"))
    return groups.join(n, on, "left").groupBy(group).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def latest(df: DataFrame, key: str | Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the last row of each key; combined before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("r")).select(*keys, "r.*")


def once(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def carry_header(lines: DataFrame, group: str, order: str, header: Column) -> DataFrame:
    """Each line with the last header at or before it, per group; order is a whole number, one a line.

    A group of any length is spread: each stretch of lines is scanned on its own, and begins
    with the last header of those before."""
    return running(lines, [group], order, {"section": ("last", header)})


def filled_count(df: DataFrame, column: str) -> DataFrame:
    """One row: how many values are neither null nor empty."""
    return df.agg(F.count_if(F.col(column).cast("string") != "").alias("n"))


def end_to_end(*arrays: Column) -> Column:
    """Arrays one after the other; a null one counts as empty."""
    return F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])


def top(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(n)


def top_and_rest(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows and, beside each, how many more there are."""
    rest = df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(rest))  # one row


def first_existing(candidates: DataFrame, existing: DataFrame, name: str, rank: str) -> DataFrame:
    """The best-ranked candidate that exists (no row if none does)."""
    return candidates.join(existing.select(name).distinct(), name, "left_semi").agg(F.min_by(name, rank).alias(name)).where(F.col(name).isNotNull())


def joined_in_order(df: DataFrame, key: str, order: str, value: str, separator: str = ",") -> DataFrame:
    """Values of each key joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), separator).alias("joined"))
