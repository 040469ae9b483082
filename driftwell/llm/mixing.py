"""Mixing sources to target weights: hash-threshold histograms.

Each source's budget is met by a threshold on a hash of the document: the tokens of a
source are summed by bucket of the hash, the bucket in which the sum passes the budget is
found, and only that bucket is divided again, until one hash is left.  Then the mix is a
filter: a document below its source's threshold is taken once more than the others.
Nothing is sorted, a larger budget takes what a smaller one takes and more, and a rerun
takes the same.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.segments import numbered

from .infra import cut, discard

#: Bits of the hash, and of a step of refinement: a histogram has 4,096 buckets a source.
BITS, STEP = 60, 12


def n_words(text: Column) -> Column:
    """Number of runs of other characters than space and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def hash_of(id_: Column, text: Column) -> Column:
    """The first BITS bits of the MD5 of id and text, as a number that is not negative; nulls are empty."""
    both = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for (source, source_size): shares of `share` times all sizes by weight.

    Sources in code-point order, null last, have the weights in turn.  No target exceeds
    `most` times its source's size: what is above is shared again by weight among the
    others until none is above.  The last share is the one at which the sources whose limit
    lies below it are full, so one pass over the sources by limit per weight finds it."""
    placed = numbered(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = placed.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * F.lit(most)).alias("limit")).withColumn("ratio", F.col("limit") / F.col("w"))
    all_ = s.agg((F.sum("source_size") * F.lit(share)).alias("total"), F.sum("w").alias("weights")).first()  # one row
    total, weights_left = all_["total"] or 0.0, all_["weights"] or 0
    full = None
    while weights_left:
        # those full at the level so far leave the rest to the others, which raises the level
        level = F.lit(total) / F.lit(float(weights_left))
        now = s.where(F.col("ratio") <= level).agg(F.sum("limit").alias("limit"), F.sum("w").alias("w"), F.count("*").alias("n")).first()  # one row
        if now["n"] == full:
            break
        full = now["n"]
        total, weights_left = (all_["total"] or 0.0) - (now["limit"] or 0.0), (all_["weights"] or 0) - (now["w"] or 0)
    level = F.lit(total) / F.lit(float(weights_left)) if weights_left else F.lit(float("inf"))
    shared = F.lit(total) * F.col("w") / F.lit(float(weights_left)) if weights_left else F.col("limit")
    return s.select("source", "source_size", F.when(F.col("ratio") <= level, F.col("limit")).otherwise(shared).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, at, left): documents with a hash below `at` are within the budget, and `left` of it remains for those at it.

    docs: source, size, hash; budgets: source, budget.  A histogram is one aggregation,
    combined before its shuffle; each step reads the documents of the boundary buckets only."""
    open_, found, used = budgets.where("budget > 0").select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix")), None, []
    for step in range(BITS // STEP):
        low = BITS - STEP * (step + 1)
        at = docs if step == 0 else docs.join(open_.select(F.col("source").alias("s"), F.col("prefix").alias("p")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", low + STEP) == F.col("p"))).select(docs["source"], "size", "hash")
        sums = at.groupBy("source", F.shiftright("hash", low).alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        seen = sums.withColumn("upto", upto).join(open_.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        # the first bucket whose sum passes the budget
        hit = seen.where("upto > left and upto - size <= left").select("source", "bucket", (F.col("left") - F.col("upto") + F.col("size")).alias("left"), "low", "high")
        here = cut(hit, "boundary")
        done = here.where("low = high").select("source", F.col("low").alias("at"), "left")
        found = done if found is None else found.unionByName(done)
        used.append(here)
        open_ = here.where("low < high").select("source", "left", F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    out = cut(found, "thresholds")
    discard(*used)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each document.

    size is the number of words.  The mix has `share` times all words, split among the
    sources by `targets`.  A source whose target is q times its size and a rest gives each
    document q times, and once more those below its threshold; the document at the
    threshold is taken where that brings the source nearer to its target.  So a source is
    off by half of one document at most, and no document exceeds `most` times (rounded up)
    its size.

    Defined results: a null text has no words; a null source is one, the last; documents
    without words have as many copies as the rule gives and change nothing; of rows equal
    in id, text and source as many are taken as the budget holds, whichever; a null id is an
    id; other columns are ignored, so names cannot clash; an empty table gives an empty
    result."""
    c = lambda name: F.col(f"`{name}`")
    sized = cut(docs.select(c(id_col).alias("id"), c(source_col).cast("string").alias("source"), n_words(c(text_col)).alias("size"), hash_of(c(id_col), c(text_col)).alias("hash")), "sized")
    goal = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = goal.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    limit = thresholds(sized.where("size > 0"), plan.select("source", "budget"))
    known = cut(plan.join(limit.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", "at", "left"), "plan")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # rows at a threshold are one document, or equal ones: of these the first that the budget holds, to the nearest
    at = numbered(rows.where("hash = at and size > 0"), ["source"], ["id"], "rank")
    more = (F.col("rank") + 0.5) * F.col("size") <= F.col("left")
    apart = rows.where("not (hash <=> at and size > 0)").withColumn("more", F.coalesce(F.col("hash") < F.col("at"), F.lit(False)))
    both = apart.unionByName(at.withColumn("more", more).drop("rank"))
    return both.select("id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more").cast("long")).alias("copies"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2.0::DOUBLE AS lim FROM s),
r AS (SELECT *, lim / w AS ratio, coalesce(sum(lim) OVER p, 0) AS lim_before, coalesce(sum(w) OVER p, 0) AS w_before, row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS k
  FROM w WINDOW p AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - lim_before) AS rest, CAST((SELECT sum(w) FROM w) - w_before AS DOUBLE) AS rest_w FROM r),
f AS (SELECT arg_min(rest, k) AS rest, arg_min(rest_w, k) AS rest_w, min(k) AS k FROM x WHERE ratio > rest / rest_w),
t AS (SELECT source, source_size, CASE WHEN f.k IS NULL OR x.k < f.k THEN lim ELSE f.rest * x.w / f.rest_w END AS target FROM x, f),
g AS (SELECT d.*, source_size, target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole,
  sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN before + 0.5 * size <= target - whole * source_size AND target - whole * source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM g"""
