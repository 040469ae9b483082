"""Numbers and running values against plain loops, with stretches far smaller than the groups."""

import random

from pyspark.sql import functions as F

from driftwell.operators.segments import numbered, running


def rows_of(seed=3):
    rng = random.Random(seed)
    rows = []
    for g in ["a", "b", None, "c"]:
        for i in range({"a": 700, "b": 1}.get(g, 40)):
            rows.append((g, i, rng.choice([None, rng.randrange(-50, 50)])))
    rng.shuffle(rows)
    return rows


def test_running_equals_loops(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(3)
    for backwards in (False, True):
        got = running(df, ["g"], "i", {"s": ("sum", F.col("v")), "x": ("xor", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, block=16, backwards=backwards)
        found = {(r.g, r.i): (r.s, r.x, r.m, r.l) for r in got.collect()}
        assert len(found) == len(rows)
        for g in {r[0] for r in rows}:
            s = x = m = last = None
            for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=backwards):
                if v is not None:
                    s, x, m, last = (s or 0) + v, (x or 0) ^ v, v if m is None else max(m, v), v
                assert found[g, i] == (s, x, m, last), (g, i, backwards)


def test_a_group_is_spread(spark):
    df = spark.range(200_000).select(F.lit("one").alias("g"), F.col("id").alias("i"), F.lit(1).alias("v"))
    got = running(df, ["g"], "i", {"s": ("sum", F.col("v"))}, block=1000)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        each = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(each) == 200_000
    assert max(each) < 100_000
    assert got.where("s <> i + 1").isEmpty()


def test_numbers_have_no_gaps(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "z"]), rng.choice([None, *range(5)])) for _ in range(3000)]
    got = numbered(spark.createDataFrame(rows, "g string, o long").repartition(5), ["g"], ["o"]).collect()
    assert len(got) == len(rows)
    for g in ("a", None, "z"):
        mine = sorted((r.position, r.o) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [o for _, o in mine] == sorted((o for _, o in mine), key=lambda o: (o is not None, o or 0))


def test_no_group_and_no_rows(spark):
    empty = spark.createDataFrame([], "g string, i long")
    assert numbered(empty, ["g"], ["i"]).collect() == []
    assert running(empty, ["g"], "i", {"s": ("sum", F.col("i"))}).collect() == []
    got = numbered(spark.range(50).repartition(4), [], ["id"]).collect()
    assert sorted((r.id, r.position) for r in got) == [(i, i) for i in range(50)]
