"""Long name lists against plain search."""

import random
import re

from pyspark.sql import functions as F

from driftwell.operators import names


def test_ten_thousand_names_in_parts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc.-_é") for _ in range(rng.randrange(1, 9)))
    listed = sorted({word() for _ in range(20_000)})[:10_000]
    assert len(listed) > 5000
    texts = [(i, " ".join(word() for _ in range(12))) for i in range(150)] + [(1000, None), (1001, ""), (1002, "a" * 2000)]
    df = spark.createDataFrame(texts, "name_id int, line string").repartition(4)
    want = {(i, n) for i, t in texts for n in listed if t and n in t}
    table = spark.createDataFrame([(n,) for n in [*listed, *listed[:50], None, ""]], "name string")
    for source, most in ((listed, None), (table, None), (table, 3000)):
        got = [(r["name_id"], r["name"]) for r in names.held(df, source, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(list(names.parts(table, most=3000))) > 5 and all(sum(map(len, p)) <= 3000 for p in names.parts(table, most=3000))


def test_whole_words(spark):
    texts = ["a.b c", "xa.b", "a.b_", "(a.b)", "a.bé", "éa.b", "a.b a.bc", "a.bc", "9a.b a.b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    got = {r["line"] for r in names.held(df, ["a.b", "zz"], whole_word=True).collect()}
    assert got == {t for t in texts if re.search(r"(^|[^A-Za-z0-9_])a\.b([^A-Za-z0-9_]|\Z)", t)}


def test_used_and_nothing(spark):
    listed = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), (None, 4)], "name string, k int")
    texts = spark.createDataFrame([("axb",), (None,)], "t string")
    assert sorted(r["k"] for r in names.used(listed, texts, "t").collect()) == [1, 3]
    assert names.held(texts, [], "t").collect() == [] and names.held(texts.where("false"), ["x"], "t").collect() == []
    assert names.held(texts, ["x"], "t").where(F.col("name") == "x").count() == 1
