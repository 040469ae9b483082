"""Line differences against the plain dynamic programme, and rebuilt texts."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from driftwell.operators import linediff


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_shortest_script():
    rng = random.Random(1)
    for n in range(400):
        letters = "ab" if n % 3 == 0 else "abcdefgh"
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(30))] for _ in range(2))
        if n % 5 == 0:
            b = [x for x in a if rng.random() < 0.8]
        found = linediff.hunks(a, b)
        out, at, kept = [], 0, 0
        for of, on, nf, nn in found:
            out += a[at:of] + b[nf : nf + nn]
            kept += of - at
            at = of + on
        kept += len(a) - at
        assert out + a[at:] == b and kept == common(a, b), (a, b)
        assert all(x[0] + x[1] < y[0] or x[2] + x[3] < y[2] for x, y in zip(found, found[1:], strict=False))


def test_long_texts_with_few_changes():
    rng = random.Random(2)
    a = [str(rng.randrange(50)) for _ in range(200_000)]
    b = list(a)
    for _ in range(40):
        i = rng.randrange(len(b))
        b[i : i + rng.randrange(3)] = [str(rng.randrange(60)) for _ in range(rng.randrange(3))]
    began = time.time()
    found = linediff.hunks(a, b)
    assert time.time() - began < 20 and sum(h[1] + h[3] for h in found) <= 160
    moved = np.array([1, 2, 3]), np.array([3, 1, 2])
    assert linediff.matches(*moved) == [(0, 1, 2)]


def test_hunks_rebuild_texts(spark):
    pairs = [("a\nb\nc\n", "a\nc\nd\n"), ("", "x"), ("x", None), (None, None), ("a\n", "a"), ("same\n", "same\n"), ("\n\n\n", "\n"), ("é\r\nb", "é\nb")]
    df = spark.createDataFrame([(i, o, n, 7) for i, (o, n) in enumerate(pairs)], "i int, old string, new string, old_from int").drop("old_from").repartition(3)
    found = linediff.line_hunks(df, "old", "new")
    assert {r["i"] for r in found.collect()} == {0, 1, 2, 4, 6, 7}
    each = found.groupBy("i").agg(F.collect_list(F.struct("old_from", "old_count", "added")).alias("h"))
    got = df.join(each, "i", "left").select("i", linediff.patched(F.col("old"), F.col("h")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: n or "" for i, (_, n) in enumerate(pairs)}
    assert linediff.line_hunks(df.where("false"), "old", "new").collect() == []
