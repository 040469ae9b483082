"""Registries of checks and blocks: one scan, duplicates refused, every check told."""

import pytest
from pyspark.sql import functions as F

from driftwell.operators.checks import Block, Blocks, Check, Checks, numbers_of
from driftwell.plans.scans import text_checks



def test_one_scan_and_one_exchange(spark, tmp_path):
    spark.createDataFrame([(i, f"line {i}\n\n\n\tend @ 2024") for i in range(50)], "k int, text string").write.parquet(str(tmp_path / "t"))
    found = text_checks().run(spark.read.parquet(str(tmp_path / "t")), "k")
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("FileScan") == 1 and physical.count("Exchange ") == 1


def test_scopes(spark):
    c = Checks()
    c.add(Check(3, "tab", "WARN", "line", lambda x: x.contains("\t")))
    c.add(Check(1, "title", "FAIL", "count", lambda x: x.startswith("#"), 1, 1))
    c.add(Check(2, "null", "INFO", "text", lambda x: x.isNull()))
    rows = [("a", "# t\n\tx\ny\t\r\n"), ("b", "x"), ("c", None), ("d", ""), ("e", "# 1\n# 2")]
    df = spark.createDataFrame([(k, t, 9) for k, t in rows], "path string, text string, number int")
    found = c.run(df, "path")
    assert sorted((r["path"], r["number"], r["line_no"], r["n"]) for r in found.where("line_no is null or number <> 3").collect()) == [("b", 1, None, 0), ("c", 1, None, 0), ("c", 2, None, 1), ("d", 1, None, 0), ("e", 1, None, 2)]
    assert sorted((r["path"], r["line_no"], r["severity"]) for r in found.where("number = 3").collect()) == [("a", 2, "WARN"), ("a", 3, "WARN")]
    assert [tuple(r) for r in c.summary(found).orderBy("number").collect()] == [(1, "title", "FAIL", 4, "FAIL"), (2, "null", "INFO", 1, "INFO"), (3, "tab", "WARN", 2, "WARN")]
    only = c.run(df, "path", numbers=[2])
    assert {r["number"] for r in only.collect()} == {2} and c.summary(c.run(df.where("path = 'a'"), "path", numbers=[2]), [2]).collect()[0]["verdict"] == "PASS"
    assert c.run(df.where("false"), "path").collect() == []


def test_what_a_registry_refuses():
    c = Checks()
    c.add(Check(1, "a", "FAIL", "line", F.isnull))
    for number, name, scope in ((1, "b", "line"), (2, "a", "line"), (2, "b", "page")):
        with pytest.raises(ValueError):
            c.add(Check(number, name, "FAIL", scope, F.isnull))
    for numbers in ([], [7]):
        with pytest.raises(ValueError):
            c.selected(numbers)


def test_blocks(spark):
    b = Blocks()
    one = lambda text: lambda: spark.createDataFrame([(text,)], "text string")
    b.add(Block("n", "r.md", "<n>", "</n>", lambda: numbers_of([("rows", spark.range(3)), ("none", spark.range(0))])))
    b.add(Block("x", "r.md", "<x>", "</x>", one("new\nsame")))
    b.add(Block("y", "s.md", "<x>", "</x>", one("t")))
    b.add(Block("z", "gone.md", "<x>", "</x>", one("t")))
    for again in (Block("x", "t.md", "<q>", "</q>", one("")), Block("w", "r.md", "<x>", "</w>", one(""))):
        with pytest.raises(ValueError):
            b.add(again)
    files = spark.createDataFrame([("r.md", "a<n>\n| | |\n|---|---|\n| rows | 3 |\n| none | 0 |\n</n>b<x>\nold\nsame\n</x>"), ("s.md", "<x>t")], "path string, text string")
    assert {r["name"]: r["state"] for r in b.states(files).collect()} == {"n": "FRESH", "x": "STALE", "y": "missing-end", "z": "missing-file"}
    (hunk,) = b.stale(files).collect()
    assert (hunk["name"], hunk["old_from"], hunk["removed"], hunk["added"]) == ("x", 1, ["old"], ["new"])
    with pytest.raises(ValueError):
        Blocks().states(files)
