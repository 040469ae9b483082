"""Name lists by filters against plain search."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from driftwell.operators import names

DATA = "/root/testdata/sf0.001"


def has(text, name, whole):
    return bool(re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", text)) if whole else name in text


def made(seed, alphabet="ab.-_é€😀 \0", n=300):
    """(names, texts) of a few letters, so that much is found, also across stretches."""
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most)))
    listed = sorted({word(rng.choice([3, 9, 20, 70])) for _ in range(n)})
    texts = [word(rng.choice([3, 60, 400])) for _ in range(40)] + ["", None] + ["".join(rng.choice(listed) + rng.choice(["", " ", "."]) for _ in range(5)) for _ in range(20)]
    return listed, texts


def filter_of(listed, whole, words):
    h = names._entries(pa.array(listed))
    held = np.zeros(words, np.uint64)
    np.bitwise_or.at(held, (h >> np.uint64(64 - (words.bit_length() - 1))).astype(np.int64), names._bits(h))
    return names._Filter(held, sorted({len(n.encode()) for n in listed}), whole)


def test_places_in_stretches(monkeypatch):
    for seed, stretch, words in ((1, 7, 1 << 12), (2, 64, 2), (3, 1 << 20, 1 << 10)):
        monkeypatch.setattr(names, "_STRETCH", stretch)
        listed, texts = made(seed)
        for whole in (False, True):
            found = [(int(r), may[c].decode(errors="replace")) for may, row, code in filter_of(listed, whole, words).candidates(pa.array(["skipped", *texts]).slice(1)) for r, c in zip(row, code)]
            assert len(found) == len(set(found))
            assert {f for f in found if f[1] in set(listed)} == {(i, n) for i, t in enumerate(texts) if t for n in listed if has(t, n, whole)}


def test_equal_hashes_are_told_apart():
    data, word, _ = names._bytes_of(pa.array(["abcdefghijabcdefghkk"]))
    pos, size, _, row, code = names._once(word, np.array([0, 0, 10, 0]), np.array([10, 8, 10, 10]), np.zeros(4, np.uint64), np.zeros(4, np.int64))
    assert sorted((data[p : p + n].tobytes(), c) for p, n, c in zip(pos, size, code)) == [(b"abcdefgh", 1), (b"abcdefghij", 0), (b"abcdefghkk", 2)]


def test_counted_used_and_held(spark, monkeypatch):
    listed, texts = made(5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").repartition(3)
    table = spark.createDataFrame([(n,) for n in [*listed, *listed[:9], None, ""]], "name string")
    for words, most in ((1 << 22, 1 << 23), (1 << 10, 70)):
        monkeypatch.setattr(names, "WORDS", words)
        monkeypatch.setattr(names, "MOST_NAMES", most)
        for whole in (False, True):
            want = {(i, n) for i, t in enumerate(texts) if t for n in listed if has(t, n, whole)}
            got = {r["name"]: r["n_rows"] for r in names.counted(df, table, "t", whole).collect()}
            assert got == {n: len([1 for _, m in want if m == n]) for n in {n for _, n in want}}
    monkeypatch.setattr(names, "PART", 100)
    got = [(r["k"], r["name"]) for r in names.held(df, table, "t").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, n) for i, t in enumerate(texts) if t for n in listed if n in t}
    assert names.counted(df, [], "t").collect() == [] and names.counted(df.where("false"), ["a"], "t").collect() == []


def test_used_sends_names_alone(spark):
    """A text is not copied for each name that it holds."""
    found = names.used(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a b",)], "t string"), "t")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert re.findall(r"MapInArrow run\([^)]*\)(?:#\d+)?, \[([^\]]*)\]", plan) and not re.search(r"MapInArrow run\([^)]*\)(?:#\d+)?, \[t#", plan)
    assert [r["name"] for r in found.orderBy("name").collect()] == ["a", "b"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["name_list_scan", "name_list_words"])
def test_a_list_of_many_parts_is_one_pass(spark, monkeypatch, name):
    """However long the list is, texts are read once and their lines are not copied."""
    import __spark_entry__ as entry

    monkeypatch.setattr(names, "PART", 500)
    found = entry.queries()[name](spark, DATA)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1 and found.columns == ["name", "n_lines"]
