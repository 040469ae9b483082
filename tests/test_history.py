"""Reachability by chains against a plain walk."""

import random

import pytest

from driftwell.operators import history


def past_of(start, parents):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += parents.get(x, [])
    return seen


def plain(checkouts, commits):
    parents = {}
    for i, p in commits:
        if p is not None and i is not None:
            parents.setdefault(i, []).append(p)
    out = {}
    for name, head, other in checkouts:
        if head is None or other is None:
            out[name] = ("unknown", None)
        elif head == other:
            out[name] = ("in sync", None)
        else:
            theirs = past_of(other, parents)
            out[name] = ("behind", len(theirs - past_of(head, parents))) if head in theirs else ("diverged", None)
    return out


def check(spark, checkouts, commits):
    got = history.drift(spark.createDataFrame(checkouts, "name string, head string, other string"), spark.createDataFrame(commits, "id string, parent string").repartition(3))
    assert {r["name"]: (r["state"], r["n_behind"]) for r in got.collect()} == plain(checkouts, commits)


def test_random_histories(spark):
    rng = random.Random(3)
    commits = [("c000", None)]
    for i in range(1, 160):
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            commits.append((f"c{i:03}", f"c{max(0, i - rng.randrange(1, 12)):03}"))
    commits += [commits[5], ("lost", "never seen"), (None, "c001")]
    ids = [i for i, _ in commits if i] + ["unknown to all", "never seen"]
    check(spark, [(f"k{n}", rng.choice([*ids, None]), rng.choice(ids)) for n in range(40)], commits)


def test_lines_that_cross_at_every_commit(spark):
    """Two lines that merge each other all the time, where a walk of paths would double with each merge."""
    commits = []
    for i in range(1, 200):
        commits += [(f"a{i}", f"a{i - 1}"), (f"b{i}", f"b{i - 1}"), (f"a{i}", f"b{i - 1}"), (f"b{i}", f"a{i - 1}")]
    check(spark, [("same line", "a10", "a199"), ("across", "b10", "a199"), ("apart", "b199", "a199"), ("ahead", "a199", "a198")], commits)


def test_first_parents_in_their_order(spark):
    """With nth a line of development is one chain, whatever its ids."""
    rng = random.Random(9)
    names = rng.sample([f"{x:06x}" for x in range(10**6)], 300)
    rows = [(names[i], names[i - 1], 1) for i in range(1, 300)] + [(names[i], names[i - 7], 2) for i in range(10, 300, 5)]
    places, _ = history.laid_out(spark.createDataFrame(rows, "id string, parent string, nth int"))
    assert {(r["chain"], r["place"]) for r in places.collect()} == {(names[0], i) for i in range(300)}


def test_circle_and_nothing(spark):
    with pytest.raises(ValueError, match="circle"):
        history.laid_out(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"))
    check(spark, [("x", None, "a"), ("y", "a", "a"), ("z", "b", "a")], [])
    check(spark, [], [("a", "b")])


def test_ancestors(spark):
    got = history.ancestors(spark.createDataFrame([("k", "d"), ("l", "b")], "key string, id string"), spark.createDataFrame([("d", "c"), ("d", "b"), ("c", "a"), ("b", "a"), ("e", "d")], "id string, parent string"))
    assert sorted(tuple(r) for r in got.select("key", "id").collect()) == [("k", x) for x in "abcd"] + [("l", "a"), ("l", "b")]


def test_lists_between_stops(spark, monkeypatch):
    """Places by stops and stops of stops are those of a walk; so is a circle told from a list."""
    monkeypatch.setattr(history, "_WALK", 20)
    rng = random.Random(4)
    names = rng.sample([f"{x:06x}" for x in range(10**6)], 1500)
    starts = sorted(rng.sample(range(1500), 9)) + [1500]
    rows = [(names[i], names[i - 1]) for i in range(1500) if i not in starts and i > starts[0]]
    want = {(names[i], names[a], i - a) for a, b in zip(starts, starts[1:]) for i in range(a, b)}
    lone = spark.createDataFrame([(names[a],) for a in starts[:-1]], "id string")
    places, crossing = history.laid_out(spark.createDataFrame(rows, "id string, parent string"), lone)
    assert {(r["id"], r["chain"], r["place"]) for r in places.collect()} == want and crossing.isEmpty()
    with pytest.raises(ValueError, match="circle"):
        history.laid_out(spark.createDataFrame([*rows, *[(f"x{i}", f"x{(i + 1) % 90}") for i in range(90)]], "id string, parent string"))


def test_a_line_of_orders_is_one_chain(spark, monkeypatch):
    """The history of the query has four lines and a few rounds, whatever its merges are."""
    from driftwell.plans import scans

    seen, rounds = [], []
    laid_out, written = history.laid_out, history.written
    monkeypatch.setattr(history, "laid_out", lambda *a: seen.append(laid_out(*a)) or seen[-1])
    monkeypatch.setattr(history, "written", lambda df, label: rounds.append(label) or written(df, label))
    scans.history_drift(spark, "/root/testdata/sf0.001").collect()
    assert seen[0][0].select("chain").distinct().count() == 4 and rounds.count("front") < 12
