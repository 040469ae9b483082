"""Conversation repair, source mixing and the prefix trie against brute force, with nulls, ties, repeats, clashing names and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftwell.llm import conversation_repair as repair
from driftwell.llm import mixing, queries
from driftwell.llm.prefix_trie import shared_starts, trie, turns_in_order
from driftwell.llm.streamed import digests

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- structure repair


def brute(symbols):
    """Cheapest edits, then least labels, by trying all label strings with at most two inserts in a row."""
    best = None
    options = [""] + ["I" * n + x for x in "KRD" for n in range(3)]
    for combo in itertools.product(options[1:], repeat=len(symbols)):
        for tail in ("", "I", "II"):
            g, cost, ok = 0, 0, True
            for x, labels in [*zip(symbols, combo, strict=True), (None, tail)]:
                for label in labels:
                    expected = {0: "u", 1: "u", 2: "a", 3: "u"}[g]
                    extra = 3 if x and x.isupper() and label in "KR" else 0
                    if label == "I":
                        g, cost = {"u": 2, "a": 3}[expected], cost + 3
                    elif label == "D":
                        cost += 4
                    elif x == "x":
                        ok = False
                    elif label == "R":
                        g, cost = {"u": 2, "a": 3}[expected], cost + 3 + extra
                    elif x.lower() == expected or (g == 0 and x.lower() == "s"):
                        g, cost = {"s": 1, "u": 2, "a": 3}[x.lower()], cost + extra
                    else:
                        ok = False
            if ok and g in (0, 3) and (best is None or (cost, "".join(combo) + tail) < best):
                best = (cost, "".join(combo) + tail)
    return best


def test_shortest_path_equals_brute_force():
    for n in range(4):
        for symbols in itertools.product("suaoSUAOx", repeat=n):
            if n == 3 and zlib.crc32("".join(symbols).encode()) % 3:
                continue
            cost, labels, end, own = repair.shortest("".join(symbols))[0]
            assert (cost, labels) == brute(symbols) and own == cost and end in (0, 3), symbols


def plain_summary(rows):
    """rows of one conversation after damage, in order: what the operator should say of them."""
    seen, symbols, faults = set(), "", []
    for turn, role, text in rows:
        fault = None
        if not WORD.search(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif WORD.findall(text)[-1][-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        first = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += "x" if fault in ("blank", "duplicate") else first.upper() if fault else first
        faults.append(fault)
    cost, labels, _, _ = repair.shortest(symbols)[0]
    lines, i, g = [], 0, 0
    for x in labels:
        want = {0: "user", 1: "user", 2: "assistant", 3: "user"}[g]
        role = rows[i][1] if x == "K" else want
        if x != "D":
            lines.append(role + ":" + ("" if x == "I" else rows[i][2]))
            g = {"s": 1, "u": 2, "a": 3}[role[0]]
        i += x != "I"
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, labels, sha("\n".join(lines))


TEXTS = ["Yes.", "Why?", "so it", "", " \n\t", "Done!\x0b ", "é ", "Yes. ", None, "x" * 5000]


def some_turns(seed, n, convs):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((rng.choice(convs), rng.choice([i, i, i, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(TEXTS)))
    return rows


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_repair_equals_plain_version(spark, bits, monkeypatch):
    """With blocks of two and four turns every conversation crosses blocks."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = some_turns(4, 400, [1, 2, 3, None, *range(10, 40)])
    df = spark.createDataFrame([(*r, 5, "s") for r in rows], "conv_id long, turn long, role string, text string, block int, symbol string").repartition(5)
    diagnosed = repair.diagnosed(df)
    found = repair.scripts(diagnosed)
    want = defaultdict(list)
    for r in sorted(diagnosed.collect(), key=lambda r: r.at):
        want[r.conv_id].append((r.turn, r.role, r.text))
    assert sum(map(len, want.values())) == len(rows)
    for turns in want.values():
        assert [t[0] for t in turns] == sorted((t[0] for t in turns), key=lambda t: (t is not None, t or 0))
    kept = repair.repaired(diagnosed, found).where("edit <> 'D'")
    hashes = {r.conv_id: r.sha256 for r in digests(kept.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line")), ["conv_id"], "place", "line", "\n").collect()}
    told = {r.conv_id: r for r in repair.summary(diagnosed, found).collect()}
    assert set(told) == set(want)
    for c, turns in want.items():
        r = told[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(c, sha(""))) == plain_summary(turns), c


def test_a_long_conversation_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 6)
    rng = random.Random(8)
    rows = [("c", i, rng.choice(["user", "assistant", "system"]), f"{i} {rng.choice('.!?,')}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    diagnosed = repair.diagnosed(df)
    got = repair.summary(diagnosed, repair.scripts(diagnosed)).collect()
    want = plain_summary([r[1:] for r in rows])
    assert [(r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in got] == [want[:-1]]


def plain_damage(rows):
    out = []
    said = lambda x: " " if x is None else str(x)
    for c, turn, role, text in rows:
        d = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(c, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def test_op11_on_damaged_turns(spark, tmp_path):
    rows = [(c, t, r, x + str(t) if x and x.strip() else x) for c, t, r, x in some_turns(5, 500, list(range(60)))]
    rows = [(c, i, r, x) for i, (c, _, r, x) in enumerate(rows)]  # turns without ties
    rows += [(900 + k, 0, "user", "Hm.") for k in range(40)]  # some lose their only turn
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = defaultdict(list)
    for c, t, r, x in sorted(plain_damage(rows), key=lambda r: (r[0], r[1])):
        want[c].append((t, r, x))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} and len(got) > len(want)
    for c, r in got.items():
        assert r == (plain_summary(want[c]) if c in want else (0, 0, 0, 0, 0, 0, "", sha("")))


def test_repair_of_nothing(spark):
    rows = repair.diagnosed(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    found = repair.scripts(rows)
    assert repair.summary(rows, found).collect() == [] and repair.repaired(rows, found).collect() == []


def test_digests_stream_in_order(spark, monkeypatch):
    from driftwell.llm import streamed

    monkeypatch.setattr(streamed, "PIECE", 50)
    rows = [(i % 3 if i % 3 else None, i) for i in range(500)]
    got = {r.k: r.sha256 for r in digests(spark.createDataFrame(rows, "k int, i long").repartition(6), ["k"], "i").collect()}
    assert got == {k: sha(",".join(str(i) for j, i in rows if j == k)) for k in (None, 1, 2)}


# ---- mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return full
        left, ws = total - sum(full.values()), sum(w[s] for s in rest)
        above = [s for s in rest if left * w[s] / ws >= most * sizes[s]]
        if not above:
            return {**full, **{s: left * w[s] / ws for s in rest}}
        full.update({s: most * sizes[s] for s in above})


def mixed(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, source string, size int, hash string, target double").repartition(4)
    return mixing.mix(df, **more).collect()


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    names = [None, "", "b", "a", "Z", "é", "z1", "z2"]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice([*names, "a", "a", "a"])) for i in range(3000)]
    rows += [(9000, "word\t" * 4000, "a"), (9001, None, "b"), (None, "x y", "b"), (9002, "one", "lonely"), (9003, None, "wordless")]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    got = mixed(spark, rows)
    assert sorted((r.id is None, r.id or 0, r.size) for r in got) == sorted((i is None, i or 0, len(WORD.findall(t or ""))) for i, t, _ in rows)
    taken, most = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6, s
    assert got != [] and sorted(map(str, got)) == sorted(map(str, mixed(spark, rows)))


def test_larger_budgets_take_what_smaller_ones_take(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 2}") for i in range(800)]
    less, more = ({r.id: r.copies for r in mixed(spark, rows, weights=(1,), share=s)} for s in (0.3, 0.6))
    # but for the one document at the threshold, which is taken by what is nearer
    assert sum(more[i] < n for i, n in less.items()) <= 1 and sum(less.values()) < sum(more.values())


def test_equal_rows_are_taken_as_the_budget_holds(spark):
    rows = [(1, "a b c", "s")] * 1000 + [(2, "d e", "t")] * 10
    got = Counter()
    for r in mixed(spark, rows, weights=(1,), share=0.5):
        got[r.source, r.copies] += 1
    want = plain_targets({"s": 3000, "t": 20}, (1,), 0.5)
    assert abs(3 * (got["s", 1] + 2 * got["s", 2]) - want["s"]) <= 1.5 and abs(2 * (got["t", 1] + 2 * got["t", 2]) - want["t"]) <= 1


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == []
    assert [(r.size, r.target, r.copies) for r in mixed(spark, [(1, None, None), (2, " \n", None)])] == [(0, 0.0, 0)] * 2


# ---- prefix trie


def plain_trie(rows, every=20, most=4):
    turns = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns[c].append((r or "", x or ""))
    nodes = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        path = turns.get(c - c % every, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append((c, d == len(path)))
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    low = {k: min(c for c, _ in v) for k, v in nodes.items()}
    sums = {}
    for k in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        sums[k] = (sum(sums[x][0] for x in kids[k]) or (not kids[k]), saved + sum(sums[x][1] for x in kids[k]))
    return {(low[k], len(k)): (low[k[:-1]] if k else None, len(v), len(kids[k]), *map(int, sums[k]), sha(",".join(str(c) for c in sorted(c for c, end in v if end)))) for k, v in nodes.items()}


def trie_rows(spark, rows, **columns):
    df = spark.createDataFrame([(*r, 3, "d") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string").repartition(4)
    got = trie(shared_starts(turns_in_order(df), **columns)).collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in got}
    assert len(out) == len(got)
    return out


def test_trie_equals_plain_version(spark):
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 90), 140, 141, 1000]:
        kind = rng.randrange(4)
        for i in range(rng.randrange(1, 9)):
            rows.append((c, None if i == 0 else i, "user" if i % 2 == 0 else rng.choice(["assistant", None]), rng.choice(["a b", "", None, "c"]) if kind else "all the same"))
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_staircase_of_chains(spark):
    """Each conversation ends one turn deeper than the one before, so the chains hang one from the other; another shares a start of each."""
    rows = []
    for c in range(40):
        rows += [(c, i, "u", f"t{i}") for i in range(c)] + [(c, 1000, "a", f"own {c}")]
    assert trie_rows(spark, rows, every=1, most=1) == plain_trie(rows, 1, 1)


def test_copies_and_turnless_conversations(spark):
    rows = [(c, 0, "u", "same words here") for c in range(300, 700)]
    got = trie_rows(spark, rows)
    assert got == plain_trie(rows) and len(got) <= 5
    assert trie_rows(spark, []) == {}
    assert trie_rows(spark, [(None, 1, "u", "x")]) == {}


# ---- quality: what reaches the driver


def test_long_texts_reach_the_driver_in_blocks(spark):
    """Texts of a megabyte are cut and measured in tasks; the driver trains on a bounded number of blocks."""
    from driftwell.llm import quality
    from driftwell.llm.labelled import training_sample

    rng = random.Random(1)
    words = [["alpha beta gamma delta"] * 3 + ["clean prose"], ["xx zz qq", "##", "buy now"]]
    long = lambda y: " ".join(rng.choice(words[y]) + str(rng.randrange(99)) for _ in range(70_000))
    docs = spark.createDataFrame([(i, long(i % 2)) for i in range(24)], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(24)], "doc_id long, quality int")
    sample = training_sample(docs, labels, "quality").persist()
    for y in (0, 1):
        got = quality._blocks(sample, y, 50)
        assert len(got) == 50 and max(map(len, got)) <= quality.TRAIN_BLOCK
    rows = quality._measured(sample, b"x" * 100, b"y" * 100)
    assert rows and all(len(r) == 8 for r in rows)
    sample.unpersist()
    model = quality.train(docs, labels, blocks=400)
    assert all(r["predicted"] == 1 - r["doc_id"] % 2 for r in quality.score(docs, model).select("doc_id", "predicted").collect())
