"""One sound and one broken case for each check; state, regions, merges and sinks on literal rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftwell.functions import text as fn
from driftwell.operators import events, merge, migrate, regions, relational, report, rosters, sessions, textscan
from driftwell.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parity_and_roster(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert rows(relational.parity(a, b, "k")) == [("x", "left_only"), ("z", "right_only")]
    assert rows(relational.parity(a, a, "k")) == []
    assert rows(relational.roster(a.union(a), b, "k")) == [("x", "duplicate"), ("x", "unknown"), ("y", "duplicate"), ("z", "missing")]
    assert rows(relational.partition_check(b, b, "k")) == []
    assert rows(relational.symmetric_difference(a, b)) == [("x",), ("z",)]


def test_upsert_first_top(spark):
    user = spark.createDataFrame([("A", "1"), ("b", "2"), ("u", "9")], "k string, v string")
    framework = spark.createDataFrame([("a", "5"), ("B", "2"), ("c", "3")], "k string, v string")
    assert rows(relational.upsert(user, framework, "k", "v")) == [("a", "1", "kept"), ("b", "2", "identical"), ("c", "3", "added"), ("u", "9", "user_only")]
    assert relational.first_existing(spark.createDataFrame([("m", 2), ("o", 1)], "n string, r int"), spark.createDataFrame([("m",)], "n string"), "n", "r").collect()[0][0] == "m"
    assert [r["more"] for r in relational.top_and_rest(framework, ["k"], 2).collect()] == [1, 1]
    named = spark.createDataFrame([("Foo", 1), ("foo", 2)], "n string, o int")
    assert rows(relational.first_by_name(named, spark.createDataFrame([("FOO",)], "n string"), "n", "o")) == [("Foo", 1)]


def test_lines_and_headers(spark):
    df = spark.createDataFrame([(1, "# a\r\nx\ny\n"), (2, ""), (3, None)], "id int, text string")
    ls = textscan.lines(df)
    assert rows(ls) == [(1, 1, "# a"), (1, 2, "x"), (1, 3, "y")]
    got = relational.carry_header(ls, "id", "line_no", F.when(F.startswith("line", F.lit("#")), F.col("line")))
    assert [r["section"] for r in got.orderBy("line_no").collect()] == ["# a"] * 3


@pytest.mark.parametrize(("line", "rule"), [('token = "abcdefgh1"', "generic"), ("token = \"your-api-key-1\"", None), ('key: "$abcdefghi"', None), ("AKIA" + "A1" * 8, "access-key-id"), ("ghp_" + "a" * 36, "hosted-git-token"), ("-----BEGIN EC PRIVATE KEY-----", "private-key"), ("redis://u:p@h", "connection-string"), ("plain words", None)])
def test_secrets(spark, line, rule):
    got = textscan.secrets(spark.createDataFrame([(line,)], "line string")).collect()
    assert [r["rule"] for r in got] == ([rule] if rule else [])


def test_stated_numbers_and_shapes(spark):
    df = spark.createDataFrame([("20 specialized agents, 3 hooks",), ("grep '9 hooks'",), ("Total Hooks:** 4",)], "line string")
    assert sorted((r["stated"], r["what"]) for r in textscan.stated_numbers(df, {"agents": 21, "hooks": 3}).collect()) == [(4, "hooks"), (20, "agents")]
    args = spark.createDataFrame([(["-y", "a", "b"],), (["-y", "a"],), (None,)], "a array<string>")
    assert [r[0] for r in args.select(textscan.shape_matches(F.col("a"), ["-y", None, "b"])).collect()] == [True, False, False]
    paths = spark.createDataFrame([("C:\\Keep\\x",), ("c:/keeper",)], "p string")
    assert [r[0] for r in paths.select(textscan.under(F.col("p"), ["c:/keep"])).collect()] == [True, False]
    assert rows(textscan.required(spark.createDataFrame([("a.md", "one")], "path string, text string"), [("a.md", "one", "x"), ("a.md", "two", "y"), ("b.md", "one", "z")]).select("label")) == [("y",), ("z",)]


def test_regions(spark):
    cases = {"a<B>x<E>b": None, "x<E>": "missing-begin", "<B>x": "missing-end", "<B><B>x<E>": "duplicate-begin", "<E>x<B>": "misordered"}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", regions.region_problem(F.col("t"), "<B>", "<E>")).collect()} == cases
    new = df.where("t = 'a<B>x<E>b'").select(regions.replaced(F.col("t"), "<B>", "<E>", F.lit("y")).alias("t"))
    assert new.select(F.col("t"), regions.replaced(F.col("t"), "<B>", "<E>", F.lit("y"))).collect()[0][:] == ("a<B>y<E>b", "a<B>y<E>b")
    ls = textscan.lines(spark.createDataFrame([(1, "a\nBEGIN\nx\ny\nEND\nb")], "id int, text string"))
    assert sorted(r["line"] for r in regions.inside_lines(ls, "id", "BEGIN", "END").collect()) == ["x", "y"]


def test_frontmatter(spark):
    df = spark.createDataFrame([("---\nname: 'a-b' # note\ntools: [x, y z]\nempty:\n---\nname: no\n",), ("no block",), ("---\nname: x\n",)], "t string")
    block = regions.frontmatter(F.col("t"))
    got = df.select(regions.front_value(block, "name"), regions.front_list(regions.front_value(block, "tools")), regions.front_value(block, "empty"), regions.front_value(block, "gone"), regions.frontmatter_problem(F.col("t"))).collect()
    assert got[0][:] == ("a-b", ["x", "y", "z"], "", None, None)
    assert [r[4] for r in got[1:]] == ["missing-frontmatter", "unterminated-frontmatter"]


EVENTS = [
    (1, "s", 1, "review", None, None, None), (2, "s", 2, "stop", None, None, None), (3, "s", 3, "review", "CHANGES_REQUIRED", "i1", "h1"), (4, "s", 4, "stop", None, None, None),
    (5, "s", 5, "review", "CHANGES_REQUIRED", "i1", "h1"), (6, "s", 6, "review", "CHANGES_REQUIRED", "i1", "h2"), (7, "s", 7, "review", "APPROVED", None, "h2"), (8, "s", 8, "review", "APPROVED", None, None),
    (9, "s", 9, "review", None, None, "h3"), (10, "s", 10, "review", "APPROVED", None, "h3"), (11, "s", 11, "stop", None, None, None), (12, "!!", 1, "stop", None, None, None), (13, "t", 1, "stop", None, None, None), (14, "t", 2, "stop", None, None, None),
]
SCHEMA = "event_id long, session string, ts int, kind string, verdict string, instance string, head string"
ACTIONS = {1: "write", 2: "allow", 3: "write", 4: "block", 5: "instance-dedupe", 6: "write", 7: "same-head-approve", 8: "same-head-approve", 9: "keep", 10: "write", 11: "allow", 13: "block", 14: "allow"}


def test_fold(spark):
    got = {r["event_id"]: r["action"] for r in sessions.fold(spark.createDataFrame(EVENTS, SCHEMA)).collect()}
    assert got == ACTIONS


def test_text_of_response_and_hints(spark):
    docs = ['"a"', '["a", {"text": "b"}, 3]', '{"content": [{"text": "c"}, "d"]}', "7"]
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    assert [r[0] for r in df.select(sessions.text_of(F.parse_json("j"))).collect()] == ["a", "a\nb", "c\nd", None]
    said = spark.createDataFrame([("x\n VERDICT: APPROVED\r\nVERDICT: CHANGES_REQUIRED  \nsee VERDICT: APPROVED here",), ("none",)], "t string")
    assert [r[0] for r in said.select(sessions.verdict_of(F.col("t"))).collect()] == ["CHANGES_REQUIRED", None]
    ev = spark.createDataFrame([("s", "a/b.PY", 1), ("s", "c.py", 2), ("s", "d.tsx", 3), ("s", "e.txt", 4)], "s string, p string, o int")
    assert sorted((r["agent"], r["o"]) for r in sessions.hints(ev, "s", "p", ["o"]).collect()) == [("python-expert", 1), ("typescript-expert", 3)]


def test_merge(spark):
    assert merge.expand("${A}/${B:-d}/${C}/${D:-${A}}", {"A": "1"}) == "1/d//1"
    df = spark.createDataFrame([('{"b": ["${A}"], "a": 1}',), ("{bad",)], "j string")
    assert [r[0] for r in df.select(merge.canonical(merge.expanded(F.col("j"), {"A": "x"}))).collect()] == ['{"a":1,"b":["x"]}', None]
    hooks = {"Stop": [{"matcher": None, "hooks": [{"type": "command", "command": "sh /x/old.sh", "timeout": 1}]}], "PreToolUse": [{"matcher": "m", "hooks": [{"type": "command", "command": "mine", "timeout": 1}]}]}
    h = spark.createDataFrame([(json.dumps({"hooks": hooks}),)], "text string").select(F.from_json("text", files.HOOKS)["hooks"].alias("h"))
    assert list(h.select(merge.without_hooks(F.col("h"), lambda c: merge.names_script(c, ["old.sh"]))).collect()[0][0]) == ["PreToolUse"]
    env = spark.createDataFrame([({"a": "1", "b": "${X}"},), ({"b": "${X}"},)], "e map<string,string>")
    assert [r[0] for r in env.select(merge.resolved_env(F.col("e"))).collect()] == [{"a": "1"}, None]


def test_hook_problems(spark):
    reg = json.dumps({"hooks": {"Stop": [{"hooks": [{"type": "command", "command": 'sh "x/dispatch.sh" one || pwsh x/one.ps1', "timeout": 5}]}]}})
    good = [("one.ps1", "#Requires -Version 7.0\n"), ("one.sh", "#!/bin/sh\nset -u\n"), ("dispatch.sh", "#!/bin/sh\nset -u\ncase x in\n  one|two) ;;\nesac\n")]
    f = spark.createDataFrame([(reg,)], "text string")
    found = lambda s, j=f: sorted(tuple(r) for r in files.hook_problems(j, spark.createDataFrame(s, "name string, text string")).collect())
    assert found(good) == []
    bad = [("two.ps1", "x"), ("two.sh", "x"), ("dispatch.sh", "#!/bin/sh\nset -u\n")]
    assert {t for t, _ in found(bad)} == {"missing-hook-script", "orphan-hook-script", "missing-sh-impl", "orphan-sh-script", "missing-requires-ps7", "missing-sh-shebang", "missing-set-u", "missing-dispatch-allowlist"}
    odd = spark.createDataFrame([(reg.replace("Stop", "Sometimes").replace("one.ps1", "three.ps1"),)], "text string")
    assert {"invalid-hook-event", "chain-name-mismatch"} <= {t for t, _ in found(good, odd)}
    assert ("no-hooks-block", "hooks.json") in found(good, spark.createDataFrame([('{"hooks": {}}',)], "text string"))


def test_registry(spark):
    doc = {"sub_agents": {"b": {"model": "m", "focus": "f", "enabled": True}}, "agent_categories": {"c": ["b", "x"]}, "consistency": {"model_shorthand_map": {"m": "long"}}}
    reg = files.registry(spark.createDataFrame([("p", json.dumps(doc))], "path string, text string"))
    assert rows(files.agents(reg)) == [("b", "m", "f", True)]
    assert rows(files.categories(reg)) == [("c", "b"), ("c", "x")]
    assert files.deprecated(reg).count() == 0
    assert files.shorthand(reg, "m").collect()[0][0] == "long" and files.shorthand(reg, "z").collect()[0][0] is None
    with pytest.raises(ValueError):
        files.shorthand(reg, "")


def test_files_and_sinks(spark, tmp_path):
    for name, t in (("a.md", "x\r\n"), ("b.json", "{}"), ("c.json", "{")):
        (tmp_path / name).write_bytes(t.encode())
    got = files.texts(spark, str(tmp_path))
    assert rows(got.select("name", "text")) == [("a.md", "x\n"), ("b.json", "{}"), ("c.json", "{")]
    assert files.invalid_json(files.texts(spark, str(tmp_path), "*.json")).count() == 1
    files.write_text(str(tmp_path / "o"), "a\r\nb")
    assert (tmp_path / "o").read_bytes() == b"a\nb"
    assert files.backup(str(tmp_path / "o"), dt.datetime(2024, 1, 2, 3, 4, 5)).endswith("o.bak-20240102-030405")


def test_reports(spark):
    p = report.problems(spark.createDataFrame([("x",)], "s string"), 1, F.lit("t"), "s")
    one = spark.range(1)
    assert report.verdict(p, one).collect()[0]["verdict"] == "FAIL"
    assert report.verdict(p.limit(0), one).collect()[0]["verdict"] == "PASS"
    assert report.verdict(p.limit(0), one.limit(0)).collect()[0]["verdict"] == "EMPTY"
    with pytest.raises(ValueError):
        report.selected([])
    s = spark.createDataFrame([("a", 1, 50), ("a", 2, 52), ("b", 1, 95), ("c", 1, 10), ("c", 2, 20), ("c", 3, 30)], "k string, o int, s int")
    assert sorted((r["k"], r["iteration"], r["reason"]) for r in report.plateau(s, "k", ["o"], "s").collect()) == [("a", 2, "plateau"), ("b", 1, "enough"), ("c", 3, "limit")]


def test_scalars(spark):
    df = spark.createDataFrame([(" 7\t", "", "b", "A\\b.TXT")], "c string, e string, f string, p string")
    r = df.select(fn.counter(F.col("c")), fn.counter(F.col("e")), fn.first_filled(F.col("e"), F.col("f")), fn.basename(F.col("p")), fn.extension(F.col("p"))).collect()[0]
    assert r[:] == (7, 1, "b", "b.TXT", ".txt")


def test_more_sinks_and_sources(spark, tmp_path):
    log = tmp_path / "log"
    for i in range(2):
        files.append_rows(spark.range(i, i + 1), str(log))
    assert sorted(r["id"] for r in spark.read.json(str(log)).collect()) == [0, 1]
    files.append_line(str(tmp_path / "l"), "a\n")
    files.append_line(str(tmp_path / "l"), "b")
    assert (tmp_path / "l").read_bytes() == b"a\nb\n"
    files.write_verified(str(tmp_path / "v.json"), {"b": [1, {"c": None}], "a": "é"})
    with pytest.raises(ValueError, match="read back"):
        files.write_verified(str(tmp_path / "v.json"), {1: "keys become text", "1": "twice"})
    assert json.loads((tmp_path / "v.json").read_text()) == {"b": [1, {"c": None}], "a": "é"} and not list(tmp_path.glob("*.tmp.*"))
    assert files.optional_text(spark, str(tmp_path / "gone")).count() == 0 and files.optional_text(spark, None).count() == 0
    assert files.first_root(None, str(tmp_path / "gone"), str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        files.first_root(None)
    bad = files.invalid_yaml(spark.createDataFrame([("x", "a: [1")], "path string, text string")).collect()
    assert [r["problem"] for r in bad] in (["invalid"], ["skipped"])


def test_git(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    assert files.tracked_files(spark, str(tmp_path)).count() == 0
    assert not files.git_facts(spark, str(tmp_path)).collect()[0]["in_tree"]
    git("init", "-q", "-b", "main")
    (tmp_path / "a b.txt").write_text("1")
    git("add", ".")
    git("commit", "-qm", "one")
    git("checkout", "-qb", "feature/x")
    git("commit", "-q", "--allow-empty", "-m", "two")
    facts = files.git_facts(spark, str(tmp_path))
    assert facts.select(files.gate_open(facts)).collect()[0][0] and facts.collect()[0]["ahead"] == 1
    assert files.context_line(facts).collect()[0][0] == "Git: branch feature/x, 1 commit(s) ahead of main, clean"
    assert rows(files.tracked_files(spark, str(tmp_path))) == [("a b.txt",)]
    (tmp_path / "new").write_text("1")
    dirty = files.git_facts(spark, str(tmp_path))
    assert not dirty.select(files.gate_open(dirty)).collect()[0][0]


def test_long_unterminated_frontmatter(spark):
    text = "---\n" + "key: value\n" * 50_000
    df = spark.createDataFrame([(text,), (text + "---\n",), ("---",), (None,), ("---\n---\nx",), ("\ufeff--- \t\r\na: 'b'#c\r\n---",)], "t string")
    got = df.select(regions.frontmatter_problem(F.col("t")), F.length(regions.frontmatter(F.col("t"))), regions.front_value(regions.frontmatter(F.col("t")), "a")).collect()
    assert [tuple(r) for r in got] == [("unterminated-frontmatter", None, None), (None, len(text) - 4, None), ("unterminated-frontmatter", None, None), ("missing-frontmatter", None, None), (None, 0, None), (None, 9, "b")]


def test_counts_and_orders(spark):
    counts = spark.createDataFrame([("a", 2)], "key string, n int")
    assert report.count_of_key(counts, "a") == 2
    with pytest.raises(KeyError):
        report.count_of_key(counts, "b")
    paths = spark.createDataFrame([("a",), ("a/b/c",), ("a/b",)], "path string")
    assert [r[0] for r in migrate.children_first(paths).collect()] == ["a/b/c", "a/b", "a"]
    v = spark.createDataFrame([('{"s": " ", "t": "x", "o": {}, "p": {"q": 1}, "f": false}',)], "j string").select(F.parse_json("j").alias("v"))
    flags = [fn.text_field(F.col("v"), "$.s"), fn.text_field(F.col("v"), "$.t"), fn.text_field(F.col("v"), "$.p"), fn.filled_object(F.col("v"), "$.o"), fn.filled_object(F.col("v"), "$.p"), fn.filled_object(F.col("v"), "$.t"), events.or_default(events.field("f", "boolean"), True)]
    assert list(v.select(*flags).collect()[0]) == [False, True, False, False, True, False, True]
    assert rosters.whole_file_model(F.lit("x")) is not None
    model = spark.createDataFrame([("x\nmodel: 'big' \n",), ("none",)], "t string")
    assert [r[0] for r in model.select(rosters.whole_file_model(F.col("t"))).collect()] == ["big", None]


def test_broken_payloads(spark):
    raw = [(1, ""), (2, None), (3, "{"), (4, "[1]"), (5, '"x"'), (6, '{"session_id": "s", "hook_event_name": "Stop", "stop_hook_active": true}'), (7, '{"hook_event_name": "Stop"}'), (8, '{"session_id": "s", "hook_event_name": "Stop"}')]
    df = spark.createDataFrame([(i, i, p) for i, p in raw], "event_id long, ts int, payload string")
    facts = spark.createDataFrame([("/w", "h", True)], "cwd string, head string, ok boolean")
    got = events.to_fold(df, facts, F.col("ok")).collect()
    assert sorted((r["event_id"], r["continuation"], r["facts_ok"]) for r in got) == [(6, True, False), (8, False, False)]
