"""Registered queries over literal records of a small made-up project, and over texts built from the tables; with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import text as fn
from driftwell.operators import documents, events, history, merge, migrate, policy, regions, relational, report, rosters, sessions, textscan
from driftwell.plans.registry import query, table, values
from driftwell.sources import files

REGISTRY = {
    "version": "1.2.0", "description": "A 3-agent kit, once a 12-agent kit",
    "consistency": {"deprecated_agent_names": ["old-hand"], "model_shorthand_map": {"big": "model-big"}, "doc_blocks": {"list_agents_summary_categories": {"Core": ["core", "gone"], "Extra": ["extra"]}}},
    "sub_agents": {"rust-expert": {"enabled": True, "model": "model-big", "focus": "Rust"}, "sql-expert": {"enabled": False, "model": "model-small", "focus": "SQL"}, "doc-writer": {"enabled": True, "model": "model-big", "focus": ""}},
    "agent_categories": {"core": ["rust-expert", "sql-expert"], "extra": ["doc-writer"]},
}
HOOKS = {"hooks": {
    "Stop": [{"hooks": [{"type": "command", "command": 'sh "x/dispatch.sh" one || pwsh x/one.ps1', "timeout": 5}]}],
    "Sometimes": [{"matcher": "m", "hooks": [{"type": "command", "command": 'sh "x/dispatch.sh" two || pwsh x/three.ps1', "timeout": 5}, {"type": "command", "command": "sh x/lone.sh", "timeout": 5}]}],
}}
SCRIPTS = [("one.ps1", "#Requires -Version 7.0\n"), ("four.ps1", "x\n"), ("one.sh", "#!/bin/sh\nset -u\n"), ("five.sh", "echo\n"), ("dispatch.sh", "#!/bin/sh\nset -u\ncase x in\n  one|six) ;;\nesac\n")]
TREE = [
    ("README.md", "# Kit\n| **not-here** | x |\n## Agents\n| **rust-expert** | Rust |\n| **sql-expert** | Sequel |\n| **sql-expert** | SQL |\n| **doc-writer** | Docs |\n| **who-else** | ? |\n## Next\n| **rust-expert** | no |\nDelegate every shell call\n"),
    ("commands/list.md", "┌──┐\n│ Agent │ x │\n│ rust-expert │ x │\n│ sql-expert │ y │\n└──┘\n┌──┐\n│ doc-writer │ z │\n└──┘\nTotal: 3 agents\n### Core (2 agents)\nrust-expert -> a\nsql-expert -> b\n### Extra (2 agents)\n```\ndoc-writer -> c\n```\n"),
    ("skills/flat.md", "name: flat\n"), ("skills/good/SKILL.md", "---\nname: good\ndescription: Does good\n---\n"), ("skills/bad/SKILL.md", "---\nname: other\ndescription:\n---\n"), ("skills/none/notes.md", "x\n"),
    ("docs/old.md", "a blanket rule\n"), (".gitignore", "*.credentials\n"), ("sub/.env", "A=1\n"), ("ci.yml", "on: push\njobs:\n  build:\n    steps: 1\n  test:   \n  lint: x\nother:\n  no:\n"),
    ("plugin.json", '{"name": "kit", "version": "1.2.0", "description": "A kit"}'), ("sub/plugin.json", '{"name": "Kit Two", "version": "1.3.0", "description": " ", "extra": 1, "root": "/home/me"}'),
    ("market.json", '{"plugins": [{"name": "kit", "source": "./"}, {"name": "b", "source": "./sub"}, {"name": "c", "source": "./gone"}]}'), ("broken.json", "{"),
]


def _tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TREE, "path string, text string")


def _file(spark: SparkSession, path: str) -> DataFrame:
    return _tree(spark).where(F.col("path") == path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return textscan.lines(_file(spark, path))


def _registry(spark: SparkSession) -> DataFrame:
    return files.registry(spark.createDataFrame([("r", json.dumps(REGISTRY))], "path string, text string"))


def _hooks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(json.dumps(HOOKS),)], "text string")


@query(values("fact VARCHAR, name VARCHAR, value VARCHAR", [
    ("agent", "doc-writer", "model-big"), ("agent", "rust-expert", "model-big"), ("agent", "sql-expert", "model-small"), ("category", "core", "rust-expert"), ("category", "core", "sql-expert"), ("category", "extra", "doc-writer"),
    ("deprecated", "old-hand", None), ("shorthand", "big", "model-big"), ("shorthand", "none", None), ("size", "Core", "2"), ("size", "Extra", "1"), ("keys", "0", "version"), ("keys", "1", "description"), ("keys", "2", "consistency"), ("keys", "3", "sub_agents"), ("keys", "4", "agent_categories"),
    ("version", "found", "1.2.0"), ("version", "default", "0.0.0"), ("states", "3-agent", "true"), ("states", "1-agent", "false"), ("other", "all", "3-agent,12-agent"), ("pruned", "keys", "agent_categories,description,sub_agents,version"), ("pruned", "raw", "{"),
]))
def registry_facts(spark, d):
    reg, raw = _registry(spark), spark.createDataFrame([(json.dumps(REGISTRY),)], "t string")
    rows = lambda df, kind, n, v: df.select(F.lit(kind).alias("fact"), n.cast("string").alias("name"), v.cast("string").alias("value"))
    keys = raw.select(F.posexplode(files.keys_in_order(F.col("t"))).alias("i", "k"))
    about = raw.select(F.get_json_object("t", "$.description").alias("s"), "t")
    parts = [
        rows(files.agents(reg), "agent", F.col("name"), F.col("model")), rows(files.categories(reg), "category", F.col("category"), F.col("name")), rows(files.deprecated(reg), "deprecated", F.col("name"), F.lit(None)),
        rows(files.shorthand(reg, "big"), "shorthand", F.lit("big"), F.col("value")), rows(files.shorthand(reg, "none"), "shorthand", F.lit("none"), F.col("value")), rows(documents.group_sizes(reg), "size", F.col("label"), F.col("n")),
        rows(keys, "keys", F.col("i"), F.col("k")), rows(raw, "version", F.lit("found"), fn.version(F.col("t"))), rows(raw, "version", F.lit("default"), fn.version(F.lit("{}"))),
        rows(about, "states", F.lit("3-agent"), policy.states_count(F.col("s"), F.lit(3))), rows(about, "states", F.lit("1-agent"), policy.states_count(F.col("s"), F.lit(1))), rows(about, "other", F.lit("all"), policy.other_counts(F.col("s"))),
        rows(raw, "pruned", F.lit("keys"), F.array_join(F.array_sort(F.json_object_keys(policy.pruned(F.col("t"), "consistency"))), ",")), rows(raw, "pruned", F.lit("raw"), policy.pruned(F.lit("{"), "x")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(values("type VARCHAR, subject VARCHAR", [
    ("missing-hook-script", "three.ps1"), ("orphan-hook-script", "four.ps1"), ("missing-sh-impl", "two.sh"), ("orphan-sh-script", "five.sh"), ("missing-dispatch-sh", "dispatch.sh"), ("invalid-hook-event", "Sometimes"),
    ("missing-requires-ps7", "four.ps1"), ("missing-sh-shebang", "five.sh"), ("missing-set-u", "five.sh"), ("missing-dispatch-allowlist", "two.sh"), ("chain-name-mismatch", "two"),
]))
def hook_battery(spark, d):
    return files.hook_problems(_hooks(spark), spark.createDataFrame(SCRIPTS, "name string, text string"))


@query(values("kind VARCHAR, name VARCHAR", [("command", "lone.sh"), ("twice", "one"), ("pair", "one.ps1"), ("entries", "3"), ("first-line", "five.sh"), ("prefix", "dispatch.sh"), ("prefix", "one.sh"), ("allowed", "one")]))
def hook_scripts(spark, d):
    cmds, scripts = files.commands(_hooks(spark)), spark.createDataFrame(SCRIPTS, "name string, text string")
    row = lambda df, k, c="name": df.select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name"))
    sh, ps1 = (scripts.where(F.endswith("name", F.lit(x))) for x in (".sh", ".ps1"))
    theirs = spark.createDataFrame([("sh /home/hooks/one.sh",), ("echo",)], "command string")
    parts = [
        row(files.registered_scripts(cmds, "sh").where("name <> 'dispatch.sh'"), "command"), row(policy.used_elsewhere(sh.select(files.stem(F.col("name")).alias("name")), theirs), "twice"), row(relational.pairs_by_stem(ps1, sh, "name"), "pair"),
        row(cmds.agg(F.count("*").alias("name")), "entries"), row(sh.where(~textscan.first_line_is(F.col("text"), "#!/bin/sh")), "first-line"), row(sh.where(textscan.has_line_prefix(F.col("text"), "set -u")), "prefix"),
        row(events.allowed(spark.createDataFrame([("one",), ("nine",)], "name string"), "name", ["one", "six"]), "allowed"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(values("type VARCHAR, subject VARCHAR", [("flat-skill-file", "flat.md"), ("missing-skill-md", "none"), ("skill-name-mismatch", "bad"), ("skill-missing-description", "bad"), ("listed-folder", "bad"), ("listed-folder", "good"), ("listed-flat", "flat")]))
def skill_layout(spark, d):
    listed = rosters.skills(_tree(spark)).select(F.concat(F.lit("listed-"), "layout").alias("type"), F.col("name").alias("subject"))
    return rosters.skill_problems(_tree(spark)).unionByName(listed)


@query(values("type VARCHAR, subject VARCHAR", [("duplicate-row", "sql-expert"), ("unknown-row", "who-else"), ("focus-mismatch", "sql-expert"), ("no-focus", "doc-writer"), ("no-focus", "who-else")]))
def readme_focus(spark, d):
    return rosters.focus_problems(rosters.section_table(_lines(spark, "README.md"), "path", "## Agents"), files.agents(_registry(spark)).select("name", "focus"))


@query(values("kind VARCHAR, name VARCHAR, stated BIGINT, actual BIGINT", [("box", "rust-expert", -1, -1), ("box", "sql-expert", -1, -1), ("total", "commands/list.md", 3, 2), ("section", "### Extra (2 agents)", 2, 1), ("jobs", "build, test", -1, 2), ("cell", "rust-expert", -1, -1)]))
def prose_rosters(spark, d):
    ls = _lines(spark, "commands/list.md")
    box = rosters.box_names(ls, "path")
    row = lambda df, k, n, s, a: df.select(F.lit(k).alias("kind"), n.alias("name"), s.cast("long").alias("stated"), a.cast("long").alias("actual"))
    null = F.lit(-1)
    cells = regions.table_rows(_lines(spark, "README.md"), 2).where("line_no > 8").select(F.regexp_replace(F.get("cells", F.lit(0)), r"\*", "").alias("c"), F.get("cells", F.lit(1)).alias("f"))
    return (
        row(box, "box", F.col("name"), null, null).unionByName(row(rosters.declared_total(ls, box, "path"), "total", F.col("path"), F.col("declared"), F.col("actual")))
        .unionByName(row(rosters.counted_sections(ls, "path"), "section", F.col("header"), F.col("stated"), F.col("actual"))).unionByName(row(rosters.keys_under(_lines(spark, "ci.yml"), "path"), "jobs", F.col("keys"), null, F.col("n")))
        .unionByName(row(cells.where("f = 'no'"), "cell", F.col("c"), null, null))
    )


@query(values("kind VARCHAR, path VARCHAR, detail VARCHAR", [
    ("forbidden", "README.md", "11"), ("warn", "sub/.env", "present"), ("warn", ".gitignore", "lacks-exclusions"), ("absent", "LICENSE", "file"), ("absent", "tests", "folder"), ("lacks", "README.md", "two"), ("invalid", "broken.json", None), ("ok", "plugin.json", "true"), ("ok", "broken.json", "false"),
]))
def policy_files(spark, d):
    t = _tree(spark)
    row = lambda df, k, p, x: df.select(F.lit(k).alias("kind"), p.alias("path"), x.cast("string").alias("detail"))
    json_files = t.where(F.col("path").isin("plugin.json", "broken.json"))
    return (
        row(policy.forbidden(t), "forbidden", F.col("path"), F.col("line_no")).unionByName(row(policy.named(t, ".env"), "warn", F.col("subject"), F.col("type"))).unionByName(row(policy.ignores(t, ".gitignore", ["credentials", "settings.local"]), "warn", F.col("subject"), F.col("type")))
        .unionByName(row(policy.absent(t, ["README.md", "LICENSE"], ["skills", "tests"]), "absent", F.col("path"), F.col("kind"))).unionByName(row(textscan.required(t, [("README.md", "# Kit", "one"), ("README.md", "Delegate by hand", "two")]), "lacks", F.col("path"), F.col("label")))
        .unionByName(row(files.invalid_json(t.where(F.endswith("path", F.lit(".json")))), "invalid", F.col("path"), F.lit(None))).unionByName(row(json_files, "ok", F.col("path"), policy.parsed(F.col("text"))["ok"]))
    )


@query(values("type VARCHAR, subject VARCHAR", [("name-mismatch", "sub/plugin.json"), ("name-not-kebab", "sub/plugin.json"), ("blank-description", "sub/plugin.json"), ("unknown-key", "sub/plugin.json"), ("forbidden-path", "sub/plugin.json"), ("missing-manifest", "gone/plugin.json"), ("unresolved-source", "./gone"), ("version", "differs")]))
def manifests(spark, d):
    t, keys = _tree(spark), ["name", "version", "description", "root"]
    bad = policy.manifest_problems(t, [("plugin.json", "kit", keys), ("sub/plugin.json", "kit-two", keys), ("gone/plugin.json", "x", keys)], forbidden_paths=["/home/"])
    lost = policy.unresolved_sources(_file(spark, "market.json"), t).select(F.lit("unresolved-source").alias("type"), F.col("source").alias("subject"))
    same = relational.all_equal(t.where(F.endswith("path", F.lit("plugin.json"))).select(F.lit("v").alias("k"), fn.version(F.col("text"), "").alias("v")), "k", "v")
    return bad.unionByName(lost).unionByName(same.select(F.lit("version").alias("type"), F.when(F.col("all_equal"), "same").otherwise("differs").alias("subject")))


@query(values("k VARCHAR, less VARCHAR, state VARCHAR", [("a", "first line", "equal"), ("b", "first line", "differ"), ("c", "first line", "only_left"), ("d", "first line", "only_right"), ("a", "first word", "differ"), ("b", "first word", "equal"), ("c", "first word", "only_left"), ("d", "first word", "only_right")]))
def equal_outputs(spark, d):
    a = spark.createDataFrame([("a", "1\nx y\n"), ("b", "1 q\n2 r\n"), ("c", "")], "k string, text string")
    b = spark.createDataFrame([("a", "2\r\nx y"), ("b", "3 q\n4 r\n"), ("d", "")], "k string, text string")
    one = lambda x: policy.same_output(a, b, "k", x).withColumn("less", F.lit(x))
    return one("first line").unionByName(one("first word"))


SETTINGS = {"hooks": {
    "Stop": [{"matcher": "m", "hooks": [{"command": "sh /x/Old.sh"}, {"command": "mine"}]}, {"hooks": [{"command": "pwsh", "args": ["-File", "C:\\x\\old.ps1"]}]}],
    "Flat": ["old.sh", {"command": '"/y/old.sh"'}], "Other": ["sh old.sh.bak", {"command": "my-old.sh"}],
}}


@query(values("event VARCHAR, command VARCHAR, nested BOOLEAN, action VARCHAR, groups_left BIGINT", [
    ("Stop", "sh /x/Old.sh", True, "remove", 1), ("Stop", "mine", True, "keep", 1), ("Stop", "pwsh", True, "remove", 1), ("Flat", "old.sh", False, "remove", 0), ("Flat", '"/y/old.sh"', False, "remove", 0), ("Other", "sh old.sh.bak", False, "keep", 2), ("Other", "my-old.sh", False, "keep", 2),
]))
def hook_migration(spark, d):
    plan = migrate.hook_plan(spark.createDataFrame([(json.dumps(SETTINGS),)], "text string"), ["old.sh", "old.ps1"])
    left = migrate.left_hooks(plan).select("event", F.size("groups").cast("long").alias("groups_left"))
    return plan.join(left, "event", "left").select("event", "command", "nested", "action", F.coalesce("groups_left", F.lit(0)).cast("long").alias("groups_left"))


@query(values("name VARCHAR, action VARCHAR, empty BOOLEAN, n_removed BIGINT, n_foreign BIGINT", [("Docs", "removed", False, 1, 1), ("fs", "customised", False, 1, 1), ("own", "foreign", True, 1, 1)]))
def server_migration(spark, d):
    s = spark.createDataFrame([("Docs", "npx", ["-y", "docs", "key-1"]), ("fs", "npx", ["-y", "fs", "/data", "more"]), ("own", "run", ["", "x"])], "name string, command string, args array<string>")
    plan = migrate.server_plan(s, [("docs", "npx", ["-y", "docs", None]), ("fs", "npx", ["-y", "fs", None])])
    n = migrate.counters(plan, "action", ["removed"]).crossJoin(migrate.foreign_count(plan, "name", ["docs", "fs"]))  # one row each
    return plan.select("name", "action", migrate.empty_args(F.col("args")).alias("empty")).crossJoin(F.broadcast(n))


@query(values("kind VARCHAR, path VARCHAR, more BIGINT", [("dirt", "src/b.py", -1), ("dirt", "new name.txt", -1), ("delete", "agents/a.md", 1), ("delete", "b/c.md", 1), ("abort", "uncommitted changes", 2), ("go", None, 0), ("pushed", "unpushed commits", 2)]))
def checkout_cleanup(spark, d):
    status = spark.createDataFrame([(" M CLAUDE.md",), ("?? Keep/x/y",), ("M  src\\b.py",), ('R  "old.txt" -> "new name.txt"',), (" D touched.md",), ("",)], "line string")
    tracked = spark.createDataFrame([("agents/a.md",), ("CLAUDE.md",), ("keep/z",), ("b/c.md",), ("z.md",)], "path string")
    keep, none = ["claude.md", "keep"], spark.createDataFrame([], "line string")
    row = lambda df, k, p, m: df.select(F.lit(k).alias("kind"), p.alias("path"), m.cast("long").alias("more"))
    may = lambda a, b, k: row(migrate.may_proceed(a, b, keep, ["touched.md"]), k, F.col("reason"), F.col("exit_code"))
    return row(migrate.dirt(status, keep, ["touched.md"]), "dirt", F.col("path"), F.lit(-1)).unionByName(row(migrate.shown(migrate.delete_set(tracked, keep), 2), "delete", F.col("path"), F.col("more"))).unionByName(may(status, none, "abort")).unionByName(may(none, none, "go")).unionByName(may(none, status, "pushed"))


@query(values("n INTEGER, state VARCHAR, replaced VARCHAR", [(0, "created", '{"a":1,"hooks":{"x":[2]}}'), (1, "skipped", '{"a":1,"hooks":{"x":[2]}}'), (2, "kept", '{"a":1,"hooks":{"x":[2]}}'), (3, "replaced", '{"a":1,"hooks":{"x":[2]}}'), (4, "merged", '{"a":1,"hooks":{"x":[2]}}')]))
def settings_branches(spark, d):
    s = spark.createDataFrame([(0, False, True, False, False), (1, True, False, True, True), (2, True, True, True, False), (3, True, True, True, True), (4, True, True, False, False)], "n int, there boolean, t boolean, c boolean, f boolean")
    return s.select("n", migrate.settings_branch(F.col("there"), F.col("t"), F.col("c"), F.col("f")).alias("state"), merge.canonical(migrate.replaced_field(F.lit('{"hooks": 9, "a": 1}'), F.lit('{"hooks": {"x": [2]}, "b": 3}'), "hooks")).alias("replaced"))


@query(values("name VARCHAR, state VARCHAR, n_behind BIGINT", [("same", "in sync", 0), ("old", "behind", 2), ("fork", "diverged", 0), ("blank", "unknown", 0)]))
def checkout_drift(spark, d):
    commits = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("m", "c"), ("d", "m"), ("x", "a")], "id string, parent string")
    found = history.drift(spark.createDataFrame([("same", "d", "d"), ("old", "b", "m"), ("fork", "x", "d"), ("blank", None, "d")], "name string, head string, other string"), commits)
    return found.select("name", "state", F.coalesce("n_behind", F.lit(0)).cast("long").alias("n_behind"))


@query("""
WITH u AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, '1/d' || k || '//1-' || k AS expanded, '{"a":"1","n":' || k || '}' AS nested, 'A' AS kept FROM u""")
def placeholders(spark, d):
    k = F.get_json_object("props", "$.k")
    text = F.to_json(F.struct(F.concat(F.lit("${A}/${B:-d"), k, F.lit("}/${NOPE}/${C:-${A}}-"), k).alias("t"), F.struct(F.lit("${A}").alias("a"), k.cast("long").alias("n")).alias("o")))
    env = F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.concat(F.lit("${"), k, F.lit("}")))
    rows = table(spark, d, "events").select("event_id", merge.expanded(text, {"A": "1", "B": ""}).alias("j"), merge.resolved_env(env).alias("e"))
    return rows.select("event_id", F.get_json_object("j", "$.t").alias("expanded"), F.get_json_object("j", "$.o").alias("nested"), F.array_join(F.map_keys("e"), ",").alias("kept"))


_REFERENCES = ["see agents/rust.md now", "agent: rust-expert", '"agent": "rust"', "agent = rust", "subagent_type='rust')", "use rust here", "(agent: rust, x)", '"rust": 1', "agents/rust.mdx agent:\trust", "subagent_type: rusty"]


@query(f"""SELECT doc_id, CAST(doc_id % 10 AS INT) AS kind, doc_id % 10 IN (0, 2, 4, 6, 8) AS active, doc_id % 10 <> 9 AS word
FROM documents WHERE {len(_REFERENCES)} = 10""")
def active_references(spark, d):
    line = F.get(F.array(*[F.lit(x) for x in _REFERENCES]), (F.col("doc_id") % 10).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10).cast("int").alias("kind"), line.alias("line"))
    return rows.select("doc_id", "kind", F.col("line").rlike(textscan.active_reference("rust")).alias("active"), F.col("line").rlike(textscan.whole_word("rust")).alias("word"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_state(spark, d):
    return relational.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("""SELECT doc_id, line_no, line FROM (SELECT doc_id, CAST(n AS INT) AS line_no, CASE n WHEN 3 THEN 'a' || doc_id ELSE lang END AS line FROM documents, (VALUES (3), (4)) v(n)) WHERE doc_id % 3 = 0""")
def inside_markers(spark, d):
    rows = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"), F.lit("BEGIN"), F.concat(F.lit("a"), F.col("doc_id").cast("string")), F.col("lang"), F.lit("END"), F.lit("y"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("BEGIN"), F.lit("x"))).otherwise(F.array(F.lit("BEGIN"), F.lit("BEGIN"), F.lit("END")))
    return regions.inside_lines(textscan.lines(table(spark, d, "documents").select("doc_id", F.array_join(rows, "\r\n").alias("text"))), "doc_id", "BEGIN", "END")


@query(values("path VARCHAR, state VARCHAR, text VARCHAR", [
    ("f", "FRESH", None), ("s", "STALE", None), ("m", "missing-end", None), ("f", "WROTE", "<B>\n| | |\n|---|---|\n| Specialized agents | 3 (2 categories, 2 model tiers) |\n| Hooks | 2 pairs |\n<E>"), ("s", "WROTE", "<B>\n| | |\n|---|---|\n| Specialized agents | 3 (2 categories, 2 model tiers) |\n| Hooks | 2 pairs |\n<E>"),
    ("m", "missing-end", "<B>"), ("g", "missing-file", None), ("line", "headline", "v1.2.0: 3 agents"), ("problem", "STALE", "<B>"), ("problem", "missing-end", "<B>"), ("json", "summary", '{"categories":{"Core":2,"Extra":1},"ready":3,"total_agents":3,"unavailable":0}'),
]).replace("\n", "' || chr(10) || '"))
def rendered_blocks(spark, d):
    reg = _registry(spark)
    table_ = lambda: documents.numbers_table(documents.stats_rows(reg, [("Hooks", 2, "pairs")]))
    text = "<B>\n| | |\n|---|---|\n| Specialized agents | 3 (2 categories, 2 model tiers) |\n| Hooks | 2 pairs |\n\n<E>"
    docs = spark.createDataFrame([("f", text), ("s", "<B>\nold\n<E>"), ("m", "<B>")], "path string, text string")
    blocks = [(p, "<B>", "<E>", table_) for p in "fsm"]
    state = documents.check_blocks(docs, blocks)
    wrote = documents.written_blocks(docs, [*blocks, ("g", "<B>", "<E>", table_)])
    line = documents.headline(reg.select("version", F.size("sub_agents").alias("n")), "v%s: %d agents", ["version", "n"])
    summary = documents.summary_block(reg).select(merge.canonical(F.concat(F.lit("{"), "text", F.lit("}"))).alias("text"))
    row = lambda df, p, s, t: df.select(p.alias("path"), s.alias("state"), t.alias("text"))
    return (
        row(state, F.col("path"), F.col("state"), F.lit(None).cast("string")).unionByName(row(wrote, F.col("path"), F.col("state"), F.col("text"))).unionByName(row(line, F.lit("line"), F.lit("headline"), F.col("text")))
        .unionByName(row(documents.block_problems(state), F.lit("problem"), F.col("type"), F.col("subject"))).unionByName(row(summary, F.lit("json"), F.lit("summary"), F.col("text")))
    )


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, lower(regexp_extract(url, '(\\.[A-Za-z0-9]*)$', 1)) AS ext, lower(regexp_replace(url, '^https:/', '')) AS rel, rpad(CAST(page_id AS VARCHAR), CAST(greatest(6, length(CAST(page_id AS VARCHAR))) AS INT), ' ') AS padded,
CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS BIGINT) ELSE 1 END AS counter, 'x ' || page_id AS trimmed, coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN '' ELSE 'odd' END, ''), 'even') AS filled, page_id % 2 = 0 AS kebab, '2024-01-02T03:04:05+0000' AS stamp FROM pages""")
def path_functions(spark, d):
    p, n = table(spark, d, "pages"), F.col("page_id").cast("string")
    return p.select(
        "page_id", fn.basename(F.regexp_replace("url", "/", "\\\\")).alias("base"), fn.extension(F.col("url")).alias("ext"), fn.relative(F.regexp_replace("url", "/", "\\\\"), "https:/").alias("rel"), fn.padded(n, 6).alias("padded"),
        fn.counter(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" \t"), n, F.lit(" "))).when(F.col("page_id") % 3 == 1, "").otherwise("x1")).alias("counter"), fn.trim_blanks(F.concat(F.lit("\t x "), n, F.lit(" \t"))).alias("trimmed"),
        fn.first_filled(F.when(F.col("page_id") % 2 == 0, "").otherwise("odd"), F.lit("even")).alias("filled"), textscan.kebab(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a-"), n)).otherwise("A_b")).alias("kebab"), fn.iso(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("stamp"),
    )


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN ('Python', 'python-expert') WHEN 'view' THEN ('TypeScript/React', 'typescript-expert') WHEN 'purchase' THEN ('TypeScript', 'typescript-expert') END AS h FROM events),
r AS (SELECT CAST(user_id AS VARCHAR) AS session, h[2] AS agent, h[1] AS tech, event_id, row_number() OVER (PARTITION BY user_id, h[2] ORDER BY ts, event_id) AS rn FROM e WHERE h IS NOT NULL)
SELECT session, agent, tech, event_id FROM r WHERE rn = 1""")
def session_hints(spark, d):
    path = F.concat(F.lit("src/f"), F.col("event_id").cast("string"), F.when(F.col("event_type") == "click", ".PY").when(F.col("event_type") == "view", ".tsx").when(F.col("event_type") == "purchase", ".ts").otherwise(".txt"))
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), path.alias("path"), "event_id", "ts")
    return sessions.hints(rows, "session", "path", ["ts", "event_id"]).select("session", "agent", "tech", "event_id")


@query("""
WITH a AS (SELECT lang, source FROM documents WHERE doc_id % 2 = 0), b AS (SELECT lang, source FROM documents WHERE doc_id % 2 = 1)
SELECT lang, source, count(*) AS n FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY 1, 2""")
def symmetric_difference(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", "doc_id")
    half = lambda i: docs.where(F.col("doc_id") % 2 == i).select("lang", "source")
    return relational.symmetric_difference(half(0), half(1)).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM (SELECT doc_id, CAST(length(text) % 2 AS INT) AS q FROM documents) d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR q IS DISTINCT FROM l.quality""")
def lookup_parity(spark, d):
    return relational.looked_up(table(spark, d, "documents").select("doc_id", (F.length("text") % 2).alias("q")), table(spark, d, "labels"), "doc_id", "q", "quality")


@query("""
SELECT 'first' AS kind, min(lang) AS name, CAST(0 AS BIGINT) AS n FROM documents WHERE lang IN ('de', 'fr') UNION ALL
SELECT 'fold', name, n FROM (SELECT lang AS name, min(doc_id) AS n FROM documents WHERE lang IN ('de', 'en') GROUP BY 1) UNION ALL
SELECT 'top', r_name, (SELECT count(*) FROM region) - 2 FROM (SELECT r_name FROM region ORDER BY r_name LIMIT 2)""")
def first_and_rest(spark, d):
    docs = table(spark, d, "documents")
    ranked = spark.createDataFrame([("xx", 1), ("de", 2), ("fr", 3)], "lang string, rank int")
    first = relational.first_existing(ranked, docs, "lang", "rank").select(F.lit("first").alias("kind"), F.col("lang").alias("name"), F.lit(0).cast("long").alias("n"))
    fold = relational.first_by_name(docs.select("lang", "doc_id"), spark.createDataFrame([("DE",), ("En",), ("zz",)], "lang string"), "lang", "doc_id").select(F.lit("fold").alias("kind"), F.col("lang").alias("name"), F.col("doc_id").alias("n"))
    top = relational.top_and_rest(table(spark, d, "region"), ["r_name"], 2).select(F.lit("top").alias("kind"), F.col("r_name").alias("name"), F.col("more").cast("long").alias("n"))
    return first.unionByName(fold).unionByName(top)


@query(values("kind VARCHAR, name VARCHAR, value VARCHAR", [
    ("status", "a", "Ready"), ("status", "b", "Limited"), ("status", "c", "Unavailable"), ("tool", "git", "OK"), ("tool", "jq", "MISSING!"), ("tool", "lint", "WRONG VERSION"), ("list", "doc-writer", "| doc-writer | model-big |  |"), ("json", "sql-expert", '{"name":"sql-expert","model":"model-small","focus":"SQL"}'),
    ("spec", "REQ-001", "duplicate"), ("spec", "REQ-002", "missing"), ("spec", "EDGE-009", "unknown"), ("review", "r1", "CHANGES_REQUIRED"), ("review", "r2", "APPROVED"), ("health", "1", "FAIL"), ("health", "2", "WARN"), ("health", "3", "PASS"), ("score", "95.00", "Excellent"), ("smell", "0", "function_lines,parameters"),
    ("spec-review", "good", "APPROVED"), ("spec-review", "bad", "CHANGES_REQUIRED"), ("setting", "A=", "present"), ("setting", "B=", "add"), ("setting", "C=", "refused"), ("fact", "open", "true"), ("fact", "closed", "false"), ("context", "feature/x", "Git: branch feature/x, 2 commit(s) ahead of main, clean"), ("decision", "json", '{"decision":"block","reason":"say \\"why\\""}'), ("checks", "numbers", "1,2,12"),
]))
def reports(spark, d):
    row = lambda df, k, n, v: df.select(F.lit(k).alias("kind"), n.cast("string").alias("name"), v.cast("string").alias("value"))
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    reg = _registry(spark)
    agents, members = files.agents(reg), files.categories(reg)
    tools = documents.dependency_verdict(rows([("git", "2", True), ("jq", None, None), ("lint", "0", False)], "tool string, found string, ok boolean"), ["git", "jq"])
    found = rows([("r1", "MAJOR"), ("r1", "NIT"), ("r2", "MINOR"), ("r2", None)], "review string, severity string")
    problems = report.problems(rows([("x", 1)], "s string, c int"), 1, F.lit("t"), "s").unionByName(report.problems(rows([("y", 2)], "s string, c int"), 2, F.lit("t"), "s", severity="WARN"))
    say = lambda t: documents.review(textscan.lines(rows([(t,)], "text string")))
    facts = rows([("open", True, "feature/x", "h", "main", 2, False), ("closed", True, "main", "h", "main", 2, False)], "n string, in_tree boolean, branch string, head string, base string, ahead int, dirty boolean")
    parts = [
        row(documents.status(rows([("a", "m"), ("b", "m"), ("c", "m")], "name string, model string"), rows([("a", "m"), ("b", "n")], "name string, model string")), "status", F.col("name"), F.col("status")),
        row(tools, "tool", F.col("tool"), F.concat("status", F.when(F.col("blocking"), "!").otherwise(""))),
        row(rosters.listing(rosters.filtered(agents, members, category="extra")), "list", F.col("name"), F.col("text")), row(rosters.listing(rosters.filtered(agents, members, name="sql-expert"), "json"), "json", F.col("name"), F.col("text")),
        row(rosters.coverage(rows([("REQ-001",), ("REQ-002",), ("EDGE-001",)], "id string"), textscan.lines(rows([("REQ-001 -> a\nREQ-001 -> b\nEDGE-001 -> c\nEDGE-009 -> d\n",)], "text string"))), "spec", F.col("id"), F.col("problem")),
        row(rosters.severity_verdict(found, "review"), "review", F.col("review"), F.col("verdict")), row(rosters.health(problems, rows([(1, 5), (2, 5), (3, 5)], "check_id int, n_examined int")), "health", F.col("check_id"), F.col("state")),
        row(documents.quality_score(rows([(1.0, 0.8, 1.0, 1.0, 1.0)], ", ".join(f"{c} double" for c, _ in documents.SCORE))), "score", F.col("score"), F.col("band")),
        row(documents.smells(rows([(31, 10, 5)], "function_lines int, file_lines int, parameters int")), "smell", F.lit("0"), F.array_join("smells", ",")),
        row(say("REQ-001: PASS - x\nREQ-002: OUT-OF-SCOPE\nSCOPE: CLEAN"), "spec-review", F.lit("good"), F.col("verdict")), row(say("REQ-001: PASS\nEDGE-001: FAIL\nSCOPE: CLEAN"), "spec-review", F.lit("bad"), F.col("verdict")),
        row(documents.setting_plan(rows([("A=1",), ("D=2",)], "line string"), [("A=", "A=2"), ("B=", 'B="b-1"'), ("C=", "C=a b")], "[A-Za-z0-9_-]+"), "setting", F.col("prefix"), F.col("status")),
        row(facts, "fact", F.col("n"), files.gate_open(facts)), row(files.context_line(facts.where("n = 'open'")), "context", F.lit("feature/x"), F.col("line")), row(rows([('say "why"',)], "r string"), "decision", F.lit("json"), events.decision(F.col("r"))),
        row(rows([("_check_on 2 && {\n_check_on 12 && {\n_check_on 1 && {\n_check_on 2 && {\n",)], "t string"), "checks", F.lit("numbers"), F.array_join(report.check_numbers(F.col("t")), ",")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(values("name VARCHAR, stem VARCHAR", [(f"{t}.parquet", t) for t in ("benchmark", "customer", "events", "nation", "region", "supplier")]))
def table_files(spark, d):
    """Files of a folder by pattern, without reading them."""
    names = files.listed(spark, d, "{benchmark,customer,events,nation,region,supplier}.parquet")
    return names.select("name", files.stem(F.col("name")).alias("stem"))


@query("""
SELECT 'pass' AS name, CAST(0 AS BIGINT) AS n_fail, CAST(0 AS BIGINT) AS n_warn, CAST(0 AS BIGINT) AS n_info, count(*) AS n_examined, 'PASS' AS verdict FROM documents
UNION ALL SELECT 'empty', 0, 0, 0, 0, 'EMPTY' UNION ALL SELECT 'warn', 0, (SELECT count(*) FROM labels WHERE toxic = 1), 0, count(*), 'PASS' FROM labels UNION ALL SELECT 'fail', (SELECT count(*) FROM labels WHERE toxic = 1), 0, 0, count(*), 'FAIL' FROM labels""")
def verdict_branches(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    found = lambda severity: report.problems(labels.where("toxic = 1"), 1, F.lit("toxic"), "doc_id", severity=severity)
    none = report.problems(labels.limit(0), 1, F.lit("t"), "doc_id")
    named = lambda n, df: df.select(F.lit(n).alias("name"), *[F.col(c).cast("long").alias(c) for c in ("n_fail", "n_warn", "n_info", "n_examined")], "verdict")
    return named("pass", report.verdict(none, docs)).unionByName(named("empty", report.verdict(none, docs.limit(0)))).unionByName(named("warn", report.verdict(found("WARN"), labels))).unionByName(named("fail", report.verdict(found("FAIL"), labels)))


@query("""
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a<B>x<E>b' WHEN 1 THEN 'x<E>' WHEN 2 THEN '<B>x' || page_id WHEN 3 THEN '<B><B>x<E>' ELSE '<E>x<B>' END AS t FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'missing-begin' WHEN 2 THEN 'missing-end' WHEN 3 THEN 'duplicate-begin' WHEN 4 THEN 'misordered' END AS problem,
  CASE page_id % 5 WHEN 0 THEN 'a<B>new<E>b' ELSE t END AS replaced FROM p""")
def region_problems(spark, d):
    kind = F.col("page_id") % 5
    text = F.when(kind == 0, "a<B>x<E>b").when(kind == 1, "x<E>").when(kind == 2, F.concat(F.lit("<B>x"), F.col("page_id").cast("string"))).when(kind == 3, "<B><B>x<E>").otherwise("<E>x<B>")
    rows = table(spark, d, "pages").select("page_id", text.alias("t"))
    return rows.select("page_id", regions.region_problem(F.col("t"), "<B>", "<E>").alias("problem"), regions.replaced(F.col("t"), "<B>", "<E>", F.lit("new")).alias("replaced"))


_STATED = "20 specialized agents and a 21-agent kit\n3 Hook Scripts, 4 hooks, 3 hooks\n- **Total Hooks:** 5\n6 Quality Gates; Should show 7\n8 operational Skills, 7 skills\n9 Commands, 10 commands\ngrep '30 hooks'\n11-agent\n"


@query(values("line_no INTEGER, phrase VARCHAR, stated BIGINT, what VARCHAR, derived BIGINT", [
    (1, "20 specialized agents", 20, "agents", 21), (2, "4 hooks", 4, "hooks", 3), (3, "Total Hooks:** 5", 5, "hooks", 3), (4, "6 Quality Gates", 6, "hooks", 3), (4, "Should show 7", 7, "agents", 21), (5, "7 skills", 7, "skills", 8), (6, "10 commands", 10, "commands", 9), (8, "11-agent", 11, "agents", 21),
]))
def count_rules(spark, d):
    rows = textscan.stated_numbers(textscan.lines(spark.createDataFrame([(_STATED,)], "text string")), {"agents": 21, "hooks": 3, "skills": 8, "commands": 9})
    return rows.select("line_no", "phrase", "stated", "what", "derived")


@query(values("name VARCHAR, type VARCHAR, subject VARCHAR", [
    ("bad", "invalid-effort", "huge"), ("bad", "missing-a-bootstrap", "mcp__a__boot"), ("bad", "undeclared-tool-server", "a"), ("bad", "unknown-mcp-server", "z"), ("list", "unparseable-mcpservers", ""), ("list", "unparseable-tools", ""), ("none", "unparseable-frontmatter", "missing-frontmatter"), ("open", "unparseable-frontmatter", "unterminated-frontmatter"),
]))
def frontmatter_battery(spark, d):
    good = "---\neffort: high\nmcpServers: [a, b]\ntools: Read, mcp__a__x, mcp__a__boot\n---\n"
    bad = "---\neffort: huge\nmcpServers: z\ntools: mcp__a__x\n---\n"
    rows = [("good", good), ("bad", bad), ("none", "text"), ("list", "---\nmcpServers:\n  - a\ntools:\n---\n"), ("open", "---\neffort: huge\n")]
    return documents.frontmatter_problems(spark.createDataFrame(rows, "name string, text string"), ["low", "high"], ["a", "b"], [("a", ["mcp__a__boot"])])


@query("""
SELECT lang, count(*) FILTER (WHERE text <> '') AS n, CAST(sum(2 + CASE WHEN lang = 'de' THEN 0 ELSE 1 END) AS BIGINT) AS n_parts, min(lang) AS second FROM documents GROUP BY 1""")
def small_helpers(spark, d):
    docs = table(spark, d, "documents")
    parts = relational.end_to_end(F.array(F.lit("x"), F.col("lang")), F.when(F.col("lang") != "de", F.array(F.lit("y"))))
    out = None
    for k in ("de", "en", "es", "fr"):
        some = docs.where(F.col("lang") == k)
        one = relational.filled_count(some, "text").crossJoin(some.agg(F.sum(F.size(parts)).alias("n_parts"), F.min(fn.nth(parts, 1)).alias("second"), F.min(F.coalesce(fn.nth(parts, 9), F.lit(k))).alias("lang")))  # one row each
        out = one if out is None else out.unionByName(one)
    return out.where("lang is not null").select("lang", F.col("n").cast("long").alias("n"), "n_parts", "second")
