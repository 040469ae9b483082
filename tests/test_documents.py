"""Frontmatter rules, rendered blocks, statuses, scores and reviews on literal rows."""

import json

from driftwell.operators import documents
from driftwell.operators.textscan import lines
from driftwell.sources import files


def test_frontmatter_rules(spark):
    good = "---\neffort: high\nmcpServers: [a, b]\ntools: Read, mcp__a__x, mcp__a__boot\n---\n"
    bad = "---\neffort: huge\nmcpServers: z\ntools: mcp__a__x\n---\n"
    rows = [("good", good), ("bad", bad), ("none", "text"), ("list", "---\nmcpServers:\n  - a\ntools:\n---\n")]
    got = documents.frontmatter_problems(spark.createDataFrame(rows, "name string, text string"), ["low", "high"], ["a", "b"], [("a", ["mcp__a__boot"])])
    assert sorted(map(tuple, got.collect())) == [
        ("bad", "invalid-effort", "huge"), ("bad", "missing-a-bootstrap", "mcp__a__boot"), ("bad", "undeclared-tool-server", "a"), ("bad", "unknown-mcp-server", "z"),
        ("list", "unparseable-mcpservers", ""), ("list", "unparseable-tools", ""), ("none", "unparseable-frontmatter", "missing-frontmatter"),
    ]


def test_blocks(spark):
    doc = {"sub_agents": {"x": {}, "y": {}}, "agent_categories": {"c": ["x", "y"]}, "consistency": {"doc_blocks": {"list_agents_summary_categories": {"B": ["c", "gone"], "A": ["gone"]}}}}
    reg = files.registry(spark.createDataFrame([("p", json.dumps(doc))], "path string, text string"))
    text = documents.summary_block(reg).collect()[0][0]
    assert json.loads("{" + text + "}") == {"total_agents": 2, "ready": 2, "unavailable": 0, "categories": {"B": 2, "A": 0}}
    docs = spark.createDataFrame([("f", f"<B>\n{text}\n<E>"), ("s", "<B>\nold\n<E>"), ("m", "<B>")], "path string, text string")
    got = documents.check_blocks(docs, [(p, "<B>", "<E>", lambda: documents.summary_block(reg)) for p in "fsm"])
    assert {r["path"]: r["state"] for r in got.collect()} == {"f": "FRESH", "s": "STALE", "m": "missing-end"}
    table = documents.numbers_table(spark.createDataFrame([(1, "b", "2"), (0, "a", "1")], "pos int, label string, value string"))
    assert table.collect()[0][0] == "| | |\n|---|---|\n| a | 1 |\n| b | 2 |"


def test_statuses_and_scores(spark):
    agents = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m")], "name string, model string")
    on_disk = spark.createDataFrame([("a", "m"), ("b", "n")], "name string, model string")
    assert {r[0]: r[1] for r in documents.status(agents, on_disk).collect()} == {"a": "Ready", "b": "Limited", "c": "Unavailable"}
    parts = spark.createDataFrame([(1.0, 0.8, 1.0, 1.0, 1.0)], ", ".join(f"{c} double" for c, _ in documents.SCORE))
    assert [(str(r["score"]), r["band"]) for r in documents.quality_score(parts).collect()] == [("95.00", "Excellent")]
    sized = spark.createDataFrame([(31, 10, 5)], "function_lines int, file_lines int, parameters int")
    assert documents.smells(sized).collect()[0]["smells"] == ["function_lines", "parameters"]


def test_reviews(spark):
    say = lambda t: documents.review(lines(spark.createDataFrame([(t,)], "text string"))).collect()[0]["verdict"]
    assert say("REQ-001: PASS - x\nREQ-002: OUT-OF-SCOPE-THIS-REVIEW\nSCOPE: CLEAN") == "APPROVED"
    assert say("REQ-001: PASS\nEDGE-001: FAIL\nSCOPE: CLEAN") == say("REQ-001: PASS\nSCOPE: CREEP") == say("nothing") == "CHANGES_REQUIRED"


def test_dependencies_and_settings(spark):
    tools = spark.createDataFrame([("git", "2", True), ("jq", None, None), ("lint", "0", False)], "tool string, found string, ok boolean")
    assert {r["tool"]: (r["status"], r["blocking"]) for r in documents.dependency_verdict(tools, ["git", "jq"]).collect()} == {"git": ("OK", False), "jq": ("MISSING", True), "lint": ("WRONG VERSION", False)}
    have = spark.createDataFrame([("A=1",)], "line string")
    assert [r["setting"] for r in documents.add_settings(have, [("A=", "A=2"), ("B=", "B=2")]).collect()] == ["B=2"]
