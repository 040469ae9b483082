"""Rules over frontmatter, rendered blocks, rosters, reviews and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import regions, report

#: Weights of the quality score and its bands. Fixed values.
SCORE = (("config_integrity", "0.20"), ("agent_coverage", "0.25"), ("hook_architecture", "0.25"), ("frontmatter_quality", "0.15"), ("structural_integrity", "0.15"))
BANDS = ((90, "Excellent"), (80, "Good"), (70, "Acceptable"), (60, "Needs Improvement"))
LOWEST = "Critical"
#: Sizes from which code smells: lines of a function, lines of a file, parameters. Fixed values.
SMELLS = (("function_lines", 30), ("file_lines", 300), ("parameters", 4))


def frontmatter_problems(docs: DataFrame, efforts: Sequence[str], servers: Sequence[str] = (), companions: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """(name, type, subject) of all broken rules in docs (name, text).

    servers: those known (none: not checked); companions: (server, tools that any use of it requires)."""
    block = F.col("block")
    rows = regions.with_frontmatter(docs.select("name", "text"), "text", problem="bad").select("name", "bad", *[regions.front_value(block, k).alias(k) for k in ("effort", "mcpServers", "tools")])
    rows = rows.withColumns({"declared": regions.front_list(F.coalesce("mcpServers", F.lit(""))), "used": regions.front_list(F.coalesce("tools", F.lit("")))})
    by = F.array_distinct(F.filter(F.transform("used", lambda t: F.regexp_extract(t, r"\Amcp__([A-Za-z0-9_-]+?)__", 1)), lambda s: s != ""))
    rows = rows.withColumn("by_tools", by)
    each = lambda cond, kind, items: F.when(cond, F.transform(items, lambda s: F.struct(F.lit(kind).alias("type"), s.alias("subject"))))
    one = lambda s: F.array(s)
    sound = F.col("bad").isNull()
    found = [
        each(~sound, "unparseable-frontmatter", one(F.col("bad"))),
        each(sound & (F.col("effort") != "") & ~F.col("effort").isin(*efforts), "invalid-effort", one(F.col("effort"))),
        each(sound & F.col("mcpServers").isNotNull() & (F.size("declared") == 0), "unparseable-mcpservers", one(F.lit(""))),
        each(sound & F.col("tools").isNotNull() & (F.size("used") == 0), "unparseable-tools", one(F.lit(""))),
        each(sound & (F.coalesce("mcpServers", F.lit("")) != ""), "undeclared-tool-server", F.array_except("by_tools", "declared")),
    ]
    if servers:
        found.append(each(sound, "unknown-mcp-server", F.array_except("declared", F.array(*[F.lit(s) for s in servers]))))
    for server, tools in companions:
        found.append(each(sound & F.array_contains("by_tools", server), f"missing-{server}-bootstrap", F.array_except(F.array(*[F.lit(t) for t in tools]), F.col("used"))))
    empty = F.array().cast("array<struct<type:string,subject:string>>")
    return rows.withColumn("p", F.explode(F.concat(*[F.coalesce(x, empty) for x in found]))).select("name", "p.*")


def group_sizes(reg: DataFrame) -> DataFrame:
    """(pos, label, n): declared labels in order with the members of all their categories; unknown categories count 0."""
    r = reg.select("agent_categories", F.map_entries("consistency.doc_blocks.list_agents_summary_categories").alias("e"))
    size = F.aggregate("e.value", F.lit(0), lambda a, c: a + F.coalesce(F.size(F.try_element_at("agent_categories", c)), F.lit(0)))
    return r.select("agent_categories", F.posexplode("e").alias("pos", "e")).select("pos", F.col("e.key").alias("label"), size.alias("n"))


def summary_block(reg: DataFrame) -> DataFrame:
    """One row: the JSON lines of totals and category sizes; ready equals the total, whatever is enabled."""
    total = reg.select(F.size("sub_agents").alias("total"))
    lines = group_sizes(reg).agg(F.array_sort(F.collect_list(F.struct("pos", F.format_string('      "%s": %d', "label", "n").alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), ",\n")
    head = F.format_string('    "total_agents": %d,\n    "ready": %d,\n    "unavailable": 0,\n    "categories": {\n', "total", "total")
    return lines.crossJoin(F.broadcast(total)).select(F.concat(head, body, F.lit("\n    }")).alias("text"))  # one row each


def headline(counts: DataFrame, form: str, columns: Sequence[str]) -> DataFrame:
    """One line of counts in a printf form."""
    return counts.select(F.format_string(form, *columns).alias("text"))


def numbers_table(rows: DataFrame) -> DataFrame:
    """rows (pos, label, value) as a two-column pipe table."""
    lines = F.array_sort(F.collect_list(F.struct("pos", F.format_string("| %s | %s |", "label", "value").alias("line"))))
    return rows.agg(F.concat(F.lit("| | |\n|---|---|\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("text"))


def check_blocks(files: DataFrame, blocks: Sequence[tuple[str, str, str, Callable[[], DataFrame]]]) -> DataFrame:
    """blocks: (path, begin, end, renderer). (path, state) with FRESH, STALE, or what is wrong with the markers."""
    out = None
    for path, begin, end, render in blocks:
        wanted = F.broadcast(render().select(F.col("text").alias("rendered")))  # one row
        row = files.where(F.col("path") == path).crossJoin(wanted)
        state = F.coalesce(regions.region_problem(F.col("text"), begin, end), regions.freshness(F.trim(regions.region(F.col("text"), begin, end), F.lit("\n")), F.trim("rendered", F.lit("\n"))))
        part = row.select("path", F.lit(begin).alias("block"), state.alias("state"))
        out = part if out is None else out.unionByName(part)
    return out


def status(agents: DataFrame, files: DataFrame) -> DataFrame:
    """Ready, Limited (models differ) or Unavailable (no file) for each registered agent; files has (name, model)."""
    f = files.select("name", F.col("model").alias("file_model"), F.lit(True).alias("there"))
    return agents.join(f, "name", "left").select("name", F.when(F.col("there").isNull(), "Unavailable").when(~F.col("model").eqNullSafe(F.col("file_model")), "Limited").otherwise("Ready").alias("status"))


def quality_score(df: DataFrame) -> DataFrame:
    """df with score (0 to 100, from parts between 0 and 1) and band."""
    score = (report.weighted(SCORE) * 100).cast("decimal(18,2)")
    return df.withColumn("score", score).withColumn("band", report.band(F.col("score"), BANDS, LOWEST))


def review(lines: DataFrame) -> DataFrame:
    """One row: items, failed items, scope and the verdict that they make (APPROVED if all in scope pass and SCOPE is CLEAN)."""
    item = r"^[ \t]*(?:REQ|EDGE)-[0-9]+:[ \t]*(PASS|FAIL|OUT-OF-SCOPE)"
    got = F.regexp_extract("line", item, 1)
    out = lines.agg(F.count_if(got != "").alias("n_items"), F.count_if(got == "FAIL").alias("n_failed"), F.count_if(got == "PASS").alias("n_passed"), F.max(F.nullif(F.regexp_extract("line", r"^[ \t]*SCOPE:[ \t]*(CLEAN|CREEP)", 1), F.lit(""))).alias("scope"))
    good = (F.col("n_failed") == 0) & (F.col("n_passed") > 0) & (F.col("scope") == "CLEAN")
    return out.withColumn("verdict", F.when(F.coalesce(good, F.lit(False)), "APPROVED").otherwise("CHANGES_REQUIRED"))


def smells(df: DataFrame) -> DataFrame:
    """df with the names of the size limits that each row is over."""
    return df.withColumn("smells", F.array_compact(F.array(*[F.when(F.col(c) > n, F.lit(c)) for c, n in SMELLS])))


def dependency_verdict(tools: DataFrame, required: Sequence[str]) -> DataFrame:
    """tools (tool, found, wanted, ok): status of each, and blocking for required ones that are not OK."""
    s = F.when(F.col("found").isNull(), "MISSING").when(~F.col("ok"), "WRONG VERSION").otherwise("OK")
    return tools.withColumn("status", s).withColumn("blocking", (s != "OK") & F.col("tool").isin(*required))


def add_settings(lines: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Setting lines (prefix, line) to append: those of which no line has the prefix."""
    return setting_plan(lines, wanted).where("status = 'add'").select("prefix", "setting")


def setting_plan(lines: DataFrame, wanted: Sequence[tuple[str, str]], allowed: str = r"[\s\S]*") -> DataFrame:
    """(prefix, setting, status) of setting lines: present (some line has the prefix), refused (what follows the prefix has other characters than allowed) or add.

    One pass over the lines, which may be many; the settings are a list."""
    seen = lines.agg(F.array(*[F.coalesce(F.max(F.startswith("line", F.lit(p))), F.lit(False)) for p, _ in wanted]).alias("seen"))
    rows = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(s).alias("setting"), F.lit(s[len(p) :].strip('"')).alias("value")) for p, s in wanted])
    each = seen.select(F.posexplode(rows).alias("i", "r"), "seen")
    status = F.when(F.get("seen", F.col("i")), "present").when(~F.col("r.value").rlike(rf"\A(?:{allowed})\z"), "refused").otherwise("add")
    return each.select("r.prefix", "r.setting", status.alias("status"))


def written_blocks(files: DataFrame, blocks: Sequence[tuple[str, str, str, Callable[[], DataFrame]]]) -> DataFrame:
    """(path, text, state): the files of blocks with their regions rendered anew; a file with unsound markers, and one that is missing, does not stop the others."""
    out = None
    for path, begin, end, render in blocks:
        wanted = files.sparkSession.createDataFrame([(path,)], "path string").join(files.select("path", "text"), "path", "left")
        row = wanted.crossJoin(F.broadcast(render().select(F.col("text").alias("rendered"))))  # one row
        bad = F.when(F.col("text").isNull(), "missing-file").otherwise(regions.region_problem(F.translate("text", "\r", ""), begin, end))
        part = row.select("path", regions.replaced(F.col("text"), begin, end, F.concat(F.lit("\n"), F.regexp_replace("rendered", r"\n+\z", ""), F.lit("\n"))).alias("text"), F.coalesce(bad, F.lit("WROTE")).alias("state"))
        out = part if out is None else out.unionByName(part)
    return out


def block_problems(states: DataFrame, number: int = 11) -> DataFrame:
    """The problem relation of check_blocks: all states but FRESH."""
    return report.problems(states.where("state <> 'FRESH'"), number, "state", "block", path=F.col("path"))


def stats_rows(reg: DataFrame, names: Sequence[tuple[str, int, str]]) -> DataFrame:
    """(pos, label, value) for numbers_table: agents with categories and model tiers, then the counts in names (label, n, phrase)."""
    a = reg.select(F.lit(0).alias("pos"), F.lit("Specialized agents").alias("label"), F.format_string("%d (%d categories, %d model tiers)", F.size("sub_agents"), F.size("agent_categories"), F.size(F.array_distinct(F.transform(F.map_values("sub_agents"), lambda x: x["model"])))).alias("value"))
    rest = reg.sparkSession.createDataFrame([(i, label, f"{n} {phrase}") for i, (label, n, phrase) in enumerate(names, 1)], "pos int, label string, value string")
    return a.unionByName(rest)
