"""Rosters in prose: tables, boxes, sections and listings as relations, held against the registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators import relational
from driftwell.operators.regions import fields_of

#: An agent's name in a roster: at least two kebab parts. Fixed form.
AGENT_NAME = r"\A[a-z0-9]+(-[a-z0-9]+)+\z"
#: Borders of box tables: top left, bottom left, vertical. Fixed values.
TOP, BOTTOM, BAR = "┌", "└", "│"


def box_names(lines: DataFrame, group: str) -> DataFrame:
    """(group, line_no, name): names in the first cell of each group's first box table; what stands after its bottom border does not count."""
    top = F.min(F.when(F.startswith("line", F.lit(TOP)), F.col("line_no")))
    start = lines.groupBy(group).agg(top.alias("b")).where("b is not null")
    inside = lines.join(start, group).where("line_no > b")
    end = inside.groupBy(group).agg(F.min(F.when(F.startswith("line", F.lit(BOTTOM)), F.col("line_no"))).alias("e"))
    cell = F.regexp_replace(F.get(F.split("line", BAR), F.lit(1)), r"^[ \t]+|[ \t]+\z", "")
    rows = inside.join(end, group).where("e is null or line_no < e").where(F.contains("line", F.lit(BAR)))
    return rows.select(group, "line_no", cell.alias("name")).where(F.col("name").rlike(AGENT_NAME))


def section_table(lines: DataFrame, group: str, header: str, level: str = "## ") -> DataFrame:
    """(group, name, focus): rows '| **name** | focus |' beneath a header, up to the next of its level."""
    head = F.when(F.startswith("line", F.lit(level)), F.col("line"))
    rows = relational.carry_header(lines, group, "line_no", head).where(F.col("section") == header)
    row = r"^\| \*\*([a-z0-9-]+)\*\* \| (.*?)(?: \|)?\z"
    return rows.where(F.col("line").rlike(row)).select(group, F.regexp_extract("line", row, 1).alias("name"), F.regexp_extract("line", row, 2).alias("focus"))


def focus_problems(listed: DataFrame, registry: DataFrame) -> DataFrame:
    """(type, subject): listed (name, focus) against registry (name, focus): duplicates, unknown and missing names, cells that differ, names without a focus."""
    names = relational.roster(listed, registry, "name").select(F.concat("problem", F.lit("-row")).alias("type"), F.col("name").alias("subject"))
    known = registry.select("name", F.nullif("focus", F.lit("")).alias("canonical"))
    cells = listed.join(known, "name", "left").where(~F.col("focus").eqNullSafe(F.col("canonical")))
    return names.unionByName(cells.select(F.when(F.col("canonical").isNull(), "no-focus").otherwise("focus-mismatch").alias("type"), F.col("name").alias("subject")))


def counted_sections(lines: DataFrame, group: str) -> DataFrame:
    """(group, header, stated, actual) of each '### X (N agents)' header whose number differs from the names beneath it."""
    head = F.when(F.startswith("line", F.lit("### ")), F.col("line"))
    rows = relational.carry_header(lines, group, "line_no", head).where(F.col("section").rlike(r"^### .* \([0-9]+ agents?\)"))
    name = F.regexp_extract("line", r"^\s*(\S+)", 1)
    counted = rows.groupBy(group, F.col("section").alias("header")).agg(F.count_if(name.rlike(AGENT_NAME) & (F.col("line") != F.col("section"))).alias("actual"))
    return counted.withColumn("stated", F.regexp_extract("header", r"\(([0-9]+) agents?\)", 1).cast("long")).where("stated <> actual").select(group, "header", "stated", "actual")


def declared_total(lines: DataFrame, names: DataFrame, group: str) -> DataFrame:
    """(group, declared, actual) where a 'Total: N agents' line is there and N differs from the names found."""
    pattern = r"Total: ([0-9]+) agents"
    stated = lines.where(F.col("line").rlike(pattern)).groupBy(group).agg(F.min_by(F.regexp_extract("line", pattern, 1).cast("long"), "line_no").alias("declared"))
    found = names.groupBy(group).agg(F.count("*").alias("actual"))
    return stated.join(found, group, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where("declared <> actual")


def keys_under(lines: DataFrame, group: str, parent: str = "jobs") -> DataFrame:
    """(group, n, keys): bare keys indented by two blanks beneath a top-level key, joined in order."""
    top = F.when(F.col("line").rlike(r"^[^\s#]"), F.col("line"))
    key = F.regexp_extract("line", r"^  ([A-Za-z0-9_-]+):\s*\z", 1)
    rows = relational.carry_header(lines, group, "line_no", top).where(F.startswith("section", F.lit(f"{parent}:"))).where(key != "").select(group, "line_no", key.alias("key"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "key"))), lambda x: x["key"]), ", ").alias("keys"))


def skill_problems(files: DataFrame, root: str = "skills") -> DataFrame:
    """(type, subject) of files (path, text) below root: loose files, folders without SKILL.md, names that differ from the folder, descriptions that are missing."""
    part = F.split(F.regexp_extract("path", rf"^{root}/(.*)\z", 1), "/")
    below = files.where(F.startswith("path", F.lit(f"{root}/"))).select(part.alias("p"), "text")
    loose = below.where(F.size("p") == 1).select(F.lit("flat-skill-file").alias("type"), F.get("p", F.lit(0)).alias("subject"))
    main = F.when((F.size("p") == 2) & (F.get("p", F.lit(1)) == "SKILL.md"), F.col("text"))
    folders = below.where(F.size("p") > 1).groupBy(F.get("p", F.lit(0)).alias("skill")).agg(F.max(main).alias("text"))
    first = lambda k: F.regexp_replace(F.regexp_extract("text", rf"(?m)^{k}:[ \t]*([^\n]*)", 1), r"\s+\z", "")
    found = F.array_compact(F.array(
        F.when(F.col("text").isNull(), F.lit("missing-skill-md")),
        F.when(F.col("text").isNotNull() & (first("name") != F.col("skill")), F.lit("skill-name-mismatch")),
        F.when(F.col("text").isNotNull() & (first("description") == ""), F.lit("skill-missing-description")),
    ))
    return loose.unionByName(folders.select(F.explode(found).alias("type"), F.col("skill").alias("subject")))


def skills(files: DataFrame, root: str = "skills") -> DataFrame:
    """(name, layout): folders with SKILL.md and flat *.md files, both layouts together."""
    folder = files.where(F.col("path").rlike(rf"^{root}/[^/]+/SKILL\.md\z")).select(F.regexp_extract("path", rf"^{root}/([^/]+)/", 1).alias("name"), F.lit("folder").alias("layout"))
    return folder.unionByName(files.where(F.col("path").rlike(rf"^{root}/[^/]+\.md\z")).select(F.regexp_extract("path", r"([^/]+)\.md\z", 1).alias("name"), F.lit("flat").alias("layout")))


def filtered(agents: DataFrame, members: DataFrame, category: str | None = None, name: str | None = None, groups: Sequence[str] | None = None) -> DataFrame:
    """agents (name, ...) of one category, of any of some categories, or of one name; all by default."""
    out = agents if name is None else agents.where(F.col("name") == name)
    wanted = [category] if category is not None else groups
    return out if wanted is None else out.join(members.where(F.col("category").isin(list(wanted))).select("name").distinct(), "name", "left_semi")


def listing(agents: DataFrame, form: str = "table") -> DataFrame:
    """(name, text): each agent as a table row, as JSON or in detail; form: table, json or detailed."""
    forms = {
        "table": F.format_string("| %s | %s | %s |", "name", F.coalesce("model", F.lit("-")), F.coalesce("focus", F.lit("-"))),
        "json": F.to_json(F.struct("name", "model", "focus")),
        "detailed": F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.concat(F.lit("Model: "), "model"), F.concat(F.lit("Focus: "), "focus")),
    }
    return agents.select("name", forms[form].alias("text"))


def coverage(required: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, problem): requirement ids that are missing, unknown or told more than once among lines like 'REQ-001 -> file'."""
    told = lines.select(F.regexp_extract("line", r"^[ \t]*((?:REQ|EDGE)-[0-9]+)\b", 1).alias("id")).where("id <> ''")
    return relational.roster(told, required, "id")


def severity_verdict(findings: DataFrame, group: str) -> DataFrame:
    """(group, n_blocker, n_major, n_minor, verdict): blockers and major findings ask for changes, others are comments.

    group names reviews; a review without findings has a row with a null severity."""
    n = lambda s: F.count_if(F.col("severity") == s)
    out = findings.groupBy(group).agg(n("BLOCKER").alias("n_blocker"), n("MAJOR").alias("n_major"), n("MINOR").alias("n_minor"))
    return out.withColumn("verdict", F.when((F.col("n_blocker") > 0) | (F.col("n_major") > 0), "CHANGES_REQUIRED").otherwise("APPROVED"))


def health(problems: DataFrame, examined: DataFrame) -> DataFrame:
    """(check_id, n_examined, n_fail, n_warn, state): one row a check that examined something; examined has (check_id, n_examined)."""
    n = problems.groupBy("check_id").agg(F.count_if(F.col("severity") == "FAIL").alias("n_fail"), F.count_if(F.col("severity") == "WARN").alias("n_warn"))
    out = examined.join(n, "check_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_fail", "n_warn")})
    return out.withColumn("state", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warn") > 0, "WARN").otherwise("PASS"))


def whole_file_model(text: Column) -> Column:
    """The first model line of a whole file, frontmatter or not."""
    return fields_of(text, "model")
