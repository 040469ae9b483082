"""Policies over a corpus of files: forbidden and required phrases, descriptions, files that must or must not be there, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators import report, textscan
from driftwell.operators.merge import canonical
from driftwell.operators.names import used

#: Phrases that broaden the policy. Fixed value.
FORBIDDEN = r"(?i)blanket|delegate (all|every) shell|all shell (work|execution)|every shell command|any shell command|short commands included"
#: Where the policy is in force: folders, extensions, single files. Fixed values.
FOLDERS, EXTENSIONS, SINGLE = ("agents", "commands", "skills", "hooks"), ("md", "json", "sh", "ps1"), ("CLAUDE.md", "README.md")


def operative(files: DataFrame) -> DataFrame:
    """Files (path relative to the root) where the policy is in force."""
    below = rf"^(?:{'|'.join(FOLDERS)})/.*\.(?:{'|'.join(EXTENSIONS)})\z"
    return files.where(F.col("path").isin(list(SINGLE)) | F.col("path").rlike(below))


def forbidden(files: DataFrame, pattern: str = FORBIDDEN) -> DataFrame:
    """(path, line_no, line) of operative files that match."""
    return textscan.matching(textscan.lines(operative(files).select("path", "text")), pattern)


def states_count(text: Column, n: Column) -> Column:
    """Whether 'N-agent' stands in the text with just this number."""
    return F.exists(F.regexp_extract_all(text, F.lit(r"([0-9]+)-agent(?![0-9])"), F.lit(1)), lambda x: x == n.cast("string"))


def other_counts(text: Column) -> Column:
    """All 'N-agent' in the text, joined by commas; 'none' without any."""
    return F.coalesce(F.nullif(F.array_join(F.regexp_extract_all(text, F.lit("[0-9]+-agent"), F.lit(0)), ","), F.lit("")), F.lit("none"))


def ignores(files: DataFrame, path: str, needles: Sequence[str]) -> DataFrame:
    """The problem relation with a warning if the ignore file is missing or lacks one of the literals."""
    row = files.where(F.col("path") == path).agg(F.count("*").alias("n"), *[F.coalesce(F.max(F.contains("text", F.lit(x))), F.lit(False)).alias(f"has{i}") for i, x in enumerate(needles)])
    good = F.lit(True)
    for i in range(len(needles)):
        good = good & F.col(f"has{i}")
    bad = row.where(~good).withColumn("type", F.when(F.col("n") == 0, "missing-ignore-file").otherwise("lacks-exclusions"))
    return report.problems(bad, 17, "type", F.lit(path), severity="WARN")


def named(files: DataFrame, name: str) -> DataFrame:
    """Warnings for files of exactly this name, wherever they are."""
    hit = files.where(F.element_at(F.split("path", "/"), -1) == name)
    return report.problems(hit, 9, F.lit("present"), "path", severity="WARN")


def absent(files: DataFrame, paths: Sequence[str], folders: Sequence[str] = ()) -> DataFrame:
    """(path, kind) of required files and folders that are not there; a folder is there if anything is in it."""
    have = files.select("path").distinct()
    want = files.sparkSession.createDataFrame([(p, "file") for p in paths] + [(p.rstrip("/"), "folder") for p in folders], "path string, kind string")
    parents = have.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("path")).where("path <> ''").distinct() if folders else have.limit(0)
    there = have.withColumn("kind", F.lit("file")).unionByName(parents.withColumn("kind", F.lit("folder")))
    return want.join(there, ["path", "kind"], "left_anti")


def used_elsewhere(names: DataFrame, commands: DataFrame) -> DataFrame:
    """Names that some command holds, also within a longer word; lists of any length."""
    return used(names, commands, "command")


def same_output(left: DataFrame, right: DataFrame, key: str, drop: str = "first line") -> DataFrame:
    """(key, state): equal, differ, only_left, only_right, texts compared without their first line or without the first word of each line."""
    cut = {"first line": lambda c: F.regexp_replace(c, r"\A[^\n]*\n?", ""), "first word": lambda c: F.regexp_replace(c, r"(?m)^[^ \n]* ", "")}[drop]
    tidy = lambda c: F.regexp_replace(cut(F.translate(c, "\r", "")), r"\n+\z", "")
    a, b = (d.select(key, tidy(F.col("text")).alias(n)) for d, n in ((left, "a"), (right, "b")))
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), key, "full_outer")
    return both.select(key, F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("differ").alias("state"))


def manifest_problems(files: DataFrame, manifests: Sequence[tuple[str, str, Sequence[str]]], placeholder: str = "", forbidden_paths: Sequence[str] = ()) -> DataFrame:
    """(type, subject) of manifests (path, name, allowed keys): missing, no JSON, another name, no kebab name, blank or no text as description, other keys, placeholder missing, forbidden path strings."""
    want = files.sparkSession.createDataFrame([(p, n, list(k)) for p, n, k in manifests], "path string, wanted string, allowed array<string>")
    rows = want.join(files.select("path", "text"), "path", "left").withColumn("v", F.try_parse_json("text"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    name, ok = F.coalesce(get("name"), F.lit("")), F.col("v").isNotNull()
    said = F.try_variant_get("v", "$.description", "variant")
    blank = F.coalesce(F.schema_of_variant(said) != "STRING", F.lit(True)) | F.coalesce(F.trim(get("description")) == "", F.lit(True))
    found = [
        F.when(F.col("text").isNull(), F.lit("missing-manifest")), F.when(F.col("text").isNotNull() & ~ok, F.lit("invalid-json")),
        F.when(ok & (name != F.col("wanted")), F.lit("name-mismatch")), F.when(ok & ~textscan.kebab(name), F.lit("name-not-kebab")), F.when(ok & blank, F.lit("blank-description")),
        F.when(ok & (F.size(F.array_except(F.json_object_keys("text"), F.col("allowed"))) > 0), F.lit("unknown-key")),
        *([F.when(ok & ~F.contains("text", F.lit(placeholder)), F.lit("missing-placeholder"))] if placeholder else []),
        *[F.when(ok & F.contains("text", F.lit(p)), F.lit("forbidden-path")) for p in forbidden_paths],
    ]
    return rows.select(F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("type"), F.col("path").alias("subject"))


def unresolved_sources(market: DataFrame, files: DataFrame) -> DataFrame:
    """(source) of a market's plugins that is no folder with files in it; './' is the root."""
    src = market.select(F.explode(F.from_json("text", "plugins array<struct<name string, source string>>")["plugins"]).alias("p")).select(F.col("p.source").alias("source")).where("source is not null")
    norm = F.regexp_replace(F.regexp_replace("source", r"^\./", ""), r"/+\z", "")
    parents = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("folder")).distinct()
    return src.withColumn("folder", norm).join(parents, "folder", "left_anti").select("source").distinct()


def pruned(text: Column, field: str) -> Column:
    """A JSON text without one top-level field; a text that is no object stays as it is."""
    return F.coalesce(F.to_json(F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, _: k != field)), text)


def parsed(text: Column) -> Column:
    """The status a JSON reader ends with, and its value: struct of ok, canonical (the raw text where it is no JSON)."""
    return F.struct(F.try_parse_json(text).isNotNull().alias("ok"), F.coalesce(canonical(text), text).alias("value"))
