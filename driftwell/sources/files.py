"""File sets, JSON registries and hook registrations as relations; committed and verified sinks."""

from __future__ import annotations

import datetime as dt
import json
import os
import shutil
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = (
    "version string, description string, "
    "consistency struct<deprecated_agent_names array<string>, model_shorthand_map map<string,string>, doc_blocks struct<list_agents_summary_categories map<string,array<string>>>>, "
    "sub_agents map<string, struct<enabled boolean, model string, specialization string, focus string>>, agent_categories map<string, array<string>>"
)
HOOKS = "hooks map<string, array<struct<matcher string, hooks array<struct<type string, command string, timeout int>>>>>"
#: Event names that a registration may use. Fixed values.
EVENTS = ("PreToolUse", "PostToolUse", "UserPromptSubmit", "Notification", "Stop", "SubagentStop", "SessionStart", "SessionEnd", "PreCompact")


def texts(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, without: Sequence[str] = (".git",)) -> DataFrame:
    """(path, name, text) of files below a folder, CR dropped, without those in excluded folders."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    for w in without:
        df = df.where(~F.contains(F.col("path"), F.lit(f"/{w}/")))
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.translate(F.decode("content", "UTF-8"), "\r", "").alias("text"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def invalid_json(files: DataFrame) -> DataFrame:
    """Files whose text is no JSON (a key that comes twice counts as invalid)."""
    return files.where(F.try_parse_json("text").isNull()).select("path")


def invalid_yaml(files: DataFrame) -> DataFrame:
    """(path, problem) of files that a YAML parser rejects; problem "skipped" for all where none is installed."""

    def run(frames):
        try:
            import yaml
        except ImportError:
            yaml = None
        for f in frames:
            bad = []
            for path, text in zip(f["path"], f["text"], strict=True):
                if yaml is None:
                    bad.append((path, "skipped"))
                    continue
                try:
                    list(yaml.safe_load_all(text or ""))
                except yaml.YAMLError:
                    bad.append((path, "invalid"))
            import pandas as pd

            yield pd.DataFrame(bad, columns=["path", "problem"])

    return files.select("path", "text").mapInPandas(run, "path string, problem string")


def registry(files: DataFrame) -> DataFrame:
    return files.select("path", F.from_json("text", REGISTRY).alias("r")).select("path", "r.*")


def keys_in_order(text: Column) -> Column:
    """Object keys in file order."""
    return F.json_object_keys(text)


def agents(reg: DataFrame) -> DataFrame:
    """(name, model, focus, enabled), one row an agent."""
    return reg.select(F.explode("sub_agents").alias("name", "a")).select("name", "a.model", "a.focus", "a.enabled")


def categories(reg: DataFrame) -> DataFrame:
    """(category, name)."""
    return reg.select(F.explode("agent_categories").alias("category", "names")).select("category", F.explode("names").alias("name"))


def deprecated(reg: DataFrame) -> DataFrame:
    return reg.select(F.explode(F.coalesce("consistency.deprecated_agent_names", F.array().cast("array<string>"))).alias("name"))


def shorthand(reg: DataFrame, key: str) -> DataFrame:
    """One row: the map's value for key, null if there is none."""
    if not key:
        raise ValueError("a key is needed")
    return reg.select(F.try_element_at("consistency.model_shorthand_map", F.lit(key)).alias("value"))


def commands(files: DataFrame) -> DataFrame:
    """(event, command), a row for each registered hook; missing levels are skipped."""
    doc = files.select(F.from_json("text", HOOKS)["hooks"].alias("hooks"))
    group = doc.select(F.explode("hooks").alias("event", "groups")).select("event", F.explode("groups").alias("g"))
    return group.select("event", F.explode("g.hooks").alias("h")).select("event", F.col("h.command").alias("command")).where("command is not null")


def registered_scripts(cmds: DataFrame, suffix: str) -> DataFrame:
    """Distinct script names with this suffix that commands name."""
    return cmds.select(F.explode(F.regexp_extract_all("command", F.lit(rf"([A-Za-z0-9_-]+\.{suffix})\b"), F.lit(1))).alias("name")).distinct()


def dispatched(cmds: DataFrame, dispatcher: str = "dispatch.sh") -> DataFrame:
    """Distinct scripts that commands pass to the dispatcher, and the dispatcher."""
    arg = F.regexp_extract_all("command", F.lit(rf"""{dispatcher.replace('.', '[.]')}["']?\s+([A-Za-z0-9_-]+)"""), F.lit(1))
    return cmds.select(F.explode(arg).alias("arg")).select(F.concat("arg", F.lit(".sh")).alias("name")).union(cmds.sparkSession.createDataFrame([(dispatcher,)], "name string")).distinct()


def hook_problems(hooks_file: DataFrame, scripts: DataFrame, dispatcher: str = "dispatch.sh") -> DataFrame:
    """(type, subject) of everything wrong between a registration and the scripts (name, text) on disk."""
    cmds = commands(hooks_file)
    row = lambda df, t: df.select(F.lit(t).alias("type"), F.col("name").alias("subject"))
    one = lambda cond, t, subject: cond.select(F.lit(t).alias("type"), F.lit(subject).alias("subject"))
    ps1, sh = (scripts.where(F.endswith("name", F.lit(x))) for x in (".ps1", ".sh"))
    reg_ps1, reg_sh = registered_scripts(cmds, "ps1"), dispatched(cmds, dispatcher)
    names = lambda df: df.select("name").distinct()
    not_dispatcher = F.col("name") != dispatcher
    allow = F.split(F.regexp_extract("text", r"(?m)^[ \t]*([A-Za-z0-9_-]+(?:\|[A-Za-z0-9_-]+)*)\)", 1), r"\|")
    allowed = sh.where(F.col("name") == dispatcher).select(F.explode(allow).alias("arg")).select(F.concat("arg", F.lit(".sh")).alias("name"))
    arg = F.regexp_extract("command", rf"""{dispatcher}["']?\s+([A-Za-z0-9_-]+)""", 1)
    file = F.regexp_extract("command", r"([A-Za-z0-9_-]+)\.ps1", 1)
    parts = [
        one(cmds.agg(F.count("*").alias("n")).where("n = 0"), "no-hooks-block", "hooks.json"),
        row(reg_ps1.join(names(ps1), "name", "left_anti"), "missing-hook-script"),
        row(names(ps1).join(reg_ps1, "name", "left_anti"), "orphan-hook-script"),
        row(reg_sh.where(not_dispatcher).join(names(sh), "name", "left_anti"), "missing-sh-impl"),
        row(names(sh).where(not_dispatcher).join(reg_sh, "name", "left_anti"), "orphan-sh-script"),
        one(sh.agg(F.count_if(F.col("name") == dispatcher).alias("n")).where("n = 0"), "missing-dispatch-sh", dispatcher),
        one(cmds.agg(F.count_if(~F.contains("command", F.lit(dispatcher))).alias("n")).where("n > 0"), "missing-dispatch-sh", dispatcher),
        row(cmds.where(~F.col("event").isin(*EVENTS)).select(F.col("event").alias("name")).distinct(), "invalid-hook-event"),
        row(ps1.where(F.split_part("text", F.lit("\n"), F.lit(1)) != "#Requires -Version 7.0"), "missing-requires-ps7"),
        row(sh.where(F.split_part("text", F.lit("\n"), F.lit(1)) != "#!/bin/sh"), "missing-sh-shebang"),
        row(sh.where(~F.col("text").rlike(r"(?m)^set -u")), "missing-set-u"),
        row(reg_sh.where(not_dispatcher).join(allowed, "name", "left_anti"), "missing-dispatch-allowlist"),
        row(cmds.where((arg != "") & (file != "") & (arg != file)).select(arg.alias("name")), "chain-name-mismatch"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def git_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row of what git says of a folder: in_tree, branch, head, base, ahead, dirty.  A small driver-side source."""

    def git(*args: str) -> str | None:
        r = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
        return r.stdout.strip() if r.returncode == 0 else None

    base = next((b for b in ("origin/main", "origin/master", "main", "master") if git("rev-parse", "--verify", "--quiet", b) is not None), None)
    ahead = git("rev-list", "--count", f"{base}..HEAD") if base else None
    row = (git("rev-parse", "--is-inside-work-tree") == "true", git("rev-parse", "--abbrev-ref", "HEAD"), git("rev-parse", "HEAD"), base, int(ahead) if ahead else 0, bool(git("status", "--porcelain")))
    return spark.createDataFrame([row], "in_tree boolean, branch string, head string, base string, ahead int, dirty boolean")


def gate_open(facts: DataFrame) -> Column:
    """Whether a stop may be blocked: in a tree, on a named branch off the main line, a base, ahead of it, clean."""
    named = ~F.coalesce(F.col("branch"), F.lit("HEAD")).isin("HEAD", "main", "master")
    return F.col("in_tree") & named & F.col("base").isNotNull() & (F.col("ahead") > 0) & ~F.col("dirty")


def context_line(facts: DataFrame) -> DataFrame:
    """The line that a session starts with."""
    return facts.where("in_tree").select(F.format_string("Git: branch %s, %d commit(s) ahead of %s, %s", F.coalesce("branch", F.lit("(detached)")), "ahead", F.coalesce("base", F.lit("-")), F.when(F.col("dirty"), "uncommitted changes").otherwise("clean")).alias("line"))


def tracked_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the files that git tracks in a folder; none where it is no checkout.  A small driver-side source."""
    r = subprocess.run(["git", "-C", folder, "-c", "core.quotepath=false", "ls-files", "-z"], capture_output=True, text=True, check=False)
    return spark.createDataFrame([(p,) for p in r.stdout.split("\0") if p] if r.returncode == 0 else [], "path string")


def listed(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(name) of the files right in a folder; their contents are not read."""
    reader = spark.read.format("binaryFile")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"))


def optional_text(spark: SparkSession, path: str | None) -> DataFrame:
    """(path, text) of a file that need not be there; without it an empty table."""
    if not path or not os.path.isfile(path):
        return spark.createDataFrame([], "path string, text string")
    return texts(spark, path).select("path", "text")


def first_root(*candidates: str | None) -> str:
    """The first candidate that is a folder; raises if none is."""
    for c in candidates:
        if c and os.path.isdir(c):
            return os.path.abspath(c)
    raise FileNotFoundError("no root resolves")


def append_rows(df: DataFrame, path: str) -> None:
    """An append-only log of JSON lines."""
    df.write.mode("append").json(path)


def append_line(path: str, line: str) -> None:
    """One more line in a local log."""
    with open(path, "a", encoding="utf-8", newline="\n") as f:
        f.write(line.rstrip("\n") + "\n")


def _same(value: object, back: object) -> bool:
    """Whether a value is what was read back, its keys being text there and tuples lists."""
    if isinstance(value, dict):
        return isinstance(back, dict) and len(value) == len(back) and all(str(k) in back and _same(v, back[str(k)]) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return isinstance(back, list) and len(value) == len(back) and all(map(_same, value, back))
    return type(value) is type(back) and value == back


def write_verified(path: str, value: object) -> None:
    """A local JSON file, written beside its place, read again and compared, and moved there only if it says the same; the original stays otherwise."""
    new = f"{path}.tmp.{os.getpid()}"
    try:
        with open(new, "w", encoding="utf-8", newline="\n") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
        with open(new, encoding="utf-8") as f:
            back = json.load(f)
        if not _same(value, back):
            raise ValueError(f"{path}: what was written does not read back the same")
        os.replace(new, path)
    finally:
        if os.path.exists(new):
            os.remove(new)


def write_text(path: str, text: str) -> None:
    """A local file, replaced whole: temporary file, then move.  LF only."""
    new = f"{path}.tmp.{os.getpid()}"
    with open(new, "w", encoding="utf-8", newline="\n") as f:
        f.write(text.replace("\r\n", "\n"))
    os.replace(new, path)


def backup(path: str, now: dt.datetime) -> str:
    to = f"{path}.bak-{now:%Y%m%d-%H%M%S}"
    shutil.copy2(path, to)
    return to
