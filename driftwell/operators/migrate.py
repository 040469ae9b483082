"""Removal and merge plans: what would go, what stays and why; nothing is written unless a plan is applied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators import textscan
from driftwell.operators.merge import names_script


def hook_entries(settings: DataFrame, raw: str = "text") -> DataFrame:
    """settings' other columns and (event, grp, pos, nested, matcher, command, args, entry): hooks of a settings text, of the nested and of the flat shape.

    nested: an array of groups with hooks; flat: an array of commands or of objects with a command."""
    rest = [c for c in settings.columns if c != raw]
    hooks = settings.select(*rest, F.posexplode(F.map_entries(F.from_json(raw, "hooks map<string,array<string>>")["hooks"])).alias("e", "kv")).select(*rest, F.col("kv.key").alias("event"), F.posexplode("kv.value").alias("grp", "g"))
    nested = F.from_json("g", "matcher string, hooks array<string>")
    rows = hooks.withColumn("n", nested).withColumn("nested", F.coalesce(F.col("n.hooks").isNotNull(), F.lit(False)))
    each = rows.select(*rest, "event", "grp", "nested", F.col("n.matcher").alias("matcher"), F.posexplode(F.when(F.col("nested"), F.col("n.hooks")).otherwise(F.array("g"))).alias("pos", "entry"))
    shape = F.from_json("entry", "command string, args array<string>")
    return each.withColumn("s", shape).select(*rest, "event", "grp", "pos", "nested", "matcher", F.coalesce("s.command", F.when(~F.startswith("entry", F.lit("{")), F.col("entry"))).alias("command"), F.col("s.args").alias("args"), "entry")


def names_any(command: Column, args: Column, scripts: Sequence[str]) -> Column:
    """Whether the command or any argument ends in one of the scripts."""
    all_ = F.array_compact(F.concat(F.array(command), F.coalesce(args, F.array().cast("array<string>"))))
    return F.exists(all_, lambda x: names_script(x, list(scripts)))


def hook_plan(settings: DataFrame, scripts: Sequence[str], raw: str = "text") -> DataFrame:
    """hook_entries and action: remove (one of the scripts) or keep."""
    return hook_entries(settings, raw).withColumn("action", F.when(names_any(F.col("command"), F.col("args"), scripts), "remove").otherwise("keep"))


def left_hooks(plan: DataFrame, *keys: str) -> DataFrame:
    """keys and (event, groups): what a hook plan leaves: groups (matcher, hooks) in order, each with its matcher and its entries; empty groups and events are gone."""
    kept = plan.where("action = 'keep'")
    groups = kept.groupBy(*keys, "event", "grp").agg(F.first("matcher").alias("matcher"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("hooks"))
    ordered = F.array_sort(F.collect_list(F.struct("grp", "matcher", "hooks")))
    return groups.groupBy(*keys, "event").agg(F.transform(ordered, lambda x: F.struct(x["matcher"].alias("matcher"), x["hooks"].alias("hooks"))).alias("groups"))


def server_plan(servers: DataFrame, shapes: Sequence[tuple[str, str, Sequence[str | None]]]) -> DataFrame:
    """servers (name, command, args): removed (of the shape (name, command, args) shipped with, None for any value), customised or foreign."""
    known, fits = F.lit(False), F.lit(False)
    for name, command, args in shapes:
        same = F.lower("name") == name.lower()
        known, fits = known | same, fits | (same & (F.col("command") == command) & textscan.shape_matches(F.col("args"), args))
    return servers.withColumn("action", F.when(~known, "foreign").when(F.coalesce(fits, F.lit(False)), "removed").otherwise("customised"))


def counters(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One row: how many rows have each of the values."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def foreign_count(df: DataFrame, name: str, ours: Sequence[str]) -> DataFrame:
    """One row: members that are none of ours, without case."""
    return df.agg(F.count_if(~F.lower(name).isin([x.lower() for x in ours])).alias("n_foreign"))


def dirt(status: DataFrame, protected: Sequence[str], touched: Sequence[str] = (), line: str = "line") -> DataFrame:
    """(path) of status lines 'XY path' or 'XY old -> new', less protected paths and those that this run touched."""
    entry = F.regexp_replace(F.substring(F.col(line), 4, 1 << 20), r"^.*?\s->\s", "")
    bare = F.regexp_replace(F.regexp_replace(entry, r"^[\s]+|[\s]+\z", ""), r'^"+|"+\z', "")
    norm = F.regexp_replace(F.translate(bare, "\\", "/"), r"/+\z", "")
    rows = status.select(norm.alias("path")).where("path <> ''")
    return rows.where(~textscan.under(F.col("path"), protected)).where(~F.lower("path").isin([t.lower() for t in touched]))


def delete_set(tracked: DataFrame, protected: Sequence[str]) -> DataFrame:
    """(path) of tracked files that are not protected."""
    return tracked.where(~textscan.under(F.regexp_replace(F.translate("path", "\\", "/"), r"/+\z", ""), protected))


def children_first(paths: DataFrame) -> DataFrame:
    """Paths in an order in which folders come after what is in them."""
    return paths.orderBy(F.desc("path"))


def shown(paths: DataFrame, n: int = 20) -> DataFrame:
    """The first n paths, and beside each how many more there are."""
    more = paths.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return paths.orderBy("path").limit(n).crossJoin(F.broadcast(more))  # one row


def may_proceed(status: DataFrame, unpushed: DataFrame, protected: Sequence[str], touched: Sequence[str] = ()) -> DataFrame:
    """One row: whether a checkout may be cleaned, why not, and the exit code (2 for an abort)."""
    d = dirt(status, protected, touched).agg(F.count("*").alias("n_dirty"))
    u = unpushed.agg(F.count("*").alias("n_unpushed"))
    reason = F.when(F.col("n_dirty") > 0, "uncommitted changes").when(F.col("n_unpushed") > 0, "unpushed commits")
    return d.crossJoin(F.broadcast(u)).select(reason.isNull().alias("proceed"), reason.alias("reason"), F.when(reason.isNull(), 0).otherwise(2).alias("exit_code"))  # one row each


def replaced_field(target: Column, source: Column, field: str) -> Column:
    """A JSON text whose top-level field comes from another one (added, if it is not there)."""
    return F.to_json(F.map_concat(F.map_filter(F.from_json(target, "map<string,variant>"), lambda k, _: k != field), F.map_filter(F.from_json(source, "map<string,variant>"), lambda k, _: k == field)))


def settings_branch(exists: Column, template_has: Column, current_has: Column, force: Column) -> Column:
    """What becomes of a settings file: created, skipped, kept, replaced or merged."""
    return F.when(~exists, "created").when(~template_has, "skipped").when(current_has & ~force, "kept").when(current_has, "replaced").otherwise("merged")


def empty_args(args: Column) -> Column:
    """Whether an argument is empty, which an unresolved variable leaves behind; null is none."""
    return F.coalesce(F.exists(args, lambda x: F.coalesce(x, F.lit("")) == ""), F.lit(False))
