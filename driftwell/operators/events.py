"""Raw event payloads to rows: parsing, routing, whose report it is, and the gate's decision with git facts.

A payload that is empty or no JSON object yields no row, never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.text import computed, first_filled
from driftwell.operators import sessions

#: Fields that may name the instance of a report, in order; fixed values.
INSTANCE_FIELDS = ("agent_id", "agent_session_id", "subagent_id", "task_id", "agent_transcript_path")
#: Event, what its tool name must match (null: anything), handler. Fixed values.
ROUTES = (("Stop", None, "gate"), ("PostToolUse", "Task|Agent", "record"), ("SubagentStop", None, "record"), ("SessionStart", None, "context"), ("PreToolUse", "Write|Edit", "hint"))
REVIEWER = "peer-review-critic"


def payloads(df: DataFrame, raw: str = "payload") -> DataFrame:
    """df's other columns and v, the payload as a variant; rows without a JSON object drop out."""
    v = F.try_parse_json(F.trim(F.col(raw)))
    return df.withColumn("v", v).where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))).drop(raw)


def field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def or_default(c: Column, default: Column | str | bool) -> Column:
    """The alternative operator: null and false count as absent."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c.cast("string") == "false"), d).otherwise(c)


def cleaned(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "")


def routed(df: DataFrame, routes: Sequence[tuple[str, str | None, str]] = ROUTES) -> DataFrame:
    """df (with v) and handler: one row for each route that takes the event; events without one drop out."""
    name, tool = F.coalesce(field("hook_event_name"), F.lit("")), F.coalesce(field("tool_name"), F.lit(""))
    hit = [F.when((name == e) & (F.lit(True) if m is None else tool.rlike(rf"\A(?:{m})\z")), F.lit(h)) for e, m, h in routes]
    return df.withColumn("handler", F.explode(F.array_distinct(F.array_compact(F.array(*hit)))))


def allowed(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows with an allowed name; others drop out silently."""
    return df.where(F.col(column).isin(list(names)))


def is_agent(c: Column, name: str = REVIEWER, prefixes: Sequence[str] = ()) -> Column:
    """Whether an agent type is this one, without case, with or without one of the prefixes."""
    return F.lower(c).isin([name.lower(), *(f"{p}:{name}".lower() for p in prefixes)])


def reviews(df: DataFrame, name: str = REVIEWER, prefixes: Sequence[str] = ()) -> DataFrame:
    """df's other columns and session, verdict, instance, cwd of each report of the reviewer; others drop out.

    The event SubagentStop has its agent and text in fields of its own, others in the tool's."""
    own = F.coalesce(field("hook_event_name"), F.lit("")) == "SubagentStop"
    who = F.when(own, field("agent_type")).otherwise(field("tool_input.subagent_type"))
    filled = lambda p: F.when(field(p, "variant").isNotNull() & ~F.coalesce(field(p) == "", F.lit(False)), field(p, "variant"))
    text = F.when(own, field("last_assistant_message")).otherwise(sessions.text_of(F.coalesce(filled("tool_response"), filled("tool_output"))))
    instance = F.when(own, first_filled(*[field(x) for x in INSTANCE_FIELDS])).otherwise(field("tool_use_id"))
    out = df.where(is_agent(F.coalesce(who, F.lit("")), name, prefixes)).withColumns({"session": cleaned(F.coalesce(field("session_id"), F.lit(""))), "verdict": sessions.verdict_of(text), "instance": F.nullif(cleaned(instance), F.lit("")), "cwd": field("cwd")})
    return out.where("session <> ''").drop("v")


def stops(df: DataFrame) -> DataFrame:
    """df's other columns and session, continuation, cwd of each stop event."""
    out = df.withColumns({"session": cleaned(F.coalesce(field("session_id"), F.lit(""))), "continuation": or_default(field("stop_hook_active", "boolean"), False), "cwd": field("cwd")})
    return out.where("session <> ''").drop("v")


def to_fold(df: DataFrame, facts: DataFrame, gate_open: Column, name: str = REVIEWER, prefixes: Sequence[str] = ()) -> DataFrame:
    """Events (event_id, ts, payload) as the session fold takes them: reviews and stops with what git says of their folder; df may be a stream.

    facts: a row for each cwd, with the columns that gate_open and head need; a folder
    without facts has no head and never lets a stop be blocked.  A payload is parsed once
    and its fields are read once, before anything is filtered by them."""
    parsed = computed(df.select("event_id", "ts", "payload"), v=F.try_parse_json(F.trim("payload")))
    parsed = parsed.where(F.col("v").isNotNull() & F.startswith(F.trim("payload"), F.lit("{"))).drop("payload")
    event, tool = F.coalesce(field("hook_event_name"), F.lit("")), F.coalesce(field("tool_name"), F.lit(""))
    own = event == "SubagentStop"
    takes = lambda handler: F.greatest(F.lit(False), *[(event == e) & (F.lit(True) if m is None else tool.rlike(rf"\A(?:{m})\z")) for e, m, h in ROUTES if h == handler])
    seen = computed(
        parsed,
        kind=F.when(takes("gate"), "stop").when(takes("record"), "review"),
        own=own,
        session=cleaned(F.coalesce(field("session_id"), F.lit(""))),
        who=F.coalesce(F.when(own, field("agent_type")).otherwise(field("tool_input.subagent_type")), F.lit("")),
        instance=F.when(own, first_filled(*[field(x) for x in INSTANCE_FIELDS])).otherwise(field("tool_use_id")),
        cwd=field("cwd"),
        continuation=or_default(field("stop_hook_active", "boolean"), False),
    ).where("kind is not null and session <> ''")
    review = F.col("kind") == "review"
    seen = seen.where(~review | is_agent(F.col("who"), name, prefixes))
    filled = lambda p: F.when(field(p, "variant").isNotNull() & ~F.coalesce(field(p) == "", F.lit(False)), field(p, "variant"))
    said = computed(seen, answer=F.when(review & ~F.col("own"), F.coalesce(filled("tool_response"), filled("tool_output"))), message=F.when(review & F.col("own"), field("last_assistant_message"))).drop("v")
    text = F.when(F.col("own"), F.col("message")).otherwise(sessions.text_of(F.col("answer")))
    rows = said.select(
        "event_id", "session", "ts", "kind",
        F.when(review, sessions.verdict_of(text)).alias("verdict"),
        F.when(review, F.nullif(cleaned(F.col("instance")), F.lit(""))).alias("instance"),
        "cwd",
        (~review & F.col("continuation")).alias("continuation"),
    )
    known = facts.select(F.col("cwd"), "head", F.coalesce(gate_open, F.lit(False)).alias("facts_ok"))
    return rows.join(known, "cwd", "left").withColumn("facts_ok", F.coalesce("facts_ok", F.lit(False)))


def decision(reason: Column) -> Column:
    """A block, as the compact JSON that the host reads; its keys keep their order."""
    return F.to_json(F.struct(F.lit("block").alias("decision"), reason.alias("reason")))


def audit(events: DataFrame, folded: DataFrame) -> DataFrame:
    """(event_id, ts, guard, old, new, head) for each suppressed report; '-' stands for what is not known."""
    guards = folded.where(F.col("action").isin("instance-dedupe", "same-head-approve")).select("event_id", F.col("action").alias("guard"), F.coalesce("verdict", F.lit("-")).alias("old"))
    return guards.join(events.select("event_id", "ts", F.col("verdict").alias("new"), F.coalesce("head", F.lit("-")).alias("head")), "event_id")
