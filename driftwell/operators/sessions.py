"""Keyed event streams folded into verdict state and gate decisions.

One pure step serves the batch fold and the stream.  In batch, rows are dealt by session
and sorted; state is carried from row to row, so a session of any length needs memory for
its state only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPROVED, CHANGES = "APPROVED", "CHANGES_REQUIRED"
#: A verdict line, as a Java pattern. Fixed value.
VERDICT = r"(?m)^[ \t]*VERDICT:[ \t]*(APPROVED|CHANGES_REQUIRED)[ \t]*$"
#: Seconds of silence after which a session's state is dropped.
TTL_S = 7 * 24 * 3600
#: Blocks allowed in a session without review, and with changes required (one counter).
BUDGET_NONE, BUDGET_CHANGES = 1, 3
#: Extension, technology, agent. Fixed values.
HINTS = (
    (".rs", "Rust", "rust-expert"),
    (".py", "Python", "python-expert"),
    (".ts", "TypeScript", "typescript-expert"),
    (".tsx", "TypeScript/React", "typescript-expert"),
    (".js", "JavaScript", "typescript-expert"),
    (".jsx", "JavaScript/React", "typescript-expert"),
    (".cs", "C#/.NET", "csharp-expert"),
    (".go", "Go", "go-expert"),
    (".java", "Java", "java-expert"),
    (".sh", "Bash/Shell", "bash-expert"),
    (".ps1", "PowerShell", "powershell-expert"),
    (".sql", "SQL/Database", "database-specialist"),
    (".mq5", "MQL5", "mql-trading-dev"),
    (".mq4", "MQL4", "mql-trading-dev"),
    (".mqh", "MQL include", "mql-trading-dev"),
)


@dataclass
class State:
    """What is known of a session: whether anything was recorded, the verdict and its head, ids consumed, blocks spent."""

    marker: bool = False
    verdict: str | None = None
    head: str | None = None
    ids: set[str] = field(default_factory=set)
    blocks: int = 0


def record(s: State, verdict: str | None, instance: str | None, head: str | None) -> str:
    """Takes one review event into the state; returns write, keep, or the guard that suppressed it."""
    same = not s.head or not head or s.head == head
    if not verdict:
        if s.verdict:
            return "keep"
        s.marker, s.head = True, None
        return "write"
    if instance and instance in s.ids and same:
        return "instance-dedupe"
    if not instance and s.verdict and s.verdict != verdict == APPROVED and same:
        return "same-head-approve"
    s.marker, s.verdict, s.head = True, verdict, head or None
    if instance:
        s.ids.add(instance)
    return "write"


def gate(s: State, facts_ok: bool = True, continuation: bool = False) -> str:
    """block or allow for one stop event; facts_ok: in a worktree, on a named branch off the main line, ahead of its base, clean."""
    if continuation or (s.marker and s.verdict != CHANGES):
        return "allow"
    if s.blocks >= (BUDGET_CHANGES if s.verdict == CHANGES else BUDGET_NONE) or not facts_ok:
        return "allow"
    s.blocks += 1
    return "block"


def step(s: State, kind: str, verdict: str | None, instance: str | None, head: str | None, facts_ok: bool = True, continuation: bool = False) -> str:
    return gate(s, facts_ok, continuation) if kind == "stop" else record(s, verdict, instance, head)


OUT = "event_id long, session string, action string, verdict string, head string, blocks long"


def prepared(events: DataFrame) -> DataFrame:
    """Events as the fold reads them: ids cut to letters, digits, '_' and '-', rows without a session dropped, facts_ok (true) and continuation (false) where they are not there."""
    keep = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_-]", "")
    flag = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c) if c in events.columns else F.lit(d).alias(c)
    return events.select("event_id", keep("session").alias("session"), "ts", "kind", "verdict", F.nullif(keep("instance"), F.lit("")).alias("instance"), "head", flag("facts_ok", True), flag("continuation", False)).where("session <> ''")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone (the latter as UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def fold(events: DataFrame, ttl_s: float | None = None) -> DataFrame:
    """events: event_id, session, ts, kind (stop or other), verdict, instance, head, and if given facts_ok and continuation.  One row an event: what was done and the state after it.

    Order within a session is ts, then event_id.  With ttl_s the state is dropped where a
    session was silent for longer than so many seconds; a stretch between such gaps begins
    anew.  An ordered fold takes the events of a session one after the other, so a session
    is one task's work, in constant memory but for its instance ids.
    """
    keyed = prepared(events).withColumn("us", F.lit(None).cast("long") if ttl_s is None else micros(F.col("ts")))
    most = None if ttl_s is None else round(ttl_s * 1_000_000)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s, last = None, State(), 0
        for f in frames:
            f = f.astype(object).where(f.notna(), None)
            out = []
            for e, session, kind, v, i, h, ok, again, us in zip(f.event_id, f.session, f.kind, f.verdict, f.instance, f["head"], f.facts_ok, f.continuation, f.us, strict=True):
                if session != now or (most is not None and us is not None and last is not None and us - last > most):
                    now, s = session, State()
                last = us
                done = step(s, kind, v, i, h, ok, again)
                out.append((e, session, done, s.verdict, s.head, s.blocks))
            yield pd.DataFrame(out, columns=["event_id", "session", "action", "verdict", "head", "blocks"])

    return keyed.repartition("session").sortWithinPartitions("session", "ts", "event_id").mapInPandas(run, OUT)


def verdict_of(text: Column) -> Column:
    """The last verdict line of a report."""
    return F.try_element_at(F.regexp_extract_all(F.translate(text, "\r", ""), F.lit(VERDICT), F.lit(1)), F.lit(-1))


def text_of(response: Column) -> Column:
    """Text of a variant: a string; an array of strings or {text}; an object with such an array as content."""
    kind = F.schema_of_variant(response)
    parts = lambda v, path: F.array_join(F.filter(F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))), lambda x: x.isNotNull()), "\n")
    return F.when(kind == "STRING", F.try_variant_get(response, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), parts(response, "$")).when(F.startswith(kind, F.lit("OBJECT")), parts(response, "$.content"))


def hints(events: DataFrame, session: str, path: str, order: list[str]) -> DataFrame:
    """The first hint for each (session, agent): technology and agent of the file's extension; unknown ones drop out."""
    table = F.create_map(*[F.lit(x) for e, t, a in HINTS for x in (e, f"{t}\t{a}")])
    hit = F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]*)\z", 1)))
    rows = events.withColumn("h", hit).where("h is not null").withColumns({"tech": F.split_part("h", F.lit("\t"), F.lit(1)), "agent": F.split_part("h", F.lit("\t"), F.lit(2))}).drop("h")
    rest = [c for c in rows.columns if c not in (session, "agent")]
    return rows.groupBy(session, "agent").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(session, "agent", "r.*")


def expired(df: DataFrame, ts: str, reference: Column, days: int = 7) -> DataFrame:
    return df.where(F.col(ts) < reference - F.make_dt_interval(F.lit(days)))


def clean_id(text: str) -> str:
    return re.sub("[^A-Za-z0-9_-]", "", text)
