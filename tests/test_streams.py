"""The session fold as a stream against the batch fold: shuffled micro-batches, late events, expiry."""

import datetime
import json
import os
import random

import pytest

from driftwell.operators import sessions
from driftwell.streaming.sessions import stream_fold

SCHEMA = "event_id long, session string, ts timestamp_ntz, kind string, verdict string, instance string, head string"
START = datetime.datetime(2024, 1, 1)


def some_events(seed, n, days):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = START + datetime.timedelta(seconds=rng.randrange(days * 86400), microseconds=rng.randrange(3) * 500)
        kind = rng.choice(["review", "review", "stop"])
        verdict = rng.choice([sessions.APPROVED, sessions.CHANGES, None]) if kind == "review" else None
        out.append((i, f"s{rng.randrange(6)}", at, kind, verdict, rng.choice([None, "a", "b", f"i{i}"]), rng.choice([None, "h1", "h2"])))
    return sorted(out, key=lambda r: r[2])


def told(rows):
    return sorted((r["event_id"], r["session"], r["action"], r["verdict"], r["head"], r["blocks"]) for r in rows)


def streamed(spark, tmp_path, batches, name, **more):
    """The stream's rows when the batches come one by one."""
    src = tmp_path / "in"
    src.mkdir()
    frame = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    for i, batch in enumerate(batches):
        file = src / f"{i:03}.json"
        file.write_text("\n".join(json.dumps(dict(zip(("event_id", "session", "ts", "kind", "verdict", "instance", "head"), (*r[:2], r[2].isoformat(), *r[3:]), strict=True))) for r in batch))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    q = stream_fold(frame, **more).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240)
    finally:
        q.stop()
    return spark.table(name).collect()


#: An event of a session of its own, far ahead, that lets the watermark pass all others.
END = (10**6, "end", START + datetime.timedelta(days=400), "review", None, None, None)


@pytest.mark.parametrize("ttl_s", [None, 6 * 3600])
def test_shuffled_batches_give_the_batch_fold(spark, tmp_path, ttl_s):
    events = some_events(1, 240, 10)
    batches, rng = [events[i : i + 60] for i in range(0, 240, 60)], random.Random(2)
    mixed = [[] for _ in range(4)]
    for i, b in enumerate(batches):
        for r in b:  # some come a batch later than their time
            mixed[min(3, i + rng.randrange(2))].append(r)
    for b in mixed:
        rng.shuffle(b)
    got = [r for r in streamed(spark, tmp_path, [*mixed, [END]], f"mixed{ttl_s or 0}", ttl_s=ttl_s, delay="12 days") if r["session"] != "end"]
    assert told(got) == told(sessions.fold(spark.createDataFrame(events, SCHEMA), ttl_s=ttl_s).collect())


def test_late_events_are_told_apart(spark, tmp_path):
    events = some_events(3, 90, 9)
    late = [events[5], events[17]]
    rest = [r for r in events if r not in late]
    got = streamed(spark, tmp_path, [rest[:60], rest[60:], late, [END]], "late", ttl_s=None, delay="1 minute")
    assert sorted(r["event_id"] for r in got if r["action"] == "late") == sorted(r[0] for r in late)
    done = [r for r in got if r["action"] != "late" and r["session"] != "end"]
    assert told(done) == told(sessions.fold(spark.createDataFrame(rest, SCHEMA)).collect())


def test_state_goes_when_a_session_was_silent(spark, tmp_path):
    at = lambda h: START + datetime.timedelta(hours=h)
    events = [(1, "a", at(0), "review", sessions.CHANGES, "i", "h"), (2, "a", at(24), "review", sessions.APPROVED, None, "h"), (3, "a", at(49), "review", sessions.APPROVED, "i", "h"), (4, "b", at(60), "stop", None, None, None), (5, "a", at(80), "stop", None, None, None)]
    want = {1: "write", 2: "same-head-approve", 3: "write", 4: "block", 5: "block"}
    batch = sessions.fold(spark.createDataFrame(events, SCHEMA), ttl_s=24 * 3600).collect()
    assert {r["event_id"]: r["action"] for r in batch} == want
    got = streamed(spark, tmp_path, [[e] for e in [*events, END]], "silent", ttl_s=24 * 3600, delay="1 second")
    assert {r["event_id"]: r["action"] for r in got if r["session"] != "end"} == want
    # nothing is kept of a session beyond its time: the state store holds the last session only
    kept = spark.read.format("statestore").option("stateVarName", "known").load(str(tmp_path / "c")).collect()
    assert len(kept) <= 1


def raw_payloads(n, seed):
    """(event_id, ts, payload): raw hook payloads, some broken, and the folder facts they need."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = (START + datetime.timedelta(minutes=20 * i)).isoformat()
        base = {"session_id": f"s {rng.randrange(3)}", "cwd": rng.choice(["/w/a", "/w/b", "/gone"])}
        said = rng.choice(["VERDICT: APPROVED", "x\r\n VERDICT: CHANGES_REQUIRED \r\n", "nothing"])
        kind = rng.randrange(4)
        if kind == 0:
            p = {**base, "hook_event_name": "Stop", "stop_hook_active": rng.choice([True, False, None])}
        elif kind == 1:
            p = {**base, "hook_event_name": "SubagentStop", "agent_type": rng.choice(["peer-review-critic", "other"]), "last_assistant_message": said, "agent_id": rng.choice(["", "a1", "a2"])}
        elif kind == 2:
            p = {**base, "hook_event_name": "PostToolUse", "tool_name": "Task", "tool_input": {"subagent_type": "kit:Peer-Review-Critic"}, "tool_response": {"content": [{"text": said}]}, "tool_use_id": f"t{rng.randrange(4)}"}
        else:
            p = {**base, "hook_event_name": "PreToolUse"}
        out.append({"event_id": i, "ts": at, "payload": '{"session_id": ' if i % 11 == 5 else json.dumps(p)})
    return out


def test_raw_payloads_to_gate_in_one_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from driftwell.operators import events

    rows, schema = raw_payloads(120, 4), "event_id long, ts timestamp_ntz, payload string"
    end = {"event_id": 10**6, "ts": END[2].isoformat(), "payload": json.dumps({"session_id": "end", "hook_event_name": "Stop"})}
    facts = spark.createDataFrame([("/w/a", "h1", True), ("/w/b", "h2", False)], "cwd string, head string, ok boolean")
    src = tmp_path / "in"
    src.mkdir()
    shuffled = random.Random(1).sample(rows[:60], 60) + random.Random(2).sample(rows[60:], 60)
    for i, part in enumerate([shuffled[:40], shuffled[40:80], shuffled[80:], [end]]):
        file = src / f"{i}.json"
        file.write_text("\n".join(map(json.dumps, part)))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    folded = stream_fold(events.to_fold(raw, facts, F.col("ok"), prefixes=["kit"]), ttl_s=5 * 3600, delay="3 days")
    q = folded.writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    batch = spark.createDataFrame([(r["event_id"], datetime.datetime.fromisoformat(r["ts"]), r["payload"]) for r in rows], schema)
    want = told(sessions.fold(events.to_fold(batch, facts, F.col("ok"), prefixes=["kit"]), ttl_s=5 * 3600).collect())
    assert told(r for r in spark.table("gated").collect() if r["session"] != "end") == want
    assert len({r[2] for r in want}) >= 5  # writes, keeps, guards and both decisions


def folded_rows(spark, events):
    """The batch fold in the shape of the stream's rows."""
    df = spark.createDataFrame(events, SCHEMA)
    return sessions.fold(df).join(df.selectExpr("event_id", "unix_micros(cast(ts as timestamp)) as us", "verdict as new", "head as new_head", "instance"), "event_id")


def test_a_batch_that_fails_halfway_is_written_once(spark, tmp_path, monkeypatch):
    from driftwell.streaming import commits

    root = f"file://{tmp_path}/log"
    rows = folded_rows(spark, some_events(5, 200, 4)).persist()
    want = sorted(map(tuple, commits.log_rows(rows).collect()), key=str)
    assert {r[-1] for r in want} == {"audit", "consumed"}
    assert commits.committed(spark, root).collect() == []
    half = rows.where("event_id % 2 = 0")
    with monkeypatch.context() as m:
        m.setattr(commits, "created", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            commits.commit(half, 0, root)
    assert commits.committed(spark, root).isEmpty() or commits.committed(spark, root).count() == 0
    assert commits.commit(half, 0, root) and not commits.commit(half, 0, root)
    assert commits.commit(rows.where("event_id % 2 = 1"), 1, root)
    got = commits.committed(spark, root)
    assert sorted((tuple(r[c] for c in commits.log_rows(rows).columns) for r in got.collect()), key=str) == want
    assert commits.swept(spark, root) == 1 and commits.swept(spark, root) == 0
    assert commits.committed(spark, root).count() == len(want)
    rows.unpersist()


def test_two_runs_of_a_batch_at_a_time(spark, tmp_path, monkeypatch):
    """The second has looked before the first has its entry; its rows don't count."""
    from driftwell.streaming import commits

    root = f"file://{tmp_path}/log"
    rows = folded_rows(spark, some_events(6, 60, 2))
    assert commits.commit(rows, 3, root)
    monkeypatch.setattr(commits, "exists", lambda *_: False)
    assert not commits.commit(rows, 3, root)
    assert commits.committed(spark, root).count() == commits.log_rows(rows).count()


def test_stream_that_breaks_off_is_taken_up(spark, tmp_path, monkeypatch):
    """The writer dies once between the rows and the entry; the restarted query writes the batch again, and the log holds it once."""
    from driftwell.streaming import commits

    events = some_events(7, 150, 6)
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate([events[:75], events[75:], [END]]):
        file = src / f"{i}.json"
        file.write_text("\n".join(json.dumps(dict(zip(("event_id", "session", "ts", "kind", "verdict", "instance", "head"), (*r[:2], r[2].isoformat(), *r[3:]), strict=True))) for r in part))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = lambda: stream_fold(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src)), ttl_s=None, delay="1 hour")
    root, real, calls = f"file://{tmp_path}/log", commits.created, []

    def dies_once(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("lost")
        return real(*a)

    monkeypatch.setattr(commits, "created", dies_once)
    with pytest.raises(Exception, match="lost"):
        commits.logged(stream(), root, str(tmp_path / "c")).awaitTermination(240)
    assert commits.logged(stream(), root, str(tmp_path / "c")).awaitTermination(240)
    got = [r for r in commits.committed(spark, root).collect() if r["session"] != "end"]
    want = commits.log_rows(folded_rows(spark, events)).collect()
    assert sorted((r["kind"], r["event_id"], r["guard"] or "", r["old"] or "", r["new"] or "", r["head"] or "") for r in got) == sorted((r["kind"], r["event_id"], r["guard"] or "", r["old"] or "", r["new"] or "", r["head"] or "") for r in want)
