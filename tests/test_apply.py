"""Plans applied to files: the same plan dry and real, matchers kept, verified, undone on failure."""

import json
import os

import pytest
from pyspark.sql import functions as F

from driftwell.operators import apply, migrate

OLD = ["old.sh", "old.ps1"]


def settings(i):
    hooks = {
        "Stop": [{"matcher": f"m{i}", "note": i, "hooks": [{"command": "sh /x/Old.sh", "timeout": 1}, {"command": f"mine {i}"}]}, {"hooks": [{"command": "pwsh", "args": ["-File", "C:\\x\\old.ps1"]}]}],
        "Flat": ["old.sh", {"command": '"/y/old.sh"'}],
        "Other": ["sh old.sh.bak", {"command": "my-old.sh"}],
    }
    return {"z": i, "hooks": hooks if i % 4 else {"Stop": ["old.sh"]}, "a": {"é": [1, 2.5, None]}}


def left(i):
    if i % 4 == 0:
        return {"z": i, "a": {"é": [1, 2.5, None]}}
    return {"z": i, "hooks": {"Stop": [{"matcher": f"m{i}", "note": i, "hooks": [{"command": f"mine {i}"}]}], "Other": ["sh old.sh.bak", {"command": "my-old.sh"}]}, "a": {"é": [1, 2.5, None]}}


@pytest.fixture
def files(tmp_path):
    out = {}
    for i in range(20):
        p = tmp_path / f"u{i}" / "settings.json"
        p.parent.mkdir()
        p.write_text(json.dumps(settings(i)) if i != 7 else "{broken")
        out[i] = p
    return out


def planned(spark, files):
    df = spark.createDataFrame([(f"file://{p}", p.read_text()) for p in files.values()], "path string, text string").repartition(4)
    plan = migrate.hook_plan(df, OLD)
    return df, plan, apply.hook_edits(df, plan)


def test_dry_run_says_what_is_written(spark, files):
    before = {i: p.read_text() for i, p in files.items()}
    _, plan, edits = planned(spark, files)
    told = {r["path"]: r for r in edits.collect()}
    assert {i: p.read_text() for i, p in files.items()} == before and len(told) == 19  # nothing is written, the broken one has no plan
    ready = apply.staged(edits)
    assert {i: p.read_text() for i, p in files.items()} == before
    assert ready.commit() == 19
    for i, p in files.items():
        if i == 7:
            assert p.read_text() == "{broken"
            continue
        assert p.read_text() == told[f"file://{p}"]["after"] + "\n"
        got = json.loads(p.read_text())
        assert got == left(i) and list(got) == list(left(i))
        (backup,) = p.parent.glob("settings.json.bak-*")
        assert backup.read_text() == before[i]
    assert ready.undo() == 19
    assert {i: p.read_text() for i, p in files.items()} == before
    ready.drop()


def test_left_hooks_keep_matchers(spark, files):
    _, plan, _ = planned(spark, {1: files[1]})
    got = {r["event"]: [(g["matcher"], [json.loads(h) if h.startswith("{") else h for h in g["hooks"]]) for g in r["groups"]] for r in migrate.left_hooks(plan, "path").collect()}
    assert got == {"Stop": [("m1", [{"command": "mine 1"}])], "Other": [(None, ["sh old.sh.bak"]), (None, [{"command": "my-old.sh"}])]}


def test_failure_halfway_is_undone(spark, files, monkeypatch):
    before = {i: p.read_text() for i, p in files.items()}
    ready = apply.staged(planned(spark, files)[2])
    real, moves = apply.Staged.move, []

    def fails(self, old, new):
        moves.append(new)
        if len(moves) == 15:
            raise OSError("full")
        real(self, old, new)

    monkeypatch.setattr(apply.Staged, "move", fails)
    with pytest.raises(OSError, match="full"):
        ready.commit()
    assert {i: p.read_text() for i, p in files.items()} == before
    assert not [x for p in files.values() for x in p.parent.glob("*.bak-*")]
    monkeypatch.setattr(apply.Staged, "move", real)
    assert ready.commit() == 19 and json.loads(files[1].read_text()) == left(1)


def test_another_session_undoes(spark, files):
    """What a dead session has renamed is undone from its journal."""
    before = {i: p.read_text() for i, p in files.items()}
    ready = apply.staged(planned(spark, files)[2])
    path, file, backup = next(ready.journal())
    ready.move(path, backup)  # died between the two renames
    apply.Staged(spark, ready.folder).undo()
    assert {i: p.read_text() for i, p in files.items()} == before


def test_what_reads_back_otherwise_is_not_applied(spark, files, tmp_path):
    before = {i: p.read_text() for i, p in files.items()}
    edits = planned(spark, files)[2]
    with pytest.raises(ValueError, match="read back"):
        apply.staged(edits, same=F.col("back") == F.lit("other"))
    with pytest.raises(ValueError, match="read back"):
        apply.staged(edits.withColumn("after", F.lit("{no json")))
    with pytest.raises(ValueError, match="twice"):
        apply.staged(edits.unionByName(edits))
    assert {i: p.read_text() for i, p in files.items()} == before


def test_removals_and_new_files(spark, tmp_path):
    old, new = tmp_path / "old.txt", tmp_path / "new.txt"
    old.write_text("x\n")
    edits = spark.createDataFrame([(f"file://{old}", None), (f"file://{new}", "line\n")], "path string, after string")
    ready = apply.staged(edits, same=F.col("back") == F.col("text"))
    assert ready.commit() == 2 and not old.exists() and new.read_text() == "line\n"
    ready.undo()
    assert old.read_text() == "x\n" and not new.exists()
    ready = apply.staged(edits.where("after is null"))
    assert ready.commit() == 1 and not os.path.exists(old)
    assert apply.staged(edits.where("false")).commit() == 0
