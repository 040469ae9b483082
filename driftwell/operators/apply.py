"""Plans that are carried out: what a plan removes from settings texts, and files replaced in two phases.

Phase one writes all new texts beside their places as a Spark job, reads them back and
compares; nothing has changed until then.  Phase two renames: the old file to its backup,
the new one to its place.  A failure undoes what was renamed.  Contents never pass the
driver, which only renames; a journal written before phase two lets another session undo it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators.merge import canonical
from driftwell.sources.shared import removed, shared_dir


def _without(text: str, gone: list[tuple[str, int, int]]) -> str:
    """A settings text less the entries (event, group, place); groups, events and a hooks block that they leave empty go too, all else stays in its order."""
    settings = json.loads(text)
    drop = set(gone)
    hooks = {}
    for event, groups in settings["hooks"].items():
        left = []
        for g, group in enumerate(groups):
            if isinstance(group, dict) and isinstance(group.get("hooks"), list):
                inner = [h for i, h in enumerate(group["hooks"]) if (event, g, i) not in drop]
                if inner:
                    left.append({**group, "hooks": inner})
            elif (event, g, 0) not in drop:
                left.append(group)
        if left:
            hooks[event] = left
    settings["hooks"] = hooks
    if not hooks:
        del settings["hooks"]
    return json.dumps(settings, ensure_ascii=False, indent=2)


def hook_edits(settings: DataFrame, plan: DataFrame, key: str = "path", raw: str = "text") -> DataFrame:
    """(key, before, after, n_removed) of each settings text that a hook plan changes: what would be written, by a dry run and by the real one alike.

    plan: migrate.hook_plan over settings.  A group keeps its matcher and its other fields;
    texts that are no JSON have no plan and are not touched."""
    gone = plan.where("action = 'remove'").groupBy(key).agg(F.to_json(F.collect_list(F.struct("event", "grp", "pos"))).alias("gone"), F.count("*").alias("n_removed"))

    @F.pandas_udf("string")
    def run(text, gone):
        return text.combine(gone, lambda t, g: _without(t, [(x["event"], x["grp"], x["pos"]) for x in json.loads(g)]))

    return settings.join(gone, key).select(key, F.col(raw).alias("before"), run(F.col(raw), F.col("gone")).alias("after"), "n_removed")


class Staged:
    """New texts that lie ready: ``commit`` puts them in place or changes nothing, ``undo`` takes a commit back."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _fs(self, path: str):
        where = self._hadoop.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def move(self, old: str, new: str) -> None:
        fs, where = self._fs(old)
        if not fs.rename(where, self._hadoop.Path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def journal(self) -> Iterator[tuple[str, str | None, str]]:
        """(place, new file or None for a removal, backup) of each file, a row at a time."""
        for r in self.spark.read.parquet(f"{self.folder}/journal").toLocalIterator():
            yield r["path"], r["file"], r["backup"]

    def commit(self) -> int:
        """Renames all; says how many files.  On a failure what was renamed is undone and the failure goes on."""
        n = 0
        try:
            for path, file, backup in self.journal():
                if self.exists(path):
                    self.move(path, backup)
                if file is not None:
                    self.move(file, path)
                n += 1
        except Exception:
            self.undo()
            raise
        return n

    def undo(self) -> int:
        """Brings back each file that has a backup and takes away new ones that had no file before; says how many. Safe to repeat."""
        n = 0
        for path, file, backup in self.journal():
            if file is not None and not self.exists(file) and self.exists(path):
                self.move(path, file)
                n += 1
            if self.exists(backup) and not self.exists(path):
                self.move(backup, path)
        return n

    def drop(self) -> None:
        removed(self.spark, self.folder)


def staged(edits: DataFrame, key: str = "path", text: str = "after", same: Column | None = None) -> Staged:
    """Phase one for (key: place of the file, text: what it shall hold; null: that it goes): written, read back and compared.

    Texts end with one newline.  same: whether `back` says what `text` says (by default as
    JSON, whatever its order).  Raises ValueError and leaves nothing where they differ, or
    where a place comes twice."""
    spark = edits.sparkSession
    run = uuid.uuid4().hex
    out = Staged(spark, f"{shared_dir(spark)}/staged-{run}")
    wanted = edits.select(F.col(key).alias("path"), F.regexp_replace(F.col(text), r"\n\z", "").alias("text"), F.sha2(F.col(key).cast("binary"), 256).alias("id"))
    twice = wanted.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("a file is to be written twice")
    try:
        new = wanted.where("text is not null")
        if new.isEmpty():  # removals only
            back = spark.createDataFrame([], "id string, file string, back string")
        else:
            new.select("text", "id").write.partitionBy("id").text(f"{out.folder}/files")
            back = _read_back(spark, out.folder)
        says = same if same is not None else canonical(F.col("back")).eqNullSafe(canonical(F.col("text"))) & canonical(F.col("text")).isNotNull()
        pairs = new.join(back, "id", "left")
        if not pairs.where(~F.coalesce(says, F.lit(False))).isEmpty():
            raise ValueError("what was written does not read back the same")
        places = wanted.join(back.select("id", "file"), "id", "left").select("path", "file", F.concat("path", F.lit(f".bak-{run[:12]}")).alias("backup"))
        places.write.parquet(f"{out.folder}/journal")
    except Exception:
        out.drop()
        raise
    return out


def _read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(id, file, back) of the staged files."""
    read = spark.read.schema("value string, id string").text(f"{folder}/files", wholetext=True)
    return read.select("id", F.input_file_name().alias("file"), F.regexp_replace("value", r"\n\z", "").alias("back"))
