"""What a micro-batch writes, written once: the audit of suppressed reports and the instances consumed, as one commit.

A batch writes its rows to a folder of its own run and then creates the batch's entry among
the commits, which names that run.  An entry is created only where there is none, so of
runs of one batch (retries, a driver that comes back, two at a time) one counts; readers take
the rows of runs that an entry names, whatever else lies there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from driftwell.sources.shared import removed

GUARDS = ("instance-dedupe", "same-head-approve")
_ROWS = "event_id long, session string, us long, guard string, old string, new string, head string, instance string, run string, kind string"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _file_system(spark, path)
    return fs.exists(where)


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file of any Hadoop file system; False (and nothing changed) if there is one."""
    where, fs = _file_system(spark, path)
    fs.mkdirs(where.getParent())
    try:
        out = fs.create(where, False)
    except Exception:
        if fs.exists(where):
            return False
        raise
    try:
        out.write(text.encode())
    finally:
        out.close()
    return True


def log_rows(folded: DataFrame) -> DataFrame:
    """The stream fold's rows that are written: kind audit (a suppressed report) or consumed (an instance whose verdict was taken); '-' stands for what is not known."""
    dash = lambda c: F.coalesce(c, F.lit("-"))
    kind = F.when(F.col("action").isin(*GUARDS), "audit").when((F.col("action") == "write") & F.col("new").isNotNull() & F.col("instance").isNotNull(), "consumed")
    audit = kind == "audit"
    return folded.select("event_id", "session", "us", F.when(audit, F.col("action")).alias("guard"), F.when(audit, dash(F.col("verdict"))).alias("old"), F.when(audit, dash(F.col("new"))).alias("new"), F.when(audit, dash(F.col("new_head"))).alias("head"), "instance", kind.alias("kind")).where("kind is not null")


def commit(batch: DataFrame, batch_id: int, root: str) -> bool:
    """Writes a batch's log rows once under root; False if the batch is committed already.

    All rows go out in one job, so the batch is computed once; what a run left that did not
    come to its entry is no part of the log."""
    spark = batch.sparkSession
    entry = f"{root}/commits/{batch_id:012d}"
    if exists(spark, entry):
        return False
    run = f"{batch_id:012d}-{uuid.uuid4().hex}"
    log_rows(batch).write.partitionBy("kind").parquet(f"{root}/rows/run={run}")
    return created(spark, entry, run)


def committed(spark: SparkSession, root: str) -> DataFrame:
    """The rows of committed runs, with kind and run; of other runs nothing is read, as the entries prune the folders."""
    try:
        runs = spark.read.schema("run string").text(f"{root}/commits")
        rows = spark.read.schema(_ROWS).parquet(f"{root}/rows")
    except AnalysisException:  # nothing was ever committed
        return spark.createDataFrame([], _ROWS)
    return rows.join(runs, "run", "left_semi")


def swept(spark: SparkSession, root: str) -> int:
    """Removes the rows of runs without an entry of batches that have one; says of how many."""
    kept = {r["run"] for r in spark.read.schema("run string").text(f"{root}/commits").collect()}  # a row a batch, as the folders listed here
    batches = {k[:12] for k in kept}
    where, fs = _file_system(spark, f"{root}/rows")
    names = [s.getPath().getName().removeprefix("run=") for s in fs.listStatus(where)] if fs.exists(where) else []
    gone = [n for n in names if n[:12] in batches and n not in kept]
    for n in gone:
        removed(spark, f"{root}/rows/run={n}")
    return len(gone)


def logged(folded: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the query that writes a folded stream's log under root, each batch once."""
    return folded.writeStream.foreachBatch(lambda df, i: commit(df, i, root) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
