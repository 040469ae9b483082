"""Tables written to the folder that all machines share: a cut point, after which a lost executor costs one step."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset on a local master (tests), one of our own; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"driftwell-engine-{os.getpid()}")
    return path.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows; one that is gone is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        removed(spark, path)
    except Exception:  # the application may be gone already; the folder is the cluster's to clear then
        return


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet below the shared folder and read again; the shuffle files of its making go, the table goes when the application ends or by ``discarded``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    atexit.register(_at_exit, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def discarded(*tables: DataFrame) -> None:
    """Removes written tables that no later step reads."""
    for df in tables:
        removed(df.sparkSession, df._cut_path)
