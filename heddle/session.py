"""Session builder and the shared working folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on; keyword dots are written as double underscores."""
    builder = SparkSession.builder.appName("heddle")
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (local tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="heddle-checkpoint-"))
    return sc.getCheckpointDir()


def shared_uri(spark: SparkSession, name: str) -> str:
    """The URI of a folder below the shared one, on the file system that Spark itself takes for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def cut(df):
    """Materialise ``df`` with checkpoint() in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def freed(spark: SparkSession) -> None:
    """Lets go the files of shuffles and checkpoints that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
