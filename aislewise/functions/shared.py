"""Results written once to the folder that driver and executors share, so that a plan that needs them often reads files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir, removed when the driver's Python ends.

    Where it is unset a local session takes a temporary folder; on a cluster that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="aislewise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/aislewise/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already
        pass


def dealt_by(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """df dealt by keys to so many tasks that one holds about `rows` rows, and no fewer than the session's shuffle partitions.

    For groups of nearly as many keys as rows, which would fill a task's memory before they are dealt and again after. Up
    to 200 partitions Spark writes a shuffle straight to its files; more would collect the rows in memory to sort them.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(200, -(-df.count() // rows)))
    return df.repartition(n, *keys)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df evaluated once: written to the shared folder and read from there, whichever executor is lost."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
