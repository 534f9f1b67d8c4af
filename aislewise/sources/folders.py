"""Folders of a file system that Spark reaches, from the driver: listing, age and removal of partitions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _of(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    p, fs = _of(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> bool:
    p, fs = _of(spark, path)
    return fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file; folders above the target are made."""
    old, fs = _of(spark, source)
    new, _ = _of(spark, target)
    fs.mkdirs(new.getParent())
    return fs.rename(old, new)


def drop_expired_days(spark: SparkSession, path: str, today: date, keep_days: int = 30, column: str = "received_date") -> list[date]:
    """Removes the day partitions of a log that are past their retention, and says which.

    Days are read from the folder names, so no file is opened; a folder of another name, or of no date, stays.
    """
    gone = []
    for name in children(spark, path):
        key, _, value = name.partition("=")
        try:
            day = date.fromisoformat(value)
        except ValueError:
            continue
        if key == column and day < today - timedelta(days=keep_days) and remove(spark, f"{path}/{name}"):
            gone.append(day)
    return gone
