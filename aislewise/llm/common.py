"""Shared-folder tables and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
ROWS_AT_ONCE = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a local session takes a temporary folder; on a cluster that is an error, as executors and driver
    would not see each other's files.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="aislewise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/aislewise/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended already
        pass


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again: its lineage ends there, whichever executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int = 8 << 20) -> DataFrame:
    """df marked for broadcast only where its counted rows fit into limit_bytes; else the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit_bytes else df


def spare_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it until no column of df has it (case ignored, as Spark compares)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def where_arrow(df: DataFrame, reads: list[str], make) -> DataFrame:
    """The rows of df for which the function that make() gives returns true; columns of any name stay as they are."""
    flag = spare_name(df, "passes")
    return with_arrow_columns(df, reads, f"{flag} boolean", make).where(F.col(flag)).drop(flag)


def with_arrow_columns(df: DataFrame, reads: list[str], added: str, make) -> DataFrame:
    """df with columns appended: make() is called once a task and gives a function from the read arrays to the new ones.

    Columns of df named like an added one are replaced. Names may hold dots or repeat each other's letters in another
    case: rows travel under positions.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType, _parse_datatype_string

    fields = _parse_datatype_string(added).fields
    new = [f.name for f in fields]
    names = [c for c in df.columns if c.lower() not in {n.lower() for n in new}]
    at = [next(i for i, c in enumerate(names) if c.lower() == r.lower()) for r in reads]
    plain = df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names]).toDF(*[f"c{i}" for i in range(len(names))])
    schema = StructType([*plain.schema.fields, *[type(f)(f"n{i}", f.dataType) for i, f in enumerate(fields)]])
    titles = schema.names

    def run(batches):
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):  # results of a few rows at a time: bounded memory
                part = batch.slice(start, ROWS_AT_ONCE)
                columns = [*part.columns, *work(*[part.column(i) for i in at])]
                yield pa.RecordBatch.from_arrays(columns, names=titles)

    return plain.mapInArrow(run, schema).toDF(*names, *new)
