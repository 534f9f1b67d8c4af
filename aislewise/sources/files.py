"""File scans and sinks."""

from __future__ import annotations

import time
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aislewise.functions.buckets import from_ms, local
from aislewise.functions.scans import Running, scan
from aislewise.schemas import ENVELOPE


def read_csv(spark: SparkSession, path: str, needed: list[str], sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """CSV files with header, all columns text (S1); ValueError if a needed column is missing.

    _file and _row say where a row stands: row numbers of each file from 2, blank lines not counted, also where a file is
    read in blocks. Rows of a block are numbered from the block's first row, blocks by the rows of those before them.
    """
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    rows = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    blocks = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # one row a block
    before = F.sum("_n").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    out = rows.join(F.broadcast(blocks), ["_file", "_block"])
    return out.select(*df.columns, F.element_at(F.split("_file", "/"), -1).alias("_file"), (F.col("_at") - F.col("_first") + F.col("_before") + 2).alias("_row"))


def read_json_document(spark: SparkSession, path: str, schema: str, at: str | None = None) -> DataFrame:
    """Rows of a JSON document: its array, or the array at a dotted path (S3)."""
    if at is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    wrapped = schema_at(schema, at)
    return spark.read.schema(wrapped).json(path, multiLine=True).select(F.inline(F.col(at)))


def schema_at(schema: str, at: str) -> str:
    inner = f"array<struct<{', '.join(f'{n}: {t}' for n, t in (c.strip().split(maxsplit=1) for c in schema.split(',')))}>>"
    first, *rest = at.split(".")
    for name in reversed(rest):
        inner = f"struct<{name}: {inner}>"
    return f"{first} {inner}"


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that can't be read is a row with _error, not a failure."""
    df = spark.read.schema(f"{schema}, _error string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_error")
    return df


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """CloudEvents as JSON lines; data stays JSON text. arrival orders lines within and across files."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    names = [c.split()[0] for c in ENVELOPE.split(", ")]
    return lines.select(*[F.get_json_object("value", f"$.{n}").alias(n) for n in names], F.monotonically_increasing_id().alias("arrival"))


def watch_folder(spark: SparkSession, folder: str, schema: str, pattern: str, done: str) -> DataFrame:
    """A stream over a drop folder; files are moved to `done` after the batch that has read them."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("cleanSource", "archive").option("sourceArchiveDir", done).option("maxFilesPerTrigger", 100).json(folder)


def take_settled(spark: SparkSession, folder: str, pattern: str, work: str, min_age_s: float = 5.0) -> list[str]:
    """Moves files that have not changed for min_age_s from a drop folder to `work`; their new paths.

    A file that is still being written stays. The list is what one listing of the folder shows; contents are not read.
    """
    files, fs = _glob(spark, f"{folder}/{pattern}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(work))
    settled = [f for f in files if f.isFile() and f.getModificationTime() <= (time.time() - min_age_s) * 1000]
    moved = [(f.getPath(), path(f"{work}/{f.getPath().getName()}")) for f in sorted(settled, key=lambda f: f.getPath().getName())]
    return [str(new) for old, new in moved if fs.rename(old, new)]


def finish_files(spark: SparkSession, paths: list[str], bad: DataFrame, done: str, failed: str) -> tuple[list[str], list[str]]:
    """Moves read files to `done`, or to `failed` where a row of bad (_file: file name) is theirs."""
    names = {r[0] for r in bad.select("_file").distinct().collect()}  # names among the given paths
    path, out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, ([], [])
    for p in paths:
        source = path(p)
        fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        wrong = source.getName() in names
        target = path(f"{failed if wrong else done}/{source.getName()}")
        fs.mkdirs(target.getParent())
        fs.rename(source, target)
        out[wrong].append(str(target))
    return out


def _glob(spark: SparkSession, pattern: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(fs.globStatus(path) or []), fs


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks as Parquet; what was measured with is in the columns meta_*."""
    return spark.read.parquet(path)


def write_tracks(tracks: DataFrame, path: str, meta: dict[str, str]) -> None:
    tracks.withColumns({f"meta_{k}": F.lit(v) for k, v in meta.items()}).write.partitionBy("sequence").mode("append").parquet(path)


def read_mot_truth(spark: SparkSession, path: str, least_visibility: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(people, regions to ignore) of MOT ground-truth text files (S15): class 1 that counts, and seen enough, is people."""
    schema = "frame long, track_id long, left double, top double, width double, height double, consider int, cls int, visibility double"
    rows = spark.read.schema(schema).csv(path).withColumn("sequence", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))
    boxes = rows.select("sequence", "frame", "track_id", F.col("left").alias("x1"), F.col("top").alias("y1"), (F.col("left") + F.col("width")).alias("x2"), (F.col("top") + F.col("height")).alias("y2"), "consider", "cls", "visibility")
    people = (F.col("cls") == 1) & (F.col("consider") == 1) & (F.col("visibility") >= least_visibility)
    ignored = F.col("cls").isin(2, 7, 8, 12) | ((F.col("cls") == 1) & ~people)
    keep = ["sequence", "frame", "track_id", "x1", "y1", "x2", "y2"]
    return boxes.where(people).select(*keep), boxes.where(ignored).select(*keep)


def read_count_truth(spark: SparkSession, path: str) -> DataFrame:
    """offset_s, zone, count."""
    return spark.read.schema("offset_s double, zone string, count long").csv(path, header=True)


def export_bills(bills: DataFrame, zone: str) -> DataFrame:
    """Lines of the latest, not voided revision in local time, as a till system exports them."""
    at = local(from_ms(F.col("t_ms")), zone)
    return bills.where("not voided").select(F.col("bill_ref").alias("Bill No"), F.date_format(at, "yyyy-MM-dd").alias("Date"), F.date_format(at, "HH:mm:ss").alias("Time"), F.col("till_id").alias("Counter"), F.col("line_no").alias("Line"), F.col("sku").alias("Item Code"), (F.col("qty_milli") / 1000).alias("Qty"), F.col("unit").alias("Unit"), F.format_string("%.2f", F.col("amount_minor") / 100).alias("Amount"), F.format_string("%.2f", F.col("tax_minor") / 100).alias("Tax"))


def write_log(events: DataFrame, path: str) -> None:
    """The event log by day of arrival, sorted so that reads of a store and time prune."""
    day = F.to_date(from_ms(F.col("received_ms")))
    events.withColumn("received_date", day).repartition("received_date", F.pmod(F.xxhash64("store_id"), F.lit(16))).sortWithinPartitions("store_id", "type", "t_ms").write.partitionBy("received_date").mode("append").parquet(path)


def expired_days(log: DataFrame, today: Column, keep_days: int = 30) -> DataFrame:
    """Partitions of the log that are past their retention (S19); they are dropped as directories."""
    return log.select("received_date").distinct().where(F.col("received_date") < F.date_sub(today, keep_days))


def outbox_stats(outbox: DataFrame) -> DataFrame:
    """Rows, bytes and gap-freedom by source and state of an edge outbox."""
    return outbox.groupBy("source", "state").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))


def outbox_evictions(outbox: DataFrame, quota_bytes: int) -> DataFrame:
    """Oldest sent rows whose removal brings each source under its quota."""
    total = outbox.groupBy("source").agg(F.sum("bytes").alias("_total"))
    sent = scan(outbox.where("state = 'sent'"), ["source"], ["sequence"], {"_freed": Running("bytes", exclusive=True)})
    return sent.join(total, "source").where(F.col("_total") - F.coalesce("_freed", F.lit(0)) > quota_bytes).select("source", "sequence")


def outbox_claims(outbox: DataFrame, batch: int = 500, most_tries: int = 10) -> DataFrame:
    """The next rows to relay, in order, with their batch (S16): pending rows of each source before its first failure limit.

    outbox: source, sequence, state, tries. Rows over most_tries are dead and hold back what comes after them in their
    source, so order is kept. batch_no counts batches of `batch` rows within a source.
    """
    dead = outbox.where((F.col("state") == "pending") & (F.col("tries") >= most_tries)).groupBy("source").agg(F.min("sequence").alias("_dead"))
    ready = outbox.where("state = 'pending'").join(dead, "source", "left").where(F.col("_dead").isNull() | (F.col("sequence") < F.col("_dead"))).drop("_dead")
    counted = scan(ready.withColumn("_one", F.lit(1)), ["source"], ["sequence"], {"_upto": Running("_one")})
    return counted.withColumn("batch_no", F.floor((F.col("_upto") - 1) / batch)).drop("_one", "_upto")


def after_relay(outbox: DataFrame, answers: DataFrame) -> DataFrame:
    """outbox with the answers (source, sequence, ok) applied: accepted rows are sent, others stay with one try more."""
    a = answers.groupBy("source", "sequence").agg(F.max("ok").alias("_ok"))
    j = outbox.join(a, ["source", "sequence"], "left")
    pending = F.col("state") == "pending"
    return j.withColumns({"tries": F.col("tries") + (pending & F.col("_ok").isNotNull()).cast("int"), "state": F.when(pending & F.col("_ok"), "sent").otherwise(F.col("state"))}).drop("_ok")


def post_batches(rows: DataFrame, url: str, order: str, speed: float = 0.0, batch: int = 500, timeout: float = 30.0) -> DataFrame:
    """Sends rows as JSON arrays to url, one answer row a batch: partition, rows, status.

    Each task sends its rows in the order of `order` (epoch ms); with speed over 0 it waits so that event time passes
    `speed` times as fast as the clock. The result is lazy: the rows are sent when it is read, once a read.
    """

    def run(frames):
        from pyspark import TaskContext

        part, began, first = TaskContext.get().partitionId(), time.time(), None
        for frame in frames:
            out = []
            for i in range(0, len(frame), batch):
                own = frame.iloc[i : i + batch]
                t = float(own[order].iloc[-1])
                first = t if first is None else first
                if speed > 0:
                    time.sleep(max(0.0, (t - first) / 1000 / speed - (time.time() - began)))
                body = ("[" + ",".join(own["record"]) + "]").encode()
                request = urllib.request.Request(url, body, {"Content-Type": "application/cloudevents-batch+json"})
                with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
                    out.append((part, len(own), answer.status))
            yield pd.DataFrame(out, columns=["part", "rows", "status"])

    import pandas as pd

    ready = rows.withColumn("record", F.to_json(F.struct(*rows.columns))).select(order, "record").sortWithinPartitions(order)
    return ready.mapInPandas(run, "part int, rows int, status int")


def same_schema(df: DataFrame, schema: StructType) -> bool:
    return [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]
