"""Tables that micro-batches change row by row: incidents, heartbeats, scores and outbox rows.

A table is cut into buckets by a hash of its key. A batch reads and rewrites the buckets that it has rows of, and leaves
the files of all others alone. What one row and a later row of its key make is a grouping that gives the same in any
order and division, so many batches make what one would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from aislewise.sources import folders

Merge = Callable[[DataFrame], DataFrame]
BUCKET = "bucket"
HOUR_MS = 3_600_000


class BucketedTable:
    """Rows by key under path/bucket=N. merge: rows of both old and new, to one row a key, with the same columns.

    A change is written beside the table first, as a whole, and then takes the place of its buckets. A batch that is
    repeated under its number finds what it wrote and puts it there again: nothing is merged twice, and a change that
    was cut short between both steps is finished by its repeat. One writer at a time; readers see a bucket as it was
    before a change or after it, not all buckets at one instant.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], merge: Merge, buckets: int = 64):
        self.spark, self.path, self.keys, self.merge, self.buckets = spark, path.rstrip("/"), keys, merge, buckets
        self.schema: StructType = _parse_datatype_string(schema)

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET))

    def _stored(self) -> DataFrame:
        if not any(name.startswith(f"{BUCKET}=") for name in folders.children(self.spark, self.path)):
            return self.spark.createDataFrame([], StructType([*self.schema.fields]).add(BUCKET, "integer"))
        return self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, "integer")).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def upsert(self, batch: DataFrame, number: int) -> list[int]:
        """Merges a micro-batch, as foreachBatch gives it; the buckets that it changed."""
        rows = self._with_bucket(batch).persist()
        try:
            return self._change("batch", number, rows, lambda old, touched: self._with_bucket(self.merge(old.drop(BUCKET).unionByName(rows.drop(BUCKET)))))
        finally:
            rows.unpersist()

    def drop_where(self, condition: Column, number: int) -> list[int]:
        """Removes rows for good; only buckets that hold such rows are rewritten."""
        return self._change("purge", number, self._stored().where(condition), lambda old, touched: old.where(~F.coalesce(condition, F.lit(False))))

    def _change(self, kind: str, number: int, changed: DataFrame, make) -> list[int]:
        beside = f"{self.path}/_pending"
        done = {int(name.partition("=")[2]) for name in folders.children(self.spark, beside) if name.startswith(f"{kind}=") and folders.exists(self.spark, f"{beside}/{name}/_SUCCESS")}
        if done and number < max(done):
            return []  # a later change has been made already
        own = f"{beside}/{kind}={number}"
        if number not in done:
            touched = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())  # at most as many as there are buckets
            old = self._stored().where(F.col(BUCKET).isin(touched))
            new = make(old, touched)
            kept = self.spark.createDataFrame([(b, True) for b in touched], f"{BUCKET} int, _touched boolean")
            new.withColumn("_touched", F.lit(False)).unionByName(kept, allowMissingColumns=True).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(own)
        touched = [int(name.partition("=")[2]) for name in folders.children(self.spark, own) if name.startswith(f"{BUCKET}=")]
        rows = self.spark.read.schema(StructType([*self.schema.fields]).add("_touched", "boolean").add(BUCKET, "integer")).parquet(own).where("not _touched").drop("_touched")
        rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        full = {r[0] for r in rows.select(BUCKET).distinct().collect()}
        for bucket in set(touched) - full:  # nothing is left of it
            folders.remove(self.spark, f"{self.path}/{BUCKET}={bucket}")
        for earlier in done - {number}:
            folders.remove(self.spark, f"{beside}/{kind}={earlier}")
        return touched


# ---- incidents (D3) -----------------------------------------------------------------------------------------------

INCIDENTS = "incident_id string, onset_ms long, detected_ms long, resolved_ms long, acted_ms long, acted string, actions long"


def incident_changes(log: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Rows of the log (incident_id, kind, onset_ms, detected_ms) and of actions (incident_id, at_ms, status) as changes."""
    opened, resolved = F.col("kind") == "OPENED", F.col("kind") == "RESOLVED"
    none = F.lit(None).cast("long")
    rows = log.select("incident_id", F.when(opened, F.col("onset_ms")).alias("onset_ms"), F.when(opened, F.col("detected_ms")).alias("detected_ms"), F.when(resolved, F.col("detected_ms")).alias("resolved_ms"), none.alias("acted_ms"), none.cast("string").alias("acted"), F.lit(0).cast("long").alias("actions"))
    if actions is None:
        return rows
    return rows.unionByName(actions.select("incident_id", none.alias("onset_ms"), none.alias("detected_ms"), none.alias("resolved_ms"), F.col("at_ms").alias("acted_ms"), F.col("status").alias("acted"), F.lit(1).cast("long").alias("actions")))


def merge_incidents(rows: DataFrame) -> DataFrame:
    last = F.when(F.col("acted_ms").isNotNull(), F.struct("acted_ms", "acted"))
    out = rows.groupBy("incident_id").agg(F.min("onset_ms").alias("onset_ms"), F.min("detected_ms").alias("detected_ms"), F.min("resolved_ms").alias("resolved_ms"), F.max(last).alias("_l"), F.sum("actions").alias("actions"))
    return out.select("incident_id", "onset_ms", "detected_ms", "resolved_ms", "_l.acted_ms", "_l.acted", "actions")


def incidents(spark: SparkSession, path: str, buckets: int = 64) -> BucketedTable:
    return BucketedTable(spark, path, INCIDENTS, ["incident_id"], merge_incidents, buckets)


def incident_rows(changes: DataFrame) -> DataFrame:
    """The table's rows as incidents.incident_table() shows them: OPENED inserts, the first RESOLVED counts, reviews stand."""
    status = F.coalesce("acted", F.lit("OPEN"))
    resolves = F.col("resolved_ms").isNotNull() & status.isin("OPEN", "ACKNOWLEDGED")
    return changes.where("detected_ms is not null").select("incident_id", "onset_ms", "detected_ms", "resolved_ms", F.when(resolves, "AUTO_RESOLVED").otherwise(status).alias("status"), (F.col("actions") + resolves.cast("long")).alias("version"))


# ---- heartbeats and scores (D5, D6) -------------------------------------------------------------------------------


def latest_rows(keys: list[str], order: list[str], values: list[str]) -> Merge:
    """The last row of a key by order, whatever batch it came in."""
    return lambda rows: _chosen(rows, keys, [*order, *values], F.max_by)


def first_rows(keys: list[str], order: list[str], values: list[str]) -> Merge:
    """The first row of a key by order: insert, do nothing on conflict."""
    return lambda rows: _chosen(rows, keys, [*order, *values], F.min_by)


def _chosen(rows: DataFrame, keys: list[str], columns: list[str], choose) -> DataFrame:
    own = F.struct(*columns)
    return rows.groupBy(*keys).agg(choose(own, own).alias("_c")).select(*keys, *[F.col(f"_c.{c}").alias(c) for c in columns])


# ---- outbox (S16) -------------------------------------------------------------------------------------------------

OUTBOX = "source string, sequence long, record string, state string, tries long, published_ms long"


def merge_outbox(rows: DataFrame) -> DataFrame:
    """A row that is published stays so, with the earliest time of it; else the one with most tries counts."""
    sent = F.col("state") == "published"
    own = F.struct(sent.alias("_sent"), F.when(sent, -F.col("published_ms")).alias("_early"), "tries", "record", "state", "published_ms")
    return rows.groupBy("source", "sequence").agg(F.max(own).alias("_c")).select("source", "sequence", "_c.record", "_c.state", "_c.tries", "_c.published_ms")


def outbox(spark: SparkSession, path: str, buckets: int = 64) -> BucketedTable:
    return BucketedTable(spark, path, OUTBOX, ["source", "sequence"], merge_outbox, buckets)


def purge_published(table: BucketedTable, now_ms: int, number: int, keep_ms: int = 72 * HOUR_MS) -> list[int]:
    """Removes rows published over keep_ms ago; pending rows stay however old they are."""
    return table.drop_where((F.col("state") == "published") & (F.col("published_ms") < now_ms - keep_ms), number)


def in_batches(table: BucketedTable, parts: list[DataFrame]) -> DataFrame:
    """The table after one batch for each part, numbered from 0."""
    for number, part in enumerate(parts):
        table.upsert(part, number)
    return table.read()


def upsert_stream(changes: DataFrame, table: BucketedTable, checkpoint: str):
    """Starts a query that merges a stream of changes; a batch that is repeated after a failure changes nothing more."""

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
