"""Ingest over a stream: validation, keyed deduplication with conflict detection, typed tables and dead letters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from aislewise.operators import ingest

_HASH = StructType([StructField("hash", StringType())])


class FirstHash(StatefulProcessor):
    """ACCEPTED for the first payload of (source, id), DUPLICATE for equal ones, CONFLICT for others; kept for ttl_ms (None: for good)."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", _HASH, self.ttl_ms) if self.ttl_ms else handle.getValueState("first", _HASH)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        known = self.first.get()[0] if self.first.exists() else None
        result = []
        for h in frame["payload_hash"]:
            result.append("ACCEPTED" if known is None else "DUPLICATE" if h == known else "CONFLICT")
            known = h if known is None else known
        self.first.update((known,))
        yield frame.assign(result=result)

    def close(self) -> None:
        pass


def dedup_stream(hashed: DataFrame, ttl_ms: int | None = 35 * 86_400_000) -> DataFrame:
    """Rows with source, id, arrival and payload_hash, each with result.

    With a time to live Spark runs batches without data for ever, so an availableNow trigger ends with ttl_ms None only.
    """
    schema = StructType([*hashed.schema.fields, StructField("result", StringType())])
    return hashed.groupBy("source", "id").transformWithStateInPandas(statefulProcessor=FirstHash(ttl_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def write_batch(path: str):
    """A foreachBatch function: each typed table, and dead letters, under the batch's number (a repeat overwrites it)."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good = batch.where((F.size("errors") == 0) & (F.col("result") == "ACCEPTED"))
        for name, rows in ingest.typed_tables(good).items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        ingest.dead_letters(batch).write.mode("overwrite").parquet(f"{path}/dead_letters/batch={number}")
        batch.unpersist()

    return write
