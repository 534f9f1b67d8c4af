"""Time buckets on a store's local clock (T1 to T6). Instants are UTC timestamps without zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIGIN = datetime(2000, 1, 1)
BUCKETS = {"15m": 900, "hour": 3600, "day": 86400}


def to_ms(instant: Column) -> Column:
    """Epoch milliseconds of a UTC timestamp without zone (the session's zone is UTC)."""
    return F.unix_millis(instant.cast("timestamp"))


def from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def local(instant: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant)


def instant_of(local_time: Column, zone: str) -> Column:
    """The instant of a local time: the earlier one in an overlap, moved forward in a gap."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local_time)


def local_bin(instant: Column, zone: str, bucket: str) -> Column:
    """Start, in local time, of the bin on the store's wall clock that holds the instant."""
    if bucket == "day":
        return F.date_trunc("day", local(instant, zone)).cast("timestamp_ntz")
    size = BUCKETS[bucket] * 1000
    ms = to_ms(local(instant, zone))
    return from_ms(ms - F.pmod(ms, F.lit(size)))


def local_date(instant: Column, zone: str) -> Column:
    return local(instant, zone).cast("date")


def covering_bins(spark, start: datetime, end: datetime, zone: str, bucket: str) -> DataFrame:
    """Every local bin that [start, end) touches, as bin_start (local) and bin_from, bin_to (instants)."""
    step = {"15m": "15 minutes", "hour": "1 hour", "day": "1 day"}[bucket]
    one = spark.range(1).select(local_bin(F.lit(start).cast("timestamp_ntz"), zone, bucket).alias("first"), local(F.lit(end).cast("timestamp_ntz"), zone).alias("last"))
    bins = one.select(F.explode(F.sequence("first", "last", F.expr(f"interval {step}"))).alias("bin_start"), "last").where("bin_start < last")
    return bins.select("bin_start", instant_of(F.col("bin_start"), zone).alias("bin_from"), instant_of(F.col("bin_start") + F.expr(f"interval {step}"), zone).alias("bin_to"))


def aligned_bin(instant_ms: Column, start_ms: Column, size_ms: int = 60_000) -> Column:
    """Start of the bin counted from the window's own start."""
    return start_ms + F.floor((instant_ms - start_ms) / size_ms).cast("long") * size_ms


def timeline_window(onset_ms: Column, detected_ms: Column, resolved_ms: Column) -> tuple[Column, Column]:
    """From 10 minutes before onset to 5 after the end, at least 5 after detection and at most 2 hours long (T4)."""
    start = onset_ms - 600_000
    end = F.greatest(F.coalesce(resolved_ms, detected_ms), detected_ms) + 300_000
    return start, F.least(end, start + 7_200_000)


def tumbling_start(ms: Column, size_ms: int) -> Column:
    """Start of the epoch-aligned window."""
    return ms - F.pmod(ms, F.lit(size_ms))
