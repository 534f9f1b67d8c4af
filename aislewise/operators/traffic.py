"""Visitors, queue levels and floor state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aislewise.functions import buckets as B
from aislewise.functions.money import round_half_up
from aislewise.functions.scans import Clamped, scan

from .billing import _ms, in_window


def visitors(entries: DataFrame, bins: DataFrame, start: datetime, end: datetime, zone: str, bucket: str) -> DataFrame:
    """Entries that crossed into the entrance zones per bin, zero where there were none (P11, T2). entries: t_ms, how."""
    real = entries.where(in_window(start, end) & (F.coalesce("how", F.lit("crossed")) != "appeared"))
    counts = real.groupBy(B.local_bin(B.from_ms(F.col("t_ms")), zone, bucket).alias("bin_start")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin_start", "left").select("bin_start", F.coalesce("n", F.lit(0)).alias("visitors"))


def carried_in(steps: DataFrame, start: datetime, look_back_ms: int) -> DataFrame:
    """The last value of each key before the window, dated to its start (J5). steps: key, t_ms, seq, value."""
    before = steps.where((F.col("t_ms") < _ms(start)) & (F.col("t_ms") >= _ms(start) - look_back_ms))
    return before.groupBy("key").agg(F.max_by(F.col("value"), F.struct("t_ms", "seq")).alias("value")).select("key", F.lit(_ms(start)).alias("t_ms"), F.lit(-1).cast("long").alias("seq"), "value")


_QUARTER = 900_000


def step_stats(steps: DataFrame, bins: DataFrame, start: datetime, end: datetime, look_back_ms: int = 12 * 3_600_000) -> DataFrame:
    """Time-weighted mean and maximum of each key's step function per bin.

    A value holds until the key's next one, the last until the end; the value before the window is carried in. A bin
    without a known value has null statistics; a step of no length counts for neither. Each step is exploded over the
    bins that it covers, which are few, instead of being compared with all bins.
    """
    known = carried_in(steps, start, look_back_ms).union(steps.where(in_window(start, end)).select("key", "t_ms", "seq", "value"))
    until = F.lead("t_ms").over(W.partitionBy("key").orderBy("t_ms", "seq"))
    spans = known.withColumn("to_ms", F.coalesce(until, F.lit(_ms(end)))).where("to_ms > t_ms")
    edges = bins.select("bin_start", B.to_ms(F.col("bin_from")).alias("b0"), B.to_ms(F.col("bin_to")).alias("b1"))
    # both are dealt over quarter hours; a piece counts in the first quarter that step and bin share
    quarters = lambda a, b: F.explode(F.sequence(F.floor(a / _QUARTER), F.floor((b - 1) / _QUARTER)))
    own = lambda a: F.floor(a / _QUARTER)
    clipped = spans.where((F.col("to_ms") > _ms(start)) & (F.col("t_ms") < _ms(end))).withColumns({"_a": F.greatest("t_ms", F.lit(_ms(start))), "_b": F.least("to_ms", F.lit(_ms(end)))})
    pieces = clipped.withColumn("_q", quarters(F.col("_a"), F.col("_b"))).join(edges.withColumn("_q", quarters(F.col("b0"), F.col("b1"))), "_q")
    ms = F.least("_b", "b1") - F.greatest("_a", "b0")
    stats = pieces.where(F.col("_q") == F.greatest(own(F.col("_a")), own(F.col("b0")))).withColumn("ms", ms).where("ms > 0").groupBy("key", "bin_start").agg((F.sum(F.col("value") * F.col("ms")) / F.sum("ms")).alias("mean"), F.max("value").alias("peak"))
    grid = known.select("key").distinct().crossJoin(F.broadcast(bins.select("bin_start")))
    return grid.join(stats, ["key", "bin_start"], "left").select("key", "bin_start", round_half_up(F.col("mean")).alias("mean"), "peak")


def joined_buckets(traffic: DataFrame, queue_stats: DataFrame, sales_rows: DataFrame) -> DataFrame:
    """Visitors with sales (missing: 0), summed queue means and the highest peak per bin."""
    q = queue_stats.groupBy("bin_start").agg(F.sum("mean").alias("queue_mean"), F.max("peak").alias("queue_peak"))
    s = sales_rows.select(F.col("bucket_start").alias("bin_start"), "bills", "sales_minor")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return traffic.join(q, "bin_start", "left").join(s, "bin_start", "left").select("bin_start", "visitors", "queue_mean", "queue_peak", zero("bills"), zero("sales_minor"))


def occupancy(moves: DataFrame, keys: list[str], sign: Column) -> DataFrame:
    """People inside: entries less exits, never under 0 for the total."""
    return moves.groupBy(*keys).agg(F.greatest(F.lit(0), F.coalesce(F.sum(sign), F.lit(0))).cast("long").alias("occupancy"))


def clamped_occupancy(moves: DataFrame, keys: list[str], order: list[str], sign: str) -> DataFrame:
    """People inside when every exit of an empty place is ignored (W21): the running sum less its lowest value below 0."""
    run = scan(moves, keys, order, {"_inside": Clamped(sign)})
    return run.groupBy(*keys).agg(F.max_by("_inside", F.struct(*order)).cast("long").alias("occupancy"))


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row in `order`, whose end makes it total."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_l")).select(*keys, *[F.col(f"_l.{v}").alias(v) for v in values])


def floor_state(events: DataFrame) -> DataFrame:
    """Of each store's latest run by arrival: occupancy by zone and last length by queue.

    events: store_id, run_id, arrival, type, t_ms, zone_id, queue_id, length.
    """
    run = latest(events, ["store_id"], ["arrival"], ["run_id"])
    own = events.join(run.select("store_id", F.col("run_id").alias("_r")), "store_id").where(F.col("run_id").eqNullSafe(F.col("_r")))
    sign = F.when(F.col("type").endswith("zone.entered"), 1).when(F.col("type").endswith("zone.exited"), -1)
    zones = occupancy(own.where("zone_id is not null"), ["store_id", "zone_id"], sign).select("store_id", F.lit("zone").alias("kind"), F.col("zone_id").alias("id"), F.col("occupancy").alias("value"))
    queues = latest(own.where("queue_id is not null and length is not null"), ["store_id", "queue_id"], ["t_ms", "arrival"], ["length"])
    return zones.union(queues.select("store_id", F.lit("queue"), "queue_id", F.col("length").cast("long")))


def registers_of_queues(queues: DataFrame, registers: DataFrame) -> DataFrame:
    """Registers that serve each queue; one that names no queue serves the first (J8). queues: queue_id, position."""
    first = queues.agg(F.min_by("queue_id", "position").alias("_first"))
    named = registers.crossJoin(F.broadcast(first)).select("register_id", F.coalesce("queue_id", "_first").alias("queue_id"))
    return queues.select("queue_id").join(named, "queue_id")


def zone_of_incident(incidents: DataFrame, queues: DataFrame) -> DataFrame:
    """incidents with zone_id: named by the subject, or the zone of the subject's queue (J9). queues: queue_id, zone_id."""
    named = F.nullif(F.regexp_extract("subject", r"^zone:(.+)$", 1), F.lit(""))
    queue = F.nullif(F.regexp_extract("subject", r"^queue:(.+)$", 1), F.lit(""))
    out = incidents.withColumn("_q", queue).join(queues.select(F.col("queue_id").alias("_q"), F.col("zone_id").alias("_z")), "_q", "left")
    return out.withColumn("zone_id", F.coalesce(named, "_z")).drop("_q", "_z")


SEVERITIES = ("low", "medium", "high")


def alerting_zones(open_incidents: DataFrame) -> DataFrame:
    """Highest severity of open incidents per zone."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    top = open_incidents.where("zone_id is not null").groupBy("zone_id").agg(F.max(rank).alias("r"))
    return top.select("zone_id", F.get(F.array(*map(F.lit, SEVERITIES)), (F.col("r") - 1).cast("int")).alias("severity"))


def floor_rows(state: DataFrame, zones: DataFrame, alerts: DataFrame) -> DataFrame:
    """A row per zone of the layout: people inside and alert."""
    people = state.where("kind = 'zone'").select(F.col("id").alias("zone_id"), F.col("value").alias("people"))
    return zones.join(people, "zone_id", "left").join(alerts, "zone_id", "left").select("zone_id", F.coalesce("people", F.lit(0)).alias("people"), F.col("severity").alias("alert"))


def queue_rows(queues: DataFrame, zones: DataFrame, registers: DataFrame, lengths: DataFrame, alerts: DataFrame) -> DataFrame:
    """A row per queue of the layout (R12): its zone, people waiting, open registers, registers that serve it, alert of its zone.

    queues: queue_id, zone_id, position; zones: zone_id, name; registers: register_id, queue_id (null: the first queue);
    lengths: queue_id, t_ms, arrival, length, open_registers (events; the last of a queue counts); alerts: zone_id, severity.
    A queue without events has nobody waiting; a zone without a name is shown by its id.
    """
    now = latest(lengths, ["queue_id"], ["t_ms", "arrival"], ["length", "open_registers"])
    serving = registers_of_queues(queues.select("queue_id", "position"), registers).groupBy("queue_id").agg(F.count("*").alias("registers"))
    rows = queues.join(zones, "zone_id", "left").join(now, "queue_id", "left").join(serving, "queue_id", "left").join(alerts, "zone_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("queue_id", F.coalesce("name", "zone_id").alias("zone"), zero("length").alias("waiting"), zero("open_registers").alias("open_registers"), zero("registers").alias("registers"), F.col("severity").alias("alert"))
