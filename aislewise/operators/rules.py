"""Event-time rules as DataFrame operations: late split, footfall spikes, queue alerts and dwell alerts.

Events have the columns of schemas.RULE_EVENT; store_id and run_id (null: live) are the key of a rule's state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aislewise.functions.buckets import tumbling_start
from aislewise.functions.ids import incident_id
from aislewise.functions.scans import Running, scan
from aislewise.functions.shared import stored

KEY = ["store_id", "run_id"]


@dataclass(frozen=True)
class Rule:
    id: str
    version: str
    mode: str = "enforce"
    severity: str = "medium"


@dataclass(frozen=True)
class Rules:
    """Parameters in milliseconds; the values are those of the shipped rules document."""

    grace: int = 30_000
    queue: Rule = Rule("R-QUEUE-001", "1.0.0", "enforce", "medium")
    threshold: int = 6
    sustain: int = 60_000
    hysteresis: int = 2
    clear_sustain: int = 30_000
    dwell: Rule = Rule("R-DWELL-001", "1.1.0", "enforce", "low")
    dwell_zones: tuple[str, ...] = ("fitting-rooms",)
    limit: int = 600_000
    ttl: int = 14_400_000
    stitch: int = 30_000
    absence: Rule = Rule("R-ABS-001", "1.0.0", "shadow", "high")
    expect: str = "com.retail.store.register.opened"
    within: int = 300_000
    footfall: Rule = Rule("R-FOOT-001", "1.1.0", "enforce", "low")
    footfall_zones: tuple[str, ...] = ("entrance",)
    window: int = 300_000
    history: int = 12
    factor: float = 2.0
    min_count: int = 10
    count_appeared: bool = False
    off: tuple[str, ...] = field(default=())


def first_of_duplicates(events: DataFrame) -> DataFrame:
    """The first arrival of each (store, run, id)."""
    first = events.groupBy(*KEY, "id").agg(F.min("arrival").alias("arrival"))
    run = lambda df: df.withColumn("_r", F.coalesce("run_id", F.lit("")))
    return run(events).join(run(first).drop("run_id"), ["store_id", "_r", "id", "arrival"], "left_semi").drop("_r")


def running_max(df: DataFrame, keys: list[str], order: str, value: str, n: int | None = None) -> DataFrame:
    """df with before_max: the largest value of earlier rows of the key; a store with a third of all events is spread over cells."""
    return scan(df, keys, [order], {"before_max": Running(value, "max", exclusive=True)}, n)


def late_split(events: DataFrame, grace: int) -> DataFrame:
    """events with late: at or behind the watermark that the key's earlier arrivals have reached."""
    seen = running_max(events, KEY, "arrival", "t_ms")
    return seen.withColumn("late", F.coalesce(F.col("t_ms") <= F.col("before_max") - grace, F.lit(False))).drop("before_max")


def released(events: DataFrame, grace: int) -> DataFrame:
    """What the rules see: first of duplicates, on time, at or behind the final watermark, with that watermark as wm."""
    own = stored(late_split(first_of_duplicates(events), grace).where("not late").drop("late"), "released")
    wm = own.groupBy(*KEY).agg((F.max("t_ms") - grace).alias("wm")).select(F.col("store_id").alias("_s"), F.col("run_id").alias("_r"), "wm")
    return own.join(wm, (F.col("store_id") == F.col("_s")) & F.col("run_id").eqNullSafe(F.col("_r"))).drop("_s", "_r").where("t_ms <= wm")


def _order() -> list:
    """Event order: time, sequence as text, id."""
    return [F.col("t_ms"), F.coalesce("sequence", F.lit("")), F.coalesce("id", F.lit(""))]


def _incident(rows: DataFrame, rule: Rule, subject: Column) -> DataFrame:
    """Rows (key, kind, onset_ms, detected_ms and the state key) as incidents without text."""
    return rows.select(
        incident_id(rule.id, rule.version, F.col("store_id"), F.col("run_id"), F.col("key"), F.col("onset_ms")).alias("incident_id"),
        F.lit(rule.id).alias("rule_id"), F.lit(rule.version).alias("rule_version"), F.lit(rule.mode).alias("mode"), F.lit(rule.severity).alias("severity"),
        "kind", "store_id", "run_id", "key", subject.alias("subject"), F.col("onset_ms").cast("long"), F.col("detected_ms").cast("long"),
    )


def _islands(rows: DataFrame, by: list[str], holds: Column) -> DataFrame:
    """Runs of consecutive rows that hold: start_ms, and next_ms, the time of the row after the run."""
    w = W.partitionBy(*by).orderBy(*_order())
    marked = rows.withColumns({"_p": holds, "_next": F.lead("t_ms").over(w)}).withColumn("_change", (F.col("_p") != F.coalesce(F.lag("_p").over(w), F.lit(False))).cast("int"))
    marked = marked.withColumns({"_g": F.sum("_change").over(w), "_rank": F.row_number().over(w)}).where("_p")
    return marked.groupBy(*by, "_g").agg(F.min("t_ms").alias("start_ms"), F.max_by("_next", "_rank").alias("next_ms"), F.max("wm").alias("wm"))


def _held(islands: DataFrame, by: list[str], kind: str, hold: int) -> DataFrame:
    at = F.col("start_ms") + hold
    counts = F.when(F.col("next_ms").isNotNull(), at < F.col("next_ms")).otherwise(at <= F.col("wm"))
    return islands.where(counts).select(*by, F.lit(kind).alias("kind"), "start_ms", at.alias("at_ms"))


def queue_alerts(events: DataFrame, rules: Rules) -> DataFrame:
    """R-QUEUE incidents by gaps and islands.

    A run of lengths at the threshold opens after `sustain`, a run at threshold - hysteresis clears after
    `clear_sustain`, if the deadline comes before the row that ends the run. Candidates that repeat the state are left out.
    """
    by = [*KEY, "queue_id"]
    rows = released(events, rules.grace).where(F.col("type").endswith("store.queue.length") & F.col("queue_id").isNotNull() & F.col("length").isNotNull())
    high = _held(_islands(rows, by, F.col("length") >= rules.threshold), by, "OPENED", rules.sustain)
    low = _held(_islands(rows, by, F.col("length") <= rules.threshold - rules.hysteresis), by, "RESOLVED", rules.clear_sustain)
    w = W.partitionBy(*by).orderBy("at_ms", F.desc("kind"))  # RESOLVED before OPENED at one instant
    kept = high.union(low).withColumn("_last", F.coalesce(F.lag("kind").over(w), F.lit("RESOLVED"))).where("kind <> _last")
    onset = F.last(F.when(F.col("kind") == "OPENED", F.col("start_ms")), True).over(w)
    return _incident(kept.withColumns({"onset_ms": onset, "detected_ms": F.col("at_ms"), "key": F.col("queue_id")}), rules.queue, F.concat(F.lit("queue:"), "key"))


def dwell_alerts(events: DataFrame, rules: Rules) -> DataFrame:
    """R-DWELL incidents of visits without stitching (W7): each entry with the next event of its track and zone."""
    by = [*KEY, "track_id", "zone_id"]
    moves = released(events, rules.grace).where(F.col("type").rlike(r"store\.zone\.(entered|exited)$") & F.col("track_id").isNotNull() & F.col("zone_id").isin(list(rules.dwell_zones)))
    nxt = moves.withColumn("next_ms", F.lead("t_ms").over(W.partitionBy(*by).orderBy(*_order()))).where(F.col("type").endswith("entered"))
    before = lambda at: F.when(F.col("next_ms").isNotNull(), at < F.col("next_ms")).otherwise(at <= F.col("wm"))
    opened = F.col("t_ms") + rules.limit
    expires = F.col("t_ms") + rules.ttl
    visits = nxt.where(before(opened)).withColumns({"key": F.concat_ws("|", "track_id", "zone_id"), "onset_ms": F.col("t_ms")})
    end = F.when(before(expires), expires).otherwise(F.col("next_ms"))
    rows = visits.select(*KEY, "key", "onset_ms", F.explode(F.array(F.struct(F.lit("OPENED").alias("kind"), opened.alias("at")), F.struct(F.lit("RESOLVED").alias("kind"), end.alias("at")))).alias("i"))
    rows = rows.select(*KEY, "key", "onset_ms", F.col("i.kind").alias("kind"), F.col("i.at").alias("detected_ms")).where("detected_ms is not null")
    return _incident(rows, rules.dwell, F.concat(F.lit("zone:"), F.substring_index("key", "|", -1)))


def footfall_windows(events: DataFrame, rules: Rules) -> DataFrame:
    """Entries per closed window and zone, zero where a present window has none.

    An event counts if its window was still open when it arrived: end + grace over the largest time so far, itself
    included. A window is closed once the largest time of its key reaches end + grace.
    """
    start = tumbling_start(F.col("t_ms"), rules.window)
    seen = running_max(first_of_duplicates(events), KEY, "arrival", "t_ms").withColumn("start_ms", start)
    on_time = seen.where(F.col("start_ms") + rules.window + rules.grace > F.greatest("t_ms", F.coalesce("before_max", F.col("t_ms"))))
    entered = F.col("type").endswith("store.zone.entered") & (F.lit(rules.count_appeared) | (F.coalesce("how", F.lit("crossed")) != "appeared"))
    counts = on_time.groupBy(*KEY, "start_ms").agg(*[F.count_if(entered & (F.col("zone_id") == z)).alias(f"z{i}") for i, z in enumerate(rules.footfall_zones)])
    top = events.groupBy(*KEY).agg(F.max("t_ms").alias("top")).select(F.col("store_id").alias("_s"), F.col("run_id").alias("_r"), "top")
    closed = counts.join(top, (F.col("store_id") == F.col("_s")) & F.col("run_id").eqNullSafe(F.col("_r"))).where(F.col("start_ms") + rules.window + rules.grace <= F.col("top"))
    zones = F.array(*[F.struct(F.lit(z).alias("zone_id"), F.col(f"z{i}").alias("n")) for i, z in enumerate(rules.footfall_zones)])
    return closed.select(*KEY, "start_ms", F.explode(zones).alias("z")).select(*KEY, "start_ms", "z.zone_id", "z.n")


def footfall_spikes(windows: DataFrame, rules: Rules) -> DataFrame:
    """R-FOOT incidents from the windows of footfall_windows."""
    w = W.partitionBy(*KEY, "zone_id").orderBy("start_ms")
    past = w.rowsBetween(-rules.history, -1)
    h = windows.withColumns({"_n": F.count("n").over(past), "_sum": F.coalesce(F.sum("n").over(past), F.lit(0))})
    spike = (F.col("_n") == rules.history) & (F.col("n") >= rules.min_count) & ((F.col("n") * rules.history).cast("double") > rules.factor * F.col("_sum"))
    h = h.withColumn("spike", spike).withColumn("_was", F.coalesce(F.lag("spike").over(w), F.lit(False)))
    opening = F.when(F.col("spike") & ~F.col("_was"), F.col("start_ms"))
    h = h.withColumn("onset_ms", F.last(opening, True).over(w)).where("spike <> _was")
    rows = h.withColumns({"kind": F.when(F.col("spike"), "OPENED").otherwise("RESOLVED"), "detected_ms": F.col("start_ms") + rules.window, "key": F.col("zone_id")})
    return _incident(rows, rules.footfall, F.concat(F.lit("zone:"), "key"))


def routed(incidents: DataFrame, mode: str) -> DataFrame:
    """Incidents of rules that are enforced, or in shadow."""
    return incidents.where(F.col("mode") == mode)
