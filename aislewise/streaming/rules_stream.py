"""Rules over a stream: keyed state for the fold and for footfall windows, in each store's own time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from aislewise.operators.fold import COLUMNS, OUT, Fold, State
from aislewise.operators.rules import Rules

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = StructType([StructField("json", StringType())])
#: Runs of simulations are forgotten after this long without events; live stores are not.
IDLE_TTL_MS = 3_600_000


class FoldProcessor(StatefulProcessor):
    """One store and run: its rows of a micro-batch in order of arrival, through the fold whose state is kept as JSON.

    The watermark is the key's own (largest time less grace), so it needs none of Spark's timers.
    """

    def __init__(self, rules: Rules, ttl_ms: int | None = None):
        self.rules, self.ttl_ms = rules, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", STATE, self.ttl_ms) if self.ttl_ms else handle.getValueState("fold", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get() if self.state.exists() else None
        fold, out = Fold(self.rules, State.from_json(kept[0] if kept else None)), []
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        for e in frame.astype(object).where(frame.notna(), None).to_dict("records"):
            out += [(rule, kind, e["store_id"], e["run_id"], k, int(onset), int(at)) for rule, kind, k, onset, at in fold.feed({**e, "arrival": int(e["arrival"]), "t_ms": int(e["t_ms"]), "length": None if e["length"] is None else int(e["length"])})]
        self.state.update((fold.s.to_json(),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def rules_stream(events: DataFrame, rules: Rules, ttl_ms: int | None = None) -> DataFrame:
    """Incidents of a stream of RULE_EVENT rows. The session's state store must be RocksDB (see ROCKS)."""
    keyed = events.withColumn("_run", F.coalesce("run_id", F.lit("")))
    return keyed.groupBy("store_id", "_run").transformWithStateInPandas(statefulProcessor=FoldProcessor(rules, ttl_ms), outputStructType=_out(), outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def _out() -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(OUT)


def heartbeat(spark: SparkSession, checkpoint: str, most: int = 500) -> DataFrame:
    """What the rules' state says of each store and run: watermark, buffered, late and processed events.

    Read from a query's checkpoint by the state data source, while the query runs or after it; the `most` keys whose
    watermark is furthest.
    """
    state = spark.read.format("statestore").option("stateVarName", "fold").load(checkpoint)
    json = F.col("value.json")
    number = lambda name: F.get_json_object(json, f"$.{name}").cast("long")
    buffered = F.size(F.from_json(F.get_json_object(json, "$.buffer"), "array<string>")).cast("long")
    rows = state.select(F.col("key.store_id").alias("store_id"), F.nullif(F.col("key._run"), F.lit("")).alias("run_id"), number("watermark").alias("watermark_ms"), buffered.alias("buffered"), number("late").alias("late"), (number("arrived") - buffered).alias("processed"))
    return rows.orderBy(F.desc("watermark_ms"), "store_id", "run_id").limit(most)


class WindowProcessor(StatefulProcessor):
    """One store and run: open tumbling windows by start, under the key's own largest time.

    An event counts while its window's end and grace are not behind the key; a window comes out once they are.
    """

    def __init__(self, rules: Rules):
        self.r = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("windows", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        r, kept = self.r, self.state.get() if self.state.exists() else None
        top, windows = json.loads(kept[0]) if kept else (None, {})
        windows, out = {int(k): v for k, v in windows.items()}, []
        frame = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        for t, zone in zip(frame["t_ms"].tolist(), frame["counted"].tolist()):
            top = t if top is None else max(top, t)
            start = t - t % r.window
            if start + r.window + r.grace > top:
                own = windows.setdefault(start, [0] * len(r.footfall_zones))
                if zone in r.footfall_zones:
                    own[r.footfall_zones.index(zone)] += 1
        for start in sorted(windows):
            if start + r.window + r.grace <= top:
                out += [(key[0], key[1] or None, start, z, n) for z, n in zip(r.footfall_zones, windows.pop(start))]
        self.state.update((json.dumps((top, windows)),))
        yield pd.DataFrame(out, columns=["store_id", "run_id", "start_ms", "zone_id", "n"])

    def close(self) -> None:
        pass


def footfall_counts_stream(events: DataFrame, rules: Rules) -> DataFrame:
    """Entries per closed tumbling window, store, run and configured zone; each window comes out once, after its grace.

    Time is each store's own, as in footfall_windows(): a fast store makes nothing of a slow one late. The session's
    state store must be RocksDB (see ROCKS).
    """
    entered = F.col("type").endswith("store.zone.entered") & (F.lit(rules.count_appeared) | (F.coalesce("how", F.lit("crossed")) != "appeared"))
    keyed = events.select("store_id", F.coalesce("run_id", F.lit("")).alias("_run"), "t_ms", "arrival", F.when(entered, F.col("zone_id")).alias("counted"))
    return keyed.groupBy("store_id", "_run").transformWithStateInPandas(statefulProcessor=WindowProcessor(rules), outputStructType="store_id string, run_id string, start_ms long, zone_id string, n long", outputMode="Append", timeMode="None")


def footfall_to_table(events: DataFrame, rules: Rules, windows_path: str, checkpoint: str):
    """Starts a query that appends closed windows to a table; footfall_spikes() over the table gives the incidents.

    foreachBatch writes each batch under its own number and overwrites on a repeat, so a retried batch adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{windows_path}/batch={number}")

    return footfall_counts_stream(events, rules).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
