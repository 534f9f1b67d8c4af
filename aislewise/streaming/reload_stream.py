"""Rules that a stream of documents replaces while they run over a stream of events.

Documents are a control stream: each is dealt to every bucket of stores and joins the events there in keyed state, so a
bucket knows the same schedule whichever executor holds it, and a restart from the checkpoint comes back with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aislewise.operators.fold import State
from aislewise.operators.reload import VERSIONED, VERSIONED_OUT, Schedule, VersionedFold, parse

BUCKETS = 64
_EVENT = ["store_id", "run_id", "arrival", "id", "type", "t_ms", "sequence", "zone_id", "track_id", "how", "queue_id", "length"]
#: Rows about documents have this in place of a rule's id, and APPLIED, SAME, REFUSED or RESET as their kind.
ABOUT = "rules"
_COLUMNS = [*VERSIONED, "detail"]


class ReloadProcessor(StatefulProcessor):
    """A bucket of stores: the schedule of documents as one value, each store and run's fold as an entry of a map.

    A micro-batch reads and writes the folds of the stores it has events of, no others. Documents of a micro-batch come
    before its events, in order of publishing.
    """

    def __init__(self, file: str):
        self.file = file

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.documents = handle.getValueState("documents", "json string")
        self.folds = handle.getMapState("folds", "store_id string, run string", "at int, json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        schedule, out = Schedule(self.file, self.documents.get()[0] if self.documents.exists() else None), []
        control = frame[frame["published"].notna()].sort_values(["published", "valid_ms"], kind="stable")
        for published, valid, text in zip(control["published"], control["valid_ms"], control["document"]):
            text, valid = (text if isinstance(text, str) else None), (None if pd.isna(valid) else int(valid))
            kind, reasons = schedule.publish(text, valid)
            if key[0] == 0:
                digest = hashlib.sha256((text or "").encode()).hexdigest()
                out.append((ABOUT, kind, None, None, digest, int(published), schedule.valid_from(-1), None, None, None, "; ".join(reasons)))
        if len(control):
            self.documents.update((schedule.to_json(),))
        events = frame[frame["published"].isna()].sort_values("arrival", kind="stable")
        for (store, run), own in events.groupby(["store_id", "run_key"], sort=False):
            kept = self.folds.getValue((store, run)) if self.folds.containsKey((store, run)) else None
            fold = VersionedFold(schedule, State.from_json(kept[1]) if kept else None, kept[0] if kept else 0)
            for e in own[_EVENT].astype(object).where(own[_EVENT].notna(), None).to_dict("records"):
                e |= {"arrival": int(e["arrival"]), "t_ms": int(e["t_ms"]), "length": None if e["length"] is None else int(e["length"])}
                out += [(rule, kind, store, run or None, *rest, None) for rule, kind, *rest in fold.feed(e)]
            self.folds.updateValue((store, run), (fold.at, fold.s.to_json()))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def reloaded_rules_stream(events: DataFrame, documents: DataFrame, file: str, buckets: int = BUCKETS) -> DataFrame:
    """Incidents of a stream of RULE_EVENT rows under a stream of documents, and one row about each document.

    documents: published (long, their order), valid_ms (long; null: at once), document (text; null: back to the file).
    Rows about documents have rule `rules`, kind APPLIED, SAME, REFUSED or RESET, the text's SHA-256 as key, published
    as onset_ms, the start of what is now valid as detected_ms, and the reasons in detail. Stores share buckets by a
    hash; more buckets mean more parallel tasks. The session's state store must be RocksDB.
    """
    parse(file)
    run = F.coalesce("run_id", F.lit(""))
    own = events.select(*_EVENT, run.alias("run_key"), F.pmod(F.xxhash64("store_id", run), F.lit(buckets)).cast("int").alias("bucket"))
    dealt = documents.select("published", "valid_ms", "document", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    both = own.unionByName(dealt, allowMissingColumns=True)
    return both.groupBy("bucket").transformWithStateInPandas(statefulProcessor=ReloadProcessor(file), outputStructType=f"{VERSIONED_OUT}, detail string", outputMode="Append", timeMode="None")


def reload_heartbeat(spark: SparkSession, checkpoint: str) -> DataFrame:
    """For each store and run: watermark, buffered and late events, and how many documents its watermark has passed."""
    state = spark.read.format("statestore").option("stateVarName", "folds").load(checkpoint)
    number = lambda name: F.get_json_object("user_map_value.json", f"$.{name}").cast("long")
    buffered = F.size(F.from_json(F.get_json_object("user_map_value.json", "$.buffer"), "array<string>")).cast("long")
    return state.select(
        F.col("user_map_key.store_id").alias("store_id"), F.nullif(F.col("user_map_key.run"), F.lit("")).alias("run_id"), F.col("user_map_value.at").alias("document"),
        number("watermark").alias("watermark_ms"), buffered.alias("buffered"), number("late").alias("late"),
    )
