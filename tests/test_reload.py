"""Rules documents: checks, schedules, a fold and windows under them, and a stream that is restarted between versions."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from aislewise.operators import reload, rules
from aislewise.operators.fold import Fold, State, fold_incidents
from aislewise.operators.reload import ALWAYS, Schedule, VersionedFold, parse
from aislewise.schemas import RULE_EVENT
from aislewise.streaming import reload_stream, rules_stream
from tests.test_rules import event, frame, random_events

P = "com.retail."


def text(threshold=5, queue="1.0.0", limit=100, dwell="1.0.0", mode="enforce", footfall="1.0.0", factor=1.5, least=2, grace=50, window=100, zones=("a", "b")):
    ms = lambda n: f"PT{n / 1000}S"
    return json.dumps({"grace": ms(grace), "rules": [
        {"id": "R-QUEUE-001", "version": queue, "mode": mode, "severity": "medium", "params": {"threshold": threshold, "sustain": ms(60), "hysteresis": 2, "clearSustain": ms(30)}},
        {"id": "R-DWELL-001", "version": dwell, "mode": "enforce", "severity": "low", "params": {"zones": ["a", "b"], "limit": ms(limit), "sessionTtl": ms(400), "stitch": ms(30)}},
        {"id": "R-ABS-001", "version": "1.0.0", "mode": "off", "severity": "high", "params": {"trigger": "R-QUEUE-001", "expect": f"{P}store.register.opened", "within": ms(80)}},
        {"id": "R-FOOT-001", "version": footfall, "mode": "enforce", "severity": "low", "params": {"zones": list(zones), "window": ms(window), "history": ms(3 * window), "factor": factor, "minCount": least, "countAppeared": False}},
    ]})


FILE = text()


def test_document_gives_parameters_versions_and_definitions():
    d = parse(FILE)
    assert (d.rules.grace, d.rules.threshold, d.rules.sustain, d.rules.limit, d.rules.stitch, d.rules.window, d.rules.history) == (50, 5, 60, 100, 30, 100, 3)
    assert d.versions == {"R-QUEUE-001": "1.0.0", "R-DWELL-001": "1.0.0", "R-ABS-001": "1.0.0", "R-FOOT-001": "1.0.0"} and len(d.digest) == 64
    assert d.rules.queue.mode == "enforce" and d.rules.absence.mode == "off" and d.definitions["R-QUEUE-001"]["params"]["threshold"] == 5


def changed(**edits):
    tree = json.loads(FILE)
    for path, value in edits.items():
        *at, last = path.split("__")
        own = tree
        for a in at:
            own = own[int(a) if a.isdigit() else a]
        own[last] = value
    return json.dumps(tree)


@pytest.mark.parametrize("bad", [
    "rules: [", "[1, 2]", "{}", "7", changed(grace="soon"), changed(rules__0__version="one"), changed(rules__0__version="1.0"), changed(rules__0__mode="on"),
    changed(rules__0__id="R-NEW"), changed(rules__1__id="R-QUEUE-001"), changed(rules__0__params__threshold="6"), changed(rules__0__params__threshold=-1),
    changed(rules__0__params__hysteresis=9), changed(rules__0__params__height=1), changed(rules__3__params__history="PT0.25S"), changed(rules__1__params__zones="a"),
    json.dumps({"grace": "PT1S", "rules": json.loads(FILE)["rules"][1:]}),
])
def test_odd_documents_are_refused(bad):
    with pytest.raises(ValueError):
        parse(bad)
    schedule = Schedule(FILE)
    assert schedule.publish(bad)[0] == "REFUSED" and len(schedule) == 1


def test_which_documents_may_replace_which():
    schedule = Schedule(FILE)
    assert schedule.publish(FILE) == ("SAME", [])
    assert schedule.publish(text(queue="1.0.1"))[0] == "APPLIED"  # a new version alone
    assert schedule.publish(text(queue="1.0.1", threshold=4)) == ("REFUSED", ["R-QUEUE-001: changed, but 1.0.1 is not higher than 1.0.1"])
    assert schedule.publish(text(queue="1.0.0", threshold=4))[0] == "REFUSED"
    assert schedule.publish(text(queue="1.0.1", mode="shadow"))[0] == "REFUSED"
    assert schedule.publish(text(queue="1.0.10", mode="shadow"), 300)[0] == "APPLIED"
    assert schedule.publish(text(queue="1.0.9", threshold=9), 400)[0] == "REFUSED"
    assert schedule.publish(text(queue="2.0.0", threshold=9), 200)[0] == "APPLIED" and schedule.valid_from(-1) == 300  # never before the one it replaces
    for structure in (text(queue="3.0.0", grace=60), text(queue="3.0.0", window=50), text(queue="3.0.0", zones=("a",))):
        assert schedule.publish(structure)[0] == "REFUSED"
    without = json.loads(FILE)
    without["rules"].pop()
    assert schedule.publish(json.dumps(without))[1][0] == "R-FOOT-001: added or removed"
    assert schedule.publish(None, 500)[0] == "RESET" and schedule.documents[-1].digest == schedule.file.digest
    again = Schedule(FILE, schedule.to_json())
    assert again.texts == schedule.texts and [d.digest for d in again.documents] == [d.digest for d in schedule.documents]


def split_by_hand(events, versions):
    """Each key's events through a Fold of the first version up to the instant before the second, and so on."""
    out = []
    for store, run in sorted({(e["store_id"], e["run_id"]) for e in events}, key=repr):
        at, fold = 0, Fold(versions[0][1])
        say = lambda found: [(rule, kind, store, run, *rest, {x.id: x for x in (fold.r.queue, fold.r.dwell, fold.r.absence)}[rule].version) for rule, kind, *rest in found]  # noqa: E731,B023
        for e in events:
            if (e["store_id"], e["run_id"]) != (store, run):
                continue
            while at + 1 < len(versions) and versions[at + 1][0] <= max(fold.s.top, e["t_ms"]) - fold.r.grace:
                at += 1
                out += say(fold.flush_to(versions[at][0] - 1))
                fold = Fold(versions[at][1], State.from_json(fold.s.to_json()))
            out += say(fold.feed(e))
    return sorted(out, key=repr)


NEW = text(queue="1.1.0", threshold=3, dwell="1.2.0", limit=60)


def rows_of(df):
    return sorted(((r.rule, r.kind, r.store_id, r.run_id, r.key, r.onset_ms, r.detected_ms, r.version) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 5])
def test_batch_under_a_schedule_equals_folds_split_at_its_watermarks(spark, seed):
    events = random_events(seed)
    times = sorted(e["t_ms"] for e in events)
    first, second = times[len(times) // 3], times[2 * len(times) // 3]
    published = [(first, NEW), (first, text(threshold=1)), (second, None)]  # the second is refused, the third a tombstone
    got = rows_of(reload.fold_incidents_scheduled(frame(spark, events), FILE, published))
    assert got == split_by_hand(events, [(ALWAYS, parse(FILE).rules), (first, parse(NEW).rules), (second, parse(FILE).rules)])
    assert {r[7] for r in got} >= {"1.0.0", "1.2.0"}
    alone = fold_incidents(frame(spark, events), parse(FILE).rules)
    assert sorted(map(repr, alone.collect())) == sorted(repr(r) for r in reload.fold_incidents_scheduled(frame(spark, events), FILE, []).select(*alone.columns).collect())


def test_a_queue_of_four_opens_only_under_the_lower_threshold():
    queue = [event(i, 100 + 10 * i, "queue.length", queue_id="x", length=4) for i in range(60)]
    schedule = Schedule(FILE)
    fold = VersionedFold(schedule)
    assert [x for e in queue[:20] for x in fold.feed(e)] == []
    schedule.publish(NEW, 400)
    opened = [x for e in queue[20:] for x in fold.feed(e)]
    assert opened == [("R-QUEUE-001", "OPENED", "x", 400, 460, "1.1.0", "enforce", "medium")]


def test_ids_stay_within_a_major_version(spark):
    rows = [("R-QUEUE-001", v, "s", None, "x", 5) for v in ("1.0.0", "1.9.3", "2.0.0")]
    ids = [r.incident_id for r in reload.with_incident_ids(spark.createDataFrame(rows, "rule string, version string, store_id string, run_id string, key string, onset_ms long")).collect()]
    assert ids[0] == ids[1] != ids[2]


def test_spikes_under_a_schedule(spark):
    counts = [1, 1, 1, 3, 1, 1, 1, 3, 1, 1, 1, 3, 1]
    windows = spark.createDataFrame([("s", None, 100 * i, "a", n) for i, n in enumerate(counts)], "store_id string, run_id string, start_ms long, zone_id string, n long")
    schedule = Schedule(FILE)
    plain = rules.footfall_spikes(windows, schedule.file.rules)
    same = lambda df: sorted((r.kind, r.onset_ms, r.detected_ms) for r in df.collect())
    assert same(reload.footfall_spikes_scheduled(windows, schedule)) == same(plain) and len(same(plain)) == 6
    schedule.publish(text(footfall="1.1.0", factor=5.0), 500)
    schedule.publish(None, 1100)
    got = [(r.kind, r.onset_ms, r.version) for r in reload.footfall_spikes_scheduled(windows, schedule).orderBy("detected_ms").collect()]
    assert got == [("OPENED", 300, "1.0.0"), ("RESOLVED", 300, "1.1.0"), ("OPENED", 1100, "1.0.0"), ("RESOLVED", 1100, "1.0.0")]


def put(spark, folder, name, rows, schema, at):
    """One file of a stream, with a time of change in order."""
    path = f"{folder}/.{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(path)
    os.makedirs(folder, exist_ok=True)
    found = next(f for f in os.listdir(path) if f.endswith(".json"))
    os.rename(f"{path}/{found}", f"{folder}/{name}.json")
    os.utime(f"{folder}/{name}.json", (1_700_000_000 + at,) * 2)


def test_a_stream_that_restarts_between_versions_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rules_stream.ROCKS)
    events = random_events(5)
    times = sorted(e["t_ms"] for e in events)
    valid, document = times[-len(times) // 3], "published long, valid_ms long, document string"
    inbox, control, out, check = (str(tmp_path / n) for n in ("events", "documents", "out", "check"))
    half = len(events) // 2
    own = [tuple(e[c.split()[0]] for c in RULE_EVENT.split(", ")) for e in events]

    def run():
        stream = spark.readStream.schema(RULE_EVENT).option("maxFilesPerTrigger", 1).json(inbox)
        documents = spark.readStream.schema(document).json(control)
        query = reload_stream.reloaded_rules_stream(stream, documents, FILE, buckets=4).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None

    put(spark, inbox, "a", own[: half // 2], RULE_EVENT, 0)
    put(spark, inbox, "b", own[half // 2 : half], RULE_EVENT, 60)
    put(spark, control, "a", [(1, 0, FILE)], document, 0)  # the file itself: nothing changes
    run()
    before = spark.read.parquet(out).count()
    put(spark, control, "b", [(2, valid, NEW), (3, valid, text(threshold=1)), (4, None, "rules: [")], document, 60)
    put(spark, inbox, "c", own[half:], RULE_EVENT, 120)
    run()  # from the checkpoint
    rows = spark.read.parquet(out)
    assert rows.count() > before
    about = [(r.kind, r.onset_ms) for r in rows.where(F.col("rule") == reload_stream.ABOUT).orderBy("onset_ms").collect()]
    assert about == [("SAME", 1), ("APPLIED", 2), ("REFUSED", 3), ("REFUSED", 4)]
    incidents = rows.where(F.col("rule") != reload_stream.ABOUT)
    batch = reload.fold_incidents_scheduled(frame(spark, events), FILE, [(valid, NEW)])
    assert rows_of(incidents) == rows_of(batch) and {r[7] for r in rows_of(incidents)} >= {"1.0.0", "1.2.0"}
    beats = {(r.store_id, r.run_id): r for r in reload_stream.reload_heartbeat(spark, check).collect()}
    assert beats.keys() == {(e["store_id"], e["run_id"]) for e in events}
    for (store, run_id), beat in beats.items():
        fold = VersionedFold(_scheduled([(valid, NEW)]))
        for e in events:
            if (e["store_id"], e["run_id"]) == (store, run_id):
                fold.feed(e)
        assert (beat.document, beat.watermark_ms, beat.buffered, beat.late) == (fold.at, fold.s.watermark, len(fold.s.buffer), fold.s.late)


def _scheduled(published):
    schedule = Schedule(FILE)
    for valid, document in published:
        schedule.publish(document, valid)
    return schedule
