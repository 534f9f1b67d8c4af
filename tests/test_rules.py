"""Rules as DataFrame operations, as a fold over arrivals, and as streams: the same incidents from all."""

from __future__ import annotations

import os
import random
from dataclasses import replace

import pytest

from aislewise.operators import rules
from aislewise.operators.fold import Fold, State, fold_incidents
from aislewise.schemas import PREFIX, RULE_EVENT
from aislewise.streaming import rules_stream

OFF = rules.Rule("off", "1.0.0", "off")
SMALL = rules.Rules(grace=50, threshold=5, sustain=60, hysteresis=2, clear_sustain=30, dwell_zones=("a", "b"), limit=100, ttl=400, stitch=0, absence=OFF, footfall_zones=("a", "b"), window=100, history=3, factor=1.5, min_count=2)


def event(arrival, t, kind, **more):
    row = {"store_id": "s", "run_id": None, "arrival": arrival, "id": f"e{arrival:05d}", "type": f"{PREFIX}store.{kind}", "t_ms": t, "sequence": f"{arrival:05d}", "zone_id": None, "track_id": None, "how": None, "queue_id": None, "length": None}
    return row | more


def frame(spark, events):
    names = [c.split()[0] for c in RULE_EVENT.split(", ")]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in events], RULE_EVENT)


def random_events(seed, n=250, stores=("s", "t")):
    rng, out, t = random.Random(seed), [], 1000
    for i in range(n):
        t += rng.choice([0, 1, 5, 20, 45])
        late = t - rng.choice([0, 0, 0, 10, 40, 90])
        who = {"store_id": rng.choice(stores), "run_id": rng.choice([None, None, "run-1"])}
        if rng.random() < 0.5:
            out.append(event(i, late, "queue.length", queue_id=rng.choice("xy"), length=rng.randint(0, 9), **who))
        else:
            out.append(event(i, late, rng.choice(["zone.entered", "zone.exited"]), zone_id=rng.choice("abc"), track_id=f"k{rng.randint(0, 3)}", how=rng.choice([None, "crossed", "appeared", "lost"]), **who))
    return out


def short(df):
    return sorted((r.rule_id, r.kind, r.store_id, r.run_id or "", r.key, r.onset_ms, r.detected_ms) for r in df.collect())


def folded(df):
    return sorted((r.rule, r.kind, r.store_id, r.run_id or "", r.key, r.onset_ms, r.detected_ms) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_frames_and_fold_agree(spark, seed):
    events = frame(spark, random_events(seed))
    want = sorted(short(rules.queue_alerts(events, SMALL)) + short(rules.dwell_alerts(events, SMALL)))
    assert folded(fold_incidents(events, SMALL)) == want
    assert want


def test_duplicates_and_late_rows(spark):
    rows = [event(1, 100, "clock.tick"), event(2, 200, "clock.tick"), event(3, 150, "clock.tick"), event(4, 151, "clock.tick"), event(5, 200, "clock.tick", id="e00002")]
    assert {r.arrival: r.late for r in rules.late_split(frame(spark, rows), 50).collect()} == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert sorted(r.arrival for r in rules.first_of_duplicates(frame(spark, rows)).collect()) == [1, 2, 3, 4]


def test_running_max_over_many_cuts(spark):
    rng = random.Random(1)
    rows = [event(i, rng.randint(0, 10_000), "clock.tick", store_id=rng.choice("st")) for i in range(300)]
    out = rules.running_max(frame(spark, rows), rules.KEY, "arrival", "t_ms", n=7).collect()
    for r in out:
        assert r.before_max == max((e["t_ms"] for e in rows if e["store_id"] == r.store_id and e["arrival"] < r.arrival), default=None)


def test_footfall_equals_a_plain_count(spark):
    events = random_events(11, 600, stores=("s",))
    windows = {(r.store_id, r.run_id, r.start_ms, r.zone_id): r.n for r in rules.footfall_windows(frame(spark, events), SMALL).collect()}
    seen, kept, top = {}, [], {}
    for e in events:
        key = (e["store_id"], e["run_id"])
        top[key] = max(top.get(key, e["t_ms"]), e["t_ms"])
        start = e["t_ms"] - e["t_ms"] % 100
        if start + 150 > top[key]:
            kept.append((key, start, e))
    for key, start, e in kept:
        if start + 150 <= top[key]:
            for z in "ab":
                seen.setdefault((*key, start, z), 0)
                seen[*key, start, z] += e["type"].endswith("zone.entered") and e["how"] != "appeared" and e["zone_id"] == z
    assert windows == seen and any(seen.values())


def test_empty_tables(spark):
    none = frame(spark, [])
    for df in (rules.queue_alerts(none, SMALL), rules.dwell_alerts(none, SMALL), rules.footfall_spikes(rules.footfall_windows(none, SMALL), SMALL), fold_incidents(none, SMALL)):
        assert df.count() == 0


def run_fold(events, r):
    fold = Fold(r)
    return [x for e in events for x in fold.feed(e)]


def test_absence_opens_without_a_register_and_ends_with_one():
    r = replace(SMALL, absence=rules.Rule("R-ABS", "1.0.0"), expect=f"{PREFIX}store.register.opened", within=80)
    queue = [event(1, 100, "queue.length", queue_id="x", length=9), event(2, 130, "queue.length", queue_id="x", length=9)]
    opened = run_fold([*queue, event(3, 400, "clock.tick")], r)
    assert ("R-ABS", "OPENED", "x", 160, 240) in opened
    cancelled = run_fold([*queue, event(3, 200, "register.opened"), event(4, 400, "clock.tick")], r)
    assert not [x for x in cancelled if x[0] == "R-ABS"]
    ended = run_fold([*queue, event(3, 300, "register.opened"), event(4, 500, "clock.tick")], r)
    assert ("R-ABS", "RESOLVED", "x", 160, 300) in ended


def test_a_lost_visit_goes_on_with_the_track_that_appears():
    r = replace(SMALL, stitch=30)
    moves = [
        event(1, 100, "zone.entered", zone_id="a", track_id="k1", how="crossed"), event(2, 150, "zone.exited", zone_id="a", track_id="k1", how="lost"),
        event(3, 170, "zone.entered", zone_id="a", track_id="k2", how="appeared"), event(4, 300, "zone.exited", zone_id="a", track_id="k2", how="crossed"), event(5, 900, "clock.tick"),
    ]
    assert run_fold(moves, r) == [(r.dwell.id, "OPENED", "k1|a", 100, 200), (r.dwell.id, "RESOLVED", "k1|a", 100, 300)]
    assert run_fold([e | {"how": "crossed"} for e in moves], r)[0][2] == "k2|a"
    unstitched = [moves[0], moves[1], moves[4]]
    assert run_fold(unstitched, r) == []


def test_flush_ends_what_waits():
    r = replace(SMALL, stitch=30)
    events = [event(1, 100, "zone.entered", zone_id="a", track_id="k1", how="crossed"), event(2, 110, "clock.tick")]
    fold = Fold(r)
    assert [x for e in events for x in fold.feed(e)] == [] and fold.flush_to(400) == [(r.dwell.id, "OPENED", "k1|a", 100, 200)]
    assert fold.flush_to(300) == [] and fold.s.watermark == 400


def test_a_late_loss_takes_the_continuation_it_would_have_had():
    """k1 is lost at 150, heard of at watermark 190; k2, which appeared at 160, goes on with k1's visit."""
    r = replace(SMALL, stitch=30, grace=0, limit=100)
    moves = [
        event(1, 100, "zone.entered", zone_id="a", track_id="k1", how="crossed"), event(2, 160, "zone.entered", zone_id="a", track_id="k2", how="appeared"), event(3, 190, "clock.tick"),
        event(4, 150, "zone.exited", zone_id="a", track_id="k1", how="lost"), event(5, 250, "clock.tick"), event(6, 260, "zone.exited", zone_id="a", track_id="k2", how="crossed"), event(7, 300, "clock.tick"),
    ]
    assert run_fold(moves, r) == [(r.dwell.id, "OPENED", "k1|a", 100, 200), (r.dwell.id, "RESOLVED", "k1|a", 100, 260)]


def test_state_survives_as_text():
    r = replace(SMALL, stitch=30)
    events = random_events(3)
    whole, state, parts = run_fold(events, r), None, []
    for i in range(0, len(events), 40):
        fold = Fold(r, State.from_json(state))
        parts += [x for e in events[i : i + 40] for x in fold.feed(e)]
        state = fold.s.to_json()
    assert parts == whole


def streamed(spark, events, folder, parts=3):
    """A stream over files that hold the events in order of arrival."""
    size = -(-len(events) // parts)
    for k in range(parts):
        path = f"{folder}/part{k}"
        frame(spark, events[k * size : (k + 1) * size]).coalesce(1).write.json(path)
        for name in os.listdir(path):
            if name.endswith(".json"):
                os.makedirs(f"{folder}/in", exist_ok=True)
                os.rename(f"{path}/{name}", f"{folder}/in/{k}.json")
                os.utime(f"{folder}/in/{k}.json", (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(RULE_EVENT).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def test_stream_of_the_fold_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rules_stream.ROCKS)
    r, events = replace(SMALL, stitch=30), random_events(5)
    query = rules_stream.rules_stream(streamed(spark, events, tmp_path), r).writeStream.format("memory").queryName("rule_incidents").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert folded(spark.table("rule_incidents")) == folded(fold_incidents(frame(spark, events), r))
    beats = {(b.store_id, b.run_id): b for b in rules_stream.heartbeat(spark, str(tmp_path / "check")).collect()}
    assert beats.keys() == {(e["store_id"], e["run_id"]) for e in events}
    for (store, run), b in beats.items():
        fold = Fold(r)
        own = [e for e in events if (e["store_id"], e["run_id"]) == (store, run)]
        for e in own:
            fold.feed(e)
        assert (b.watermark_ms, b.late, b.buffered) == (fold.s.watermark, fold.s.late, len(fold.s.buffer)) and b.processed + b.buffered <= len(own)


def test_footfall_stream_gives_closed_windows_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rules_stream.ROCKS)
    events = [event(i, 1000 + (7 if i % 3 else 700) * i, "zone.entered", zone_id="ab"[i % 2], track_id=f"k{i}", how="crossed", store_id="s" if i % 3 else "fast") for i in range(120)]
    query = rules_stream.footfall_to_table(streamed(spark, events, tmp_path), SMALL, str(tmp_path / "windows"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = sorted((r.start_ms, r.zone_id, r.n) for r in spark.read.parquet(str(tmp_path / "windows")).collect())
    want = sorted((r.start_ms, r.zone_id, r.n) for r in rules.footfall_windows(frame(spark, events), SMALL).collect())
    assert got and got == want  # a fast store makes nothing of the slow one late
