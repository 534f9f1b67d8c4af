"""Tables changed by micro-batches: any division gives the same, others' files stay, repeats and cuts do no harm."""

from __future__ import annotations

import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from aislewise.operators import incidents
from aislewise.sources import files, folders
from aislewise.streaming import upserts

LOG = "incident_id string, kind string, onset_ms long, detected_ms long"
ACTIONS = "incident_id string, at_ms long, status string"


def random_log(n=120, seed=2):
    rng = random.Random(seed)
    log = [(f"i{rng.randrange(25)}", rng.choice(["OPENED", "OPENED", "RESOLVED"]), t, t + rng.randrange(9)) for t in range(n)]
    return log, [(f"i{rng.randrange(25)}", t, rng.choice(["ACKNOWLEDGED", "CONFIRMED"])) for t in range(n // 3)]


def times(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).glob("bucket=*/*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_three_batches_equal_one_and_the_log_as_a_whole(spark, tmp_path):
    log, actions = random_log()
    parts = [upserts.incident_changes(spark.createDataFrame(log[k::3], LOG), spark.createDataFrame(actions[k::3], ACTIONS)) for k in range(3)]
    whole = upserts.incident_changes(spark.createDataFrame(log, LOG), spark.createDataFrame(actions, ACTIONS))
    three, one = (upserts.incidents(spark, f"file://{tmp_path}/{n}", 8) for n in ("three", "one"))
    got = rows(upserts.incident_rows(upserts.in_batches(three, parts)))
    assert got == rows(upserts.incident_rows(upserts.in_batches(one, [whole])))
    assert got == rows(incidents.incident_table(spark.createDataFrame(log, LOG), spark.createDataFrame(actions, ACTIONS)))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = upserts.incidents(spark, f"file://{tmp_path}/t", 8)
    log, _ = random_log()
    table.upsert(upserts.incident_changes(spark.createDataFrame(log, LOG)), 0)
    before = times(tmp_path / "t")
    touched = table.upsert(upserts.incident_changes(spark.createDataFrame([("i3", "RESOLVED", 1, 900)], LOG)), 1)
    after = times(tmp_path / "t")
    own = lambda found: {k for k in found if k.startswith(f"bucket={touched[0]}/")}
    assert len(touched) == 1 and len(before) > 3
    assert {k: v for k, v in before.items() if k not in own(before)} == {k: v for k, v in after.items() if k not in own(after)} and own(before) != own(after)
    assert table.upsert(upserts.incident_changes(spark.createDataFrame([], LOG)), 2) == [] and times(tmp_path / "t") == after


def test_repeats_change_nothing_and_a_cut_batch_is_finished(spark, tmp_path, monkeypatch):
    table = upserts.incidents(spark, f"file://{tmp_path}/t", 4)
    log, actions = random_log()
    first = upserts.incident_changes(spark.createDataFrame(log[:60], LOG), spark.createDataFrame(actions[:20], ACTIONS))
    second = upserts.incident_changes(spark.createDataFrame(log[60:], LOG), spark.createDataFrame(actions[20:], ACTIONS))
    table.upsert(first, 0)
    once = rows(table.read())
    table.upsert(first, 0)
    assert rows(table.read()) == once  # actions are not counted twice
    read = table.spark.read.__class__.parquet
    calls = []

    def cut(self, path, *more):
        if "_pending/batch=1" in str(path):
            calls.append(path)
            raise RuntimeError("lost")
        return read(self, path, *more)

    monkeypatch.setattr(table.spark.read.__class__, "parquet", cut)
    with pytest.raises(RuntimeError, match="lost"):
        table.upsert(second, 1)  # written beside, not put in place
    monkeypatch.undo()
    assert calls and rows(table.read()) == once
    table.upsert(second, 1)
    want = rows(upserts.merge_incidents(first.unionByName(second)))
    assert rows(table.read()) == want
    table.upsert(second, 1)
    assert rows(table.read()) == want and table.upsert(first, 0) == [] and rows(table.read()) == want
    assert folders.children(spark, f"file://{tmp_path}/t/_pending") == ["batch=1"]


def test_heartbeats_and_scores(spark, tmp_path):
    beats = [("a", 5, "x"), ("b", 1, "y"), ("a", 9, "z"), ("a", 7, "w"), ("b", 1, "v")]
    schema, order = "task string, at_ms long, state string", (["task"], ["at_ms"], ["state"])
    for name, merge, want in (("last", upserts.latest_rows(*order), [("a", 9, "z"), ("b", 1, "y")]), ("first", upserts.first_rows(*order), [("a", 5, "x"), ("b", 1, "v")])):
        table = upserts.BucketedTable(spark, f"file://{tmp_path}/{name}", schema, ["task"], merge, 4)
        assert rows(upserts.in_batches(table, [spark.createDataFrame([b], schema) for b in beats])) == want


def test_published_rows_are_purged_after_three_days(spark, tmp_path):
    hour, table = upserts.HOUR_MS, upserts.outbox(spark, f"file://{tmp_path}/o", 6)
    box = [("s", i, f"r{i}", "pending", 0, None) for i in range(40)]
    table.upsert(spark.createDataFrame(box, upserts.OUTBOX), 0)
    table.upsert(spark.createDataFrame([("s", i, f"r{i}", "published", 1, i * hour) for i in range(30)] + [("s", 35, "r35", "pending", 2, None)], upserts.OUTBOX), 1)
    table.upsert(spark.createDataFrame([("s", 5, "r5", "published", 1, 90 * hour), ("s", 6, "r6", "pending", 9, None)], upserts.OUTBOX), 2)  # answers that came twice or late
    before = times(tmp_path / "o")
    touched = upserts.purge_published(table, 80 * hour, 0)
    assert sorted((r.sequence, r.state) for r in table.read().collect()) == [(i, "published" if i < 30 else "pending") for i in range(8, 40)]
    kept = lambda found: {k: v for k, v in found.items() if int(k.split("/")[0][7:]) not in touched}
    assert kept(before) == kept(times(tmp_path / "o")) and touched
    assert upserts.purge_published(table, 80 * hour, 1) == []
    table.drop_where(F.lit(True), 2)
    assert table.read().count() == 0 and not times(tmp_path / "o")  # emptied buckets are gone
    table.upsert(spark.createDataFrame(box[:2], upserts.OUTBOX), 3)
    assert table.read().count() == 2


def test_expired_days_are_dropped(spark, tmp_path):
    day, path = 86_400_000, f"file://{tmp_path}/log"
    files.write_log(spark.createDataFrame([("s", "t", i, i * day) for i in range(40)], "store_id string, type string, t_ms long, received_ms long"), path)
    (tmp_path / "log" / "received_date=soon").mkdir()
    gone = folders.drop_expired_days(spark, path, date(1970, 2, 9))
    assert gone == [date(1970, 1, d) for d in range(1, 10)] and (tmp_path / "log" / "received_date=soon").exists()
    (tmp_path / "log" / "received_date=soon").rmdir()
    assert spark.read.parquet(path).agg(F.min("received_ms"), F.count("*")).first() == (9 * day, 31)
    assert folders.drop_expired_days(spark, path, date(1970, 2, 9)) == [] and folders.drop_expired_days(spark, f"{path}/none", date(1970, 2, 9)) == []


def test_a_stream_of_changes(spark, tmp_path):
    log, _ = random_log(60)
    changes = upserts.incident_changes(spark.createDataFrame(log, LOG))
    changes.repartition(3).write.parquet(str(tmp_path / "in"))
    table = upserts.incidents(spark, f"file://{tmp_path}/t", 4)
    for _ in range(2):
        stream = spark.readStream.schema(upserts.INCIDENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = upserts.upsert_stream(stream, table, str(tmp_path / "check"))
        query.awaitTermination(180)
        assert query.exception() is None and rows(table.read()) == rows(upserts.merge_incidents(changes))
