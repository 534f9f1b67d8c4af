"""Assignment, tracking metrics, the tracker and zones on small hand-made boxes."""

from __future__ import annotations

from itertools import permutations

import random

import numpy as np
import pytest

from aislewise.operators import tracking as T
from aislewise.operators.assignment import assign

BOX = "sequence string, frame long, t_ms long, track_id long, x1 double, y1 double, x2 double, y2 double"


def walk(track, frames, x0, speed=2.0, y=10.0):
    return [("c", f, f * 100, track, x0 + speed * f, y, x0 + speed * f + 10, y + 20) for f in frames]


def test_assignment_equals_trying_all():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 4), (4, 4), (5, 3)):
        cost = rng.normal(size=(n, m))
        rows, cols = assign(cost)
        small, large = (cost, range(m)) if n <= m else (cost.T, range(n))
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(large, len(small)))
        assert len(rows) == min(n, m) and cost[rows, cols].sum() == pytest.approx(best)


def test_perfect_tracks_score_one(spark):
    truth = spark.createDataFrame(walk(1, range(10), 0) + walk(2, range(10), 200), BOX)
    mot, one, h = T.clear_mot(truth, truth).first(), T.identity_f1(truth, truth).first(), T.hota(truth, truth).first()
    assert (mot.mota, mot.idsw, mot.fp, mot.fn, mot.mt) == (1.0, 0, 0, 0, 2)
    assert (one.idf1, one.idtp) == (1.0, 20)
    assert (h.hota, h.det_a, h.ass_a) == pytest.approx((1, 1, 1))


def test_switches_misses_and_phantoms_cost(spark):
    truth = spark.createDataFrame(walk(1, range(10), 0), BOX)
    tracks = spark.createDataFrame(walk(7, range(4), 0) + walk(8, range(5, 10), 0) + walk(9, [2], 500), BOX)
    mot, one, noise = T.clear_mot(truth, tracks).first(), T.identity_f1(truth, tracks).first(), T.sequence_noise(truth, tracks).first()
    assert (mot.idsw, mot.fp, mot.fn, mot.tp) == (1, 1, 1, 9) and mot.mota == pytest.approx(0.7)
    assert (one.idtp, one.idfp, one.idfn) == (5, 5, 5)
    assert (noise.frames, noise.misses, noise.switches, noise.fragments) == (10, 1, 1, 1)


def test_suppression_keeps_the_best_box(spark):
    rows = [("c", 1, 1, 0.5, "p", 0.0, 0.0, 10.0, 10.0), ("c", 1, 2, 0.9, "p", 1.0, 0.0, 11.0, 10.0), ("c", 1, 3, 0.4, "p", 50.0, 0.0, 60.0, 10.0), ("c", 1, 4, 0.3, "q", 1.0, 0.0, 11.0, 10.0), ("c", 2, 5, 0.1, "p", 0.0, 0.0, 1.0, 1.0)]
    dets = spark.createDataFrame(rows, "sequence string, frame long, det_id long, score double, cls string, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.det_id for r in T.nms(dets, 0.45).collect()) == [2, 3, 4, 5]


def test_detections_match_greedily_and_ignore_regions(spark):
    det = "sequence string, frame long, det_id long, score double, x1 double, y1 double, x2 double, y2 double"
    dets = spark.createDataFrame([("c", 1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("c", 1, 2, 0.8, 0.0, 0.0, 10.0, 11.0), ("c", 1, 3, 0.7, 90.0, 0.0, 99.0, 9.0)], det)
    box = "sequence string, frame long, x1 double, y1 double, x2 double, y2 double"
    truth, waste = spark.createDataFrame([("c", 1, 0.0, 0.0, 10.0, 10.0)], box), spark.createDataFrame([("c", 1, 90.0, 0.0, 99.0, 9.0)], box)
    matched = T.greedy_detection_matches(dets, truth, waste)
    assert sorted((r.det_id, r.tp) for r in matched.collect()) == [(1, 1), (2, 0)]
    n = spark.createDataFrame([("c", 2)], "sequence string, n long")
    assert T.average_precision(matched, n).first().ap == pytest.approx(0.5)
    assert T.precision_recall_at(matched, n, [0.85]).first().precision == 1.0


def test_tracker_follows_two_people_through_a_gap(spark):
    rows = [r for r in walk(1, range(30), 0) + walk(2, range(30), 300, -2.0, 60.0) if not (r[3] == 1 and 10 <= r[1] < 14)]
    dets = spark.createDataFrame([(s, f, t, i, "person", x1, y1, x2, y2, 0.9) for i, (s, f, t, _, x1, y1, x2, y2) in enumerate(rows)], "sequence string, frame long, t_ms long, det_id long, cls string, x1 double, y1 double, x2 double, y2 double, score double")
    out = T.byte_track(dets).collect()
    assert len({r.track_id for r in out}) == 2 and len(out) >= len(rows) - 4


def test_matching_in_order_equals_the_general_assignment():
    from aislewise.operators.assignment import in_order, most_pairs_least_distance

    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (np.sort(rng.integers(0, 80, rng.integers(0, 9))) for _ in range(2))
        i, j = in_order(a, b, 4, 20)
        delta = b[None, :] - a[:, None]
        allowed = (delta >= -4) & (delta <= 20)
        want = most_pairs_least_distance(np.abs(delta), allowed)
        assert allowed[i, j].all() and len(set(i)) == len(i) == len(set(j)) == len(want)
        assert np.abs(delta[i, j]).sum() == sum(abs(delta[x, y]) for x, y in want)


def test_heaviest_total_equals_one_assignment():
    from aislewise.operators.assignment import heaviest_total

    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 30):
        pairs = np.unique(rng.integers(0, 12, (n, 2)), axis=0).reshape(-1, 2)
        weight = rng.integers(1, 20, len(pairs)).astype(float)
        table = np.zeros((12, 12))
        table[pairs[:, 0], pairs[:, 1]] = weight
        assert heaviest_total(pairs[:, 0], pairs[:, 1], weight) == table[assign(-table)].sum()


def test_small_and_wide_boxes_are_not_reported(spark):
    det = "sequence string, frame long, t_ms long, det_id long, cls string, x1 double, y1 double, x2 double, y2 double, score double"
    rows = [("c", f, f, 3 * f + k, "p", *box, 0.9) for f in range(4) for k, box in enumerate([(0.0, 0.0, 10.0, 20.0), (100.0, 0.0, 102.0, 4.0), (200.0, 0.0, 240.0, 20.0)])]
    out = T.byte_track(spark.createDataFrame(rows, det)).collect()
    assert {round(r.x1 / 100) for r in out} == {0} and len(out) == 4
    every = T.byte_track(spark.createDataFrame(rows, det), T.TrackerSettings(min_area=0.0, max_aspect=9.0)).collect()
    assert {round(r.x1 / 100) for r in every} == {0, 1, 2}


def test_a_lost_member_hands_its_place_to_who_appears(spark):
    zone = T.Zone("z", ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)), "q")
    one = [("c", t, 1, 5.0, 5.0) for t in range(0, 10_000, 500)]
    other = [("c", t, 2, 5.1, 5.0) for t in range(11_000, 20_000, 500)]
    late = [("c", t, 3, 50.0, 5.0) for t in range(0, 30_000, 500)]
    out = T.zone_events(spark.createDataFrame(one + other + late, "sequence string, t_ms long, track_id long, x double, y double"), (zone,)).collect()
    queue = sorted((r.t_ms, r.kind, r.track_id, r.how) for r in out if r.kind.startswith("queue"))
    assert queue == [(3000, "queue.joined", 1, None), (11_000, "queue.joined", 2, None), (11_000, "queue.left", 1, "left"), (19_500, "queue.left", 2, "served")]
    assert T.zone_events(spark.createDataFrame(one, "sequence string, t_ms long, track_id long, x double, y double"), ()).count() == 0


def test_zone_events_and_queue_lengths(spark):
    zone = T.Zone("z", ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)), "q", (9.0, 5.0), 2.0)
    path = [("c", i, i * 500, 1, -2.0 + min(i, 22) * 0.5 if i < 40 else 14.0, 5.0) for i in range(50)]
    out = T.zone_events(spark.createDataFrame(path, "sequence string, frame long, t_ms long, track_id long, x double, y double"), (zone,))
    kinds = [(r.kind, r.how) for r in out.orderBy("t_ms", "kind").collect()]
    assert ("zone.entered", "crossed") in kinds and ("zone.exited", "crossed") in kinds
    assert [k for k, _ in kinds].count("queue.joined") == [k for k, _ in kinds].count("queue.left") == 1
    assert [r.length for r in T.queue_lengths(out).orderBy("t_ms").collect()] == [1, 0]
    assert [r.t_ms % 10_000 for r in T.ticks(out, 1000).collect()]


def test_tiles_cover_the_image():
    covered = np.zeros((50, 70), bool)
    for x1, y1, x2, y2 in T.tiles(70, 50, 32):
        covered[y1:y2, x1:x2] = True
    assert covered.all()
    assert T.regions_of_zones({"z": [(10, 10), (20, 10), (20, 20)]}, 100, 100)["z"] == (9, 9, 21, 21)


def test_empty_tables(spark):
    none = spark.createDataFrame([], BOX)
    assert T.clear_mot(none, none).count() == T.identity_f1(none, none).count() == T.hota(none, none).count() == T.sequence_noise(none, none).count() == 0


def test_matches_of_many_clusters_over_many_batches(spark):
    """Clusters that lie over the ends of batches, hot keys and null stores: the pairs that one general assignment a key finds."""
    from aislewise.operators.assignment import most_pairs_least_distance
    from aislewise.operators.scoring import matches

    rng = random.Random(6)
    key = lambda: ("R", rng.choice([None, "s"]), rng.choice("aaab"))
    truth = [(*key(), f"g{i}", rng.randrange(6000)) for i in range(220)]
    seen = [(*key(), f"i{i}", "OPENED" if i % 9 else "RESOLVED", rng.randrange(6000)) for i in range(240)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = matches(spark.createDataFrame(truth, "rule_id string, store_id string, key string, gt_id string, at_ms long"), spark.createDataFrame(seen, "rule_id string, store_id string, key string, incident_id string, kind string, detected_ms long"), 5, 30).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    pairs = distance = 0
    for k in {t[:3] for t in truth}:
        a, b = np.array([t[4] for t in truth if t[:3] == k]), np.array([i[5] for i in seen if i[:3] == k and i[4] == "OPENED"])
        delta = b[None, :] - a[:, None] if len(b) else np.zeros((len(a), 0))
        best = most_pairs_least_distance(np.abs(delta).astype(float), (delta >= -5) & (delta <= 30))
        pairs, distance = pairs + len(best), distance + sum(abs(delta[i, j]) for i, j in best)
    assert len(got) == pairs > 20 and sum(abs(r.latency_ms) for r in got) == distance
    assert len({r.gt_id for r in got}) == len({r.incident_id for r in got}) == len(got)
    at = {t[3]: t for t in truth} | {i[3]: i for i in seen}
    assert all(at[r.gt_id][:3] == at[r.incident_id][:3] == (r.rule_id, r.store_id, r.key) and at[r.incident_id][5] - at[r.gt_id][4] == r.latency_ms for r in got)
