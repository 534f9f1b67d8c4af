"""Rates, ratios and quantiles of counters, and grids of settings, against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from aislewise.functions import stats
from aislewise.operators import grid, rates


def test_counters_that_start_again(spark):
    rows = [("a", 0, 5), ("a", 1000, 9), ("a", 2000, 2), ("a", 2500, None), ("a", 3000, 2), ("b", 500, 7), ("a", 61_000, 12)]
    out = rates.increases(spark.createDataFrame(rows, "series string, t_ms long, value long"), ["series"])
    assert sorted((r.series, r.t_ms, r.increase) for r in out.collect()) == [("a", 1000, 4), ("a", 2000, 2), ("a", 3000, 0), ("a", 61_000, 10)]
    per = {(r.series, r.start_ms): r.rate for r in rates.windowed_rates(out, ["series"], 60_000).collect()}
    assert per == {("a", 0): 6 / 60, ("a", 60_000): 10 / 60}


def test_late_ratio_and_its_alert(spark):
    samples = lambda values: spark.createDataFrame([("s", 10_000 * i, v) for i, v in enumerate(values)], "series string, t_ms long, value long")
    out = rates.late_ratio(samples([0, 1, 3, 3]), samples([0, 100, 200, 300]), 60_000).collect()
    assert [(r.start_ms, r.late_rate, r.received_rate, r.ratio, r.alert) for r in out] == [(0, 3 / 60, 5.0, 0.01, False)]
    quiet = rates.late_ratio(samples([0, 1]), samples([0, 2]), 60_000).first()
    assert quiet.ratio == pytest.approx(1 / 60) and quiet.alert  # a received rate under one a second counts as one


def test_histograms_add_up_and_quantiles_interpolate(spark):
    rng = random.Random(4)
    borders = [1.0, 2.0, 5.0, 10.0]
    rows = [(rng.choice("ab"), rng.choice([None, rng.uniform(0, 12)])) for _ in range(500)] + [("c", 99.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    whole = {(r.k, r.le): r["count"] for r in rates.histogram(df, ["k"], "v", borders).collect()}
    assert whole == {(k, le): sum(1 for q, v in rows if q == k and v is not None and v <= le) for k in "abc" for le in [*borders, float("inf")]}
    parts = [rates.histogram(df.where(F.col("v") % 2 < 1), ["k"], "v", borders), rates.histogram(df.where(F.col("v") % 2 >= 1), ["k"], "v", borders)]
    merged = parts[0].union(parts[1]).groupBy("k", "le").agg(F.sum("count").alias("count"))
    assert {(r.k, r.le): r["count"] for r in merged.collect()} == whole

    def plain(k, share):
        ends, counts = [*borders, float("inf")], [whole[k, le] for le in [*borders, float("inf")]]
        i = next(i for i, c in enumerate(counts) if c >= share * counts[-1])
        below, low = (counts[i - 1], ends[i - 1]) if i else (0, 0.0)
        return low if ends[i] == float("inf") else low + (ends[i] - low) * (share * counts[-1] - below) / (counts[i] - below)

    for share in (0.5, 0.95, 0.1, 1.0):
        got = {r.k: r.quantile for r in rates.histogram_quantile(merged, ["k"], share).collect()}
        assert got == pytest.approx({k: plain(k, share) for k in "abc"})
    none = spark.createDataFrame([("x", 1.0, 0), ("x", float("inf"), 0)], "k string, le double, count long")
    assert rates.histogram_quantile(none, ["k"], 0.5).first().quantile is None


def test_a_grid_equals_each_setting_alone(spark):
    rng = random.Random(8)
    g = {"score": [0.2, 0.5, 0.8], "stay": [1.0, 4.0]}
    rows = [(f"c{rng.randrange(3)}", rng.randrange(20), rng.random(), rng.choice([None, rng.uniform(0, 8)])) for _ in range(600)]
    truth = [(f"c{s}", t, rng.choice([None, rng.randrange(8)])) for s in range(4) for t in range(20)]
    counts = grid.grid_counts(spark.createDataFrame(rows, "q string, t_ms long, score double, stay double"), spark.createDataFrame(truth, "q string, t_ms long, truth long"), "q", g)
    want = {}
    for i, s in enumerate(grid.settings_of(g)):
        seen = defaultdict(int)
        for q, t, score, stay in rows:
            seen[q, t] += score >= s["score"] and stay is not None and stay >= s["stay"]
        for q in {q for q, _, x in truth if x is not None}:
            errors = [seen[q, t] - x for k, t, x in truth if k == q and x is not None]
            want[q, i] = (len(errors), sum(map(abs, errors)), sum(abs(e) <= 1 for e in errors), sum(errors))
    assert {(r.q, r.setting): (r.n, r.off, r.within, r.bias) for r in counts.collect()} == want
    results = grid.grid_results(counts, "q", g, 0.2, 3.0).collect()
    by_hand = {}
    for i in range(6):
        own = [want[q, i] for q in {q for q, _ in want}]
        by_hand[i] = (sum(w / n >= 0.2 and o / n <= 3.0 for n, o, w, _ in own), round(sum(w / n for n, _, w, _ in own) / len(own), 4), round(sum(o / n for n, o, _, _ in own) / len(own), 4))
    assert {r.setting: (r.passing, r.mean_within1, r.mean_mae) for r in results} == {i: pytest.approx(v, abs=1.1e-4) for i, v in by_hand.items()}
    best = grid.choose(grid.grid_results(counts, "q", g, 0.2, 3.0)).first().setting
    assert best == min(by_hand, key=lambda i: (-by_hand[i][0], -by_hand[i][1], by_hand[i][2], i))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_percentiles_are_exact(spark, by):
    import numpy as np

    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 5.0, rng.gauss(0, 10)])) for _ in range(401)] + [("lone", 2.5), ("none", None)]
    out = stats.percentiles_cont(spark.createDataFrame(rows, "k string, v double"), by, "v", {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}).collect()
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k if by else 0].append(v)
    assert {(r.k if by else 0): (r.p0, r.p50, r.p90, r.p100) for r in out} == {k: pytest.approx(tuple(np.percentile(v, [0, 50, 90, 100]))) for k, v in groups.items()}
