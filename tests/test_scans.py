"""Running values over cells of equal depth against plain loops; hot keys and stray values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from aislewise.functions import scans
from aislewise.functions.scans import Clamped, Running

SCHEMA = "k string, t long, seq long, v long"
VALUES = {
    "sums": Running("v"), "earlier": Running("v", exclusive=True), "most": Running("v", "max"), "most_before": Running("v", "max", exclusive=True), "least_after": Running("v", "min", backward=True),
    "last": Running("v", "last"), "next": Running("v", "last", exclusive=True, backward=True), "inside": Clamped("step"),
}


def random_rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice([None, "hot", "hot", "hot", "b", "c"]), rng.choice([0, 1, 2, 5, 5, 10**15]) if i % 50 == 0 else rng.randrange(1000), i, rng.choice([None, *range(-4, 5)])) for i in range(n)]


def plain(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        v = [r[3] for r in own]
        known = lambda xs: [x for x in xs if x is not None]
        some = lambda f, xs: f(known(xs)) if known(xs) else None
        clamped = 0
        for i, r in enumerate(own):
            clamped = max(0, clamped + (v[i] or 0))
            out[r[2]] = (
                some(sum, v[: i + 1]), some(sum, v[:i]), some(max, v[: i + 1]), some(max, v[:i]), some(min, v[i:]),
                (known(v[: i + 1]) or [None])[-1], (known(v[i + 1 :]) or [None])[0], clamped,
            )
    return out


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 7), (3, 40), (4, 300)])
def test_running_values_equal_plain_loops(spark, seed, n):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("step", F.coalesce("v", F.lit(0)))
    out = scans.scan(df, ["k"], ["t", "seq"], VALUES, n)
    assert out.columns == [*df.columns, *VALUES]
    assert {r.seq: tuple(r[name] for name in VALUES) for r in out.collect()} == plain(rows)


def test_no_key_and_falling_order(spark):
    df = spark.createDataFrame(random_rows(5), SCHEMA)
    out = scans.scan(df.withColumn("one", F.lit(1)), [], [F.desc("t"), F.col("seq")], {"n": Running("one")}, 9)
    ranks = [r.seq for r in out.orderBy("n").collect()]
    assert ranks == [r[2] for r in sorted(random_rows(5), key=lambda r: (-r[1], r[2]))]
    assert scans.scan(df.limit(0), ["k"], ["t"], {"s": Running("v")}).count() == 0


def test_one_key_and_one_stray_value_are_spread(spark):
    """All rows are of one key and one lies in another age: no cell has a hundredth of the rows."""
    df = spark.range(100_000).select(F.lit("one").alias("k"), F.when(F.col("id") == 7, F.lit(253_402_300_799_000)).otherwise(1_700_000_000_000 + F.col("id")).alias("t"), F.lit(1).alias("v"))
    cells = scans.in_cells(df, ["k"], ["t"], 256)
    sizes = [r["count"] for r in cells.groupBy(scans.CELL).count().collect()]
    assert len(sizes) > 200 and max(sizes) < 1000
    got = scans.scan_cells(cells, ["k"], ["t"], {"n": Running("v")})
    assert got.agg(F.max("n"), F.count_distinct("n")).first() == (100_000, 100_000)
    assert got.where(f"n = {100_000}").first().t == 253_402_300_799_000


def test_window_is_by_cell_and_key(spark):
    df = spark.createDataFrame(random_rows(6), SCHEMA)
    plan = scans.scan(df, ["k"], ["t", "seq"], {"s": Running("v")}, 7)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) >= 2 and sum("[_cell" in line for line in windows) >= 2  # rows by cell and key; totals along cells
