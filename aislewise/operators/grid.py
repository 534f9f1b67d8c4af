"""A grid of settings scored in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WITHIN, MAX_MAE = 0.95, 0.5


def settings_of(grid: dict[str, list[float]]) -> list[dict[str, float]]:
    """All settings of a grid in order; the last measure changes first."""
    return [dict(zip(grid, s)) for s in product(*[sorted(g) for g in grid.values()])]


def grid_counts(rows: DataFrame, truth: DataFrame, by: str, grid: dict[str, list[float]]) -> DataFrame:
    """by, setting, n, off, within, bias: how far each setting's counts lie from the truth, as sums over moments.

    rows: by, t_ms and a column for each measure of the grid; a row counts under a setting if each measure reaches its
    threshold. truth: by, t_ms, truth. A row adds one to the cell of the highest thresholds it reaches, and sums over
    the cells from the top give every setting's count at once: a row costs the same whatever the number of settings. A
    task adds up its moments and gives one row a sequence and setting.
    """
    sizes = [len(g) for g in grid.values()]
    cell = F.lit(0)
    reached = F.lit(True)
    for (measure, g), size in zip(grid.items(), sizes):
        place = sum((F.coalesce((F.col(measure) >= t).cast("int"), F.lit(0)) for t in sorted(g)), F.lit(0)) - 1
        cell, reached = cell * size + place, reached & (place >= 0)
    own = rows.where(reached).groupBy(by, "t_ms", cell.cast("int").alias("cell")).agg(F.count("*").alias("n"))
    own = own.groupBy(by, "t_ms").agg(F.collect_list(F.struct("cell", "n")).alias("own"))  # at most an entry a setting
    moments = truth.select(by, "t_ms", F.col("truth").cast("long").alias("truth")).join(own, [by, "t_ms"], "left").select(F.col(by).cast("string").alias("key"), "truth", "own")
    total = int(np.prod(sizes))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for key, true, entries in zip(frame["key"], frame["truth"], frame["own"]):
                table = np.zeros(total, np.int64)
                for e in entries if entries is not None else ():
                    table[e["cell"]] += e["n"]
                table = table.reshape(sizes)
                for axis in range(len(sizes)):
                    table = np.flip(np.flip(table, axis).cumsum(axis), axis)
                error = table.ravel() - true
                at = sums.setdefault(key, np.zeros((4, total), np.int64))
                at += np.stack([np.ones(total, np.int64), np.abs(error), np.abs(error) <= 1, error])
        for key, (n, off, within, bias) in sums.items():
            yield pd.DataFrame({"key": key, "setting": np.arange(total, dtype=np.int32), "n": n, "off": off, "within": within, "bias": bias})

    parts = moments.where("truth is not null").mapInPandas(run, "key string, setting int, n long, off long, within long, bias long")
    return parts.groupBy("key", "setting").agg(*[F.sum(c).alias(c) for c in ("n", "off", "within", "bias")]).withColumnRenamed("key", by)


def grid_results(counts: DataFrame, by: str, grid: dict[str, list[float]], min_within: float = MIN_WITHIN, max_mae: float = MAX_MAE) -> DataFrame:
    """setting, its thresholds, passing sequences, mean share within 1 and mean absolute error over sequences."""
    one = counts.withColumns({"w": F.col("within") / F.col("n"), "e": F.col("off") / F.col("n")})
    passed = (F.col("w") >= min_within) & (F.col("e") <= max_mae)
    named = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in s.items()]) for s in settings_of(grid)])
    out = one.groupBy("setting").agg(F.count_if(passed).alias("passing"), F.round(F.avg("w"), 4).alias("mean_within1"), F.round(F.avg("e"), 4).alias("mean_mae"))
    return out.withColumn("_s", F.get(named, F.col("setting"))).select("setting", *[F.col(f"_s.{k}").alias(k) for k in grid], "passing", "mean_within1", "mean_mae")


def choose(results: DataFrame) -> DataFrame:
    """The setting with most passing sequences, then the largest share within 1, the least error, and the first of the grid (K5)."""
    return results.orderBy(F.desc("passing"), F.desc("mean_within1"), "mean_mae", "setting").limit(1)
