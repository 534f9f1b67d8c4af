"""Rates of counters, ratios of rates and quantiles of histograms over windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aislewise.functions.scans import Running, scan


def increases(samples: DataFrame, by: list[str]) -> DataFrame:
    """Samples (by, t_ms, value) of counters with increase: what each has counted since the sample before it.

    A value under the one before is a counter that began again at 0, and counts as a whole. The first sample of a series
    has no increase; nulls are no samples. The sample before is found over cells, so no series is one task's.
    """
    good = samples.where("value is not null and t_ms is not null")
    before = scan(good, by, ["t_ms", "value"], {"_before": Running("value", "last", exclusive=True)})
    grown = F.when(F.col("value") >= F.col("_before"), F.col("value") - F.col("_before")).otherwise(F.col("value"))
    return before.where("_before is not null").withColumn("increase", grown).drop("_before")


def windowed_rates(increases: DataFrame, by: list[str], window_ms: int) -> DataFrame:
    """by, start_ms, rate: increases a second over tumbling windows, aligned to the epoch; windows without a sample are left out."""
    start = F.col("t_ms") - F.pmod(F.col("t_ms"), F.lit(window_ms))
    return increases.groupBy(*by, start.alias("start_ms")).agg((F.sum("increase") / (window_ms / 1000)).alias("rate"))


def late_ratio(late: DataFrame, received: DataFrame, window_ms: int, least: float = 1.0, most: float = 0.01) -> DataFrame:
    """start_ms, late_rate, received_rate, ratio and alert of counter samples (series, t_ms, value) of both kinds.

    Rates are summed over series; a received rate under `least` a second counts as that, so quiet hours raise no alert.
    """
    one = lambda samples, name: windowed_rates(increases(samples, ["series"]), ["series"], window_ms).groupBy("start_ms").agg(F.sum("rate").alias(name))
    both = one(received, "received_rate").join(one(late, "late_rate"), "start_ms", "full_outer").na.fill(0.0, ["received_rate", "late_rate"])
    ratio = F.col("late_rate") / F.greatest(F.col("received_rate"), F.lit(least))
    return both.select("start_ms", "late_rate", "received_rate", ratio.alias("ratio"), (ratio > most).alias("alert"))


def histogram(values: DataFrame, by: list[str], value: str, borders: list[float]) -> DataFrame:
    """by, le, count: values at or under each fixed border, and under infinity. Histograms of parts add up border by border."""
    ends = [*sorted(borders), float("inf")]
    own = F.when(F.lit(False), F.lit(0.0))
    for end in ends[:-1]:
        own = own.when(F.col(value) <= end, F.lit(end))
    single = values.where(F.col(value).isNotNull()).groupBy(*by, own.otherwise(F.lit(ends[-1])).alias("_le")).agg(F.count("*").alias("_n"))
    return single.select(*by, F.explode(F.array(*map(F.lit, ends))).alias("le"), "_le", "_n").groupBy(*by, "le").agg(F.sum(F.when(F.col("_le") <= F.col("le"), F.col("_n")).otherwise(0)).alias("count"))


def histogram_quantile(buckets: DataFrame, by: list[str], share: float, count: str = "count") -> DataFrame:
    """by, quantile: the value under which `share` of the counts lie, on the line between the borders of its bucket.

    buckets: by, le (upper border, the last infinite), count (of all values up to le). In the infinite bucket the last
    finite border stands for it; without counts the quantile is null. The lowest bucket begins at 0, or at its border if
    that is negative.
    """
    w = W.partitionBy(*by).orderBy("le")  # a row a border
    b = buckets.withColumns({"_low": F.lag("le").over(w), "_below": F.coalesce(F.lag(count).over(w), F.lit(0)), "_all": F.max(count).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    rank = F.col("_all") * F.lit(share)
    low = F.coalesce(F.col("_low"), F.least(F.lit(0.0), F.col("le")))
    inside: Column = low + (F.col("le") - low) * (rank - F.col("_below")) / F.nullif(F.col(count) - F.col("_below"), F.lit(0))
    at = F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(F.coalesce(inside, F.col("le")))
    first = F.when((F.col("_all") > 0) & (F.col(count) >= rank), F.struct("le", at.alias("v")))
    return b.groupBy(*by).agg(F.min(first).alias("_q")).select(*by, F.col("_q.v").alias("quantile"))
