"""Rule scores against ground truth, gates and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aislewise.functions.scans import Running, scan
from aislewise.functions.shared import stored
from aislewise.functions.stats import error_summary, nearest_rank, precision_recall_f1, wilson

from .assignment import in_order

_GROUP = ["rule_id", "store_id", "key", "cluster"]


def candidates(truth: DataFrame, incidents: DataFrame, before_ms: int, max_latency_ms: int) -> DataFrame:
    """Pairs of ground truth and OPENED incidents of one rule, store and key within the window.

    The time axis is cut into cells of the window's width and each truth row looks into the two or three it can reach,
    so a key with many rows is joined cell by cell.
    """
    cell = before_ms + max_latency_ms + 1
    t = truth.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("at_ms") - before_ms) / cell), F.floor((F.col("at_ms") + max_latency_ms) / cell))))
    i = incidents.where("kind = 'OPENED'").select("rule_id", "store_id", "key", "incident_id", "detected_ms", F.floor(F.col("detected_ms") / cell).alias("_cell"))
    delta = F.col("detected_ms") - F.col("at_ms")
    return t.join(i, ["rule_id", "store_id", "key", "_cell"]).where((delta >= -before_ms) & (delta <= max_latency_ms)).select("rule_id", "store_id", "key", "gt_id", "at_ms", "incident_id", "detected_ms")


def matches(truth: DataFrame, incidents: DataFrame, before_ms: int = 5_000, max_latency_ms: int = 120_000) -> DataFrame:
    """gt_id, incident_id and latency of an optimal one-to-one matching per rule, store and key (M2, M3).

    As many pairs as possible, of those sets one with the least sum of distances. Rows further apart than the window
    can't compete, so a key is divided at such gaps. Inside a cluster the window is the same for all, so an optimal
    matching that keeps the order of both sides exists, and in_order() finds it with memory of rows times partners. Tasks
    stream their clusters, a batch of rows at a time.
    """
    key = ["rule_id", "store_id", "key"]
    rows = truth.select(*key, F.col("at_ms").alias("t"), F.col("gt_id").cast("string").alias("id"), F.lit(0).alias("side"))
    rows = rows.union(incidents.where("kind = 'OPENED'").select(*key, "detected_ms", F.col("incident_id").cast("string"), F.lit(1)))
    w = W.partitionBy(*key).orderBy("t")
    gap = (F.col("t") - F.lag("t").over(w) > before_ms + max_latency_ms).cast("int")
    clusters = rows.withColumn("cluster", F.sum(F.coalesce(gap, F.lit(0))).over(w))

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        """The pairs of whole clusters, which follow each other."""
        t, side, ids = rows["t"].to_numpy(np.int64), rows["side"].to_numpy(), rows["id"].to_numpy()
        starts = np.flatnonzero(_changes(rows))
        truths, incs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            gts, own = a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)
            if len(gts) and len(own):
                i, j = in_order(t[gts], t[own], before_ms, max_latency_ms)
                truths.append(gts[i]), incs.append(own[j])
        i, j = np.concatenate(truths), np.concatenate(incs)
        return pd.DataFrame({"gt_id": ids[i], "incident_id": ids[j], "latency_ms": t[j] - t[i], **{c: rows[c].to_numpy()[i] for c in key}})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last cluster, until its end has come
        for frame in frames:
            ends = np.flatnonzero(_changes(frame))
            same = held and len(frame) and all(_equal(held[-1][c].iloc[-1], frame[c].iloc[0]) for c in _GROUP)
            if not len(ends) or (len(ends) == 1 and same):
                held.append(frame)
                continue
            yield found(pd.concat([*held, frame.iloc[: ends[-1]]]) if held else frame.iloc[: ends[-1]])
            held = [frame.iloc[ends[-1] :]]
        if held:
            yield found(pd.concat(held))

    dealt = clusters.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "t", "id")
    return dealt.mapInPandas(run, "gt_id string, incident_id string, latency_ms long, rule_id string, store_id string, key string")


def _equal(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def _changes(rows: pd.DataFrame) -> np.ndarray:
    """Whether each row begins a cluster, the first row always."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for c in _GROUP:
        v = rows[c].to_numpy()
        out[1:] |= (v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1]))
    return out


def rule_scores(truth: DataFrame, incidents: DataFrame, matched: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, F1, their Wilson intervals and latency percentiles by rule."""
    matched = stored(matched, "matched")
    n_t = truth.groupBy("rule_id").agg(F.count("*").alias("truths"))
    n_i = incidents.where("kind = 'OPENED'").groupBy("rule_id").agg(F.count("*").alias("opened"))
    tp = matched.groupBy("rule_id").agg(F.count("*").alias("tp"), F.max("latency_ms").alias("latency_max"))
    s = n_t.join(n_i, "rule_id", "full_outer").join(tp, "rule_id", "left").na.fill(0, ["truths", "opened", "tp"])
    s = s.withColumns({"fp": F.col("opened") - F.col("tp"), "fn": F.col("truths") - F.col("tp")})
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    (pl, ph), (rl, rh) = wilson(F.col("tp"), F.col("opened")), wilson(F.col("tp"), F.col("truths"))
    s = s.withColumns({"precision": p, "recall": r, "f1": f1, "precision_low": pl, "precision_high": ph, "recall_low": rl, "recall_high": rh})
    pct = nearest_rank(matched, ["rule_id"], "latency_ms", [50, 95]).drop("n")
    return s.join(pct, "rule_id", "left").drop("truths", "opened")


def examples(rows: DataFrame, by: list[str], order: str, value: str, n: int = 3) -> DataFrame:
    """The first n values per group as an array (K4), cut before they are gathered."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(order, value))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("examples"))


def gated(scores: DataFrame, gates: DataFrame, min_n: int = 30, min_low: float = 0.9) -> DataFrame:
    """Scores with failures and warnings (M4).

    scores: scenario, rule_id, precision, recall, their lower bounds and n; gates: scenario (`*`: all), rule_id (`*`:
    all), precision, recall. A rule's own entry in its scenario goes before its scenario's `*`, that before the defaults.
    """
    g = gates.select(F.col("scenario").alias("_s"), F.col("rule_id").alias("_r"), F.col("precision").alias("_p"), F.col("recall").alias("_c"))
    level = F.when(F.col("_s") == "*", 0).otherwise(2) + F.when(F.col("_r") == "*", 0).otherwise(1)
    fits = ((F.col("_s") == F.col("scenario")) | (F.col("_s") == "*")) & ((F.col("_r") == F.col("rule_id")) | (F.col("_r") == "*"))
    best = scores.join(F.broadcast(g), fits).groupBy(*scores.columns).agg(F.max_by(F.struct("_p", "_c"), level).alias("gate"))  # gates: a configuration table
    failures, warnings = [], []
    for metric, gate, n in (("precision", "_p", "n_precision"), ("recall", "_c", "n_recall")):
        limit, low = F.col(f"gate.{gate}"), F.col(f"{metric}_low")
        failures += [F.when(F.col(metric) < limit, f"{metric} under the gate"), F.when((F.col(n) >= min_n) & (low < min_low), f"{metric} lower bound under {min_low}")]
        warnings.append(F.when((F.col(n) > 0) & (F.col(n) < min_n) & (low < limit), f"{metric}: too few samples"))
    text = lambda ms: F.array_join(F.array_compact(F.array(*ms)), "; ")
    return best.withColumns({"failures": text(failures), "warnings": text(warnings)}).drop("gate")


def baseline_diff(baseline: DataFrame, candidate: DataFrame, keys: list[str], metric: str, drop_pp: float = 1.0) -> DataFrame:
    """drop, removed, new or rise of a metric between two tables."""
    b, c = baseline.select(*keys, F.col(metric).alias("before")), candidate.select(*keys, F.col(metric).alias("after"))
    change = (F.col("after") - F.col("before")) * 100
    what = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "new").when(change < -drop_pp, "drop").when(change > drop_pp, "rise")
    return b.join(c, keys, "full_outer").withColumn("change", what).where("change is not null")


def worst_drops(base: DataFrame, noisy: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """Largest precision and recall losses in percentage points per noise profile (A19, R13). noisy: profile and keys."""
    j = noisy.join(base.select(*keys, F.col("precision").alias("_p"), F.col("recall").alias("_r")), keys)
    j = j.withColumns({"precision_drop": (F.col("_p") - F.col("precision")) * 100, "recall_drop": (F.col("_r") - F.col("recall")) * 100})
    order = W.partitionBy("profile").orderBy(F.desc(F.greatest("precision_drop", "recall_drop")), *keys)
    return j.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("profile", *keys, "precision_drop", "recall_drop", "rank")


def counts_at(changes: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """samples (by, t_ms) with the value after every change at or before t; 0 before the first (J6). changes: by, t_ms, seq, value.

    Changes and samples are one order in which the last value runs on over cells, so no key is one task's.
    """
    rows = changes.select(*by, "t_ms", F.lit(0).alias("_kind"), "seq", F.col("value").cast("long")).union(samples.select(*by, "t_ms", F.lit(1), F.lit(0).cast("long"), F.lit(None).cast("long")))
    last = scan(rows, by, ["t_ms", "_kind", "seq"], {"count": Running("value", "last")}).where("_kind = 1")
    return last.select(*by, "t_ms", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def occupancy_changes(moves: DataFrame, by: list[str]) -> DataFrame:
    """Running number of distinct tracks inside, after each move (N5): a second entry of a track inside does not count.

    moves: by, track_id, t_ms, seq, inside (1 entered, 0 exited).
    """
    own = W.partitionBy(*by, "track_id").orderBy("t_ms", "seq")
    step = F.col("inside") - F.coalesce(F.lag("inside").over(own), F.lit(0))
    return scan(moves.withColumn("_d", step), by, ["t_ms", "seq"], {"value": Running("_d")}).select(*by, "t_ms", "seq", "value")


def count_scores(truth: DataFrame, changes: DataFrame, by: list[str], min_within: float = 0.95, max_mae: float = 0.5) -> DataFrame:
    """Counts against truth (by, t_ms, truth) with gate."""
    seen = counts_at(changes, truth.select(*by, "t_ms").distinct(), by)
    s = error_summary(truth.join(seen, [*by, "t_ms"]), by, "truth", "count")
    return s.withColumn("passed", (F.col("within1") >= min_within) & (F.col("mae") <= max_mae))


def occupancy_errors(clean: DataFrame, noisy: DataFrame, by: list[str], seconds: DataFrame, low: int = 2, high: int = 8) -> DataFrame:
    """Noisy less clean count at each second where the clean count is from low to high (M20). seconds: by, t_ms."""
    a = counts_at(clean, seconds, by).withColumnRenamed("count", "clean")
    b = counts_at(noisy, seconds, by).withColumnRenamed("count", "noisy")
    return a.join(b, [*by, "t_ms"]).where(F.col("clean").between(low, high)).select(*by, "t_ms", (F.col("noisy") - F.col("clean")).alias("error"))


def latency_gate(latencies: DataFrame, max_p95_ms: int = 10_000) -> DataFrame:
    """p50, p95, max, measured, unmeasured and passed of processing latencies (M6, A5)."""
    pct = nearest_rank(latencies, [], "latency_ms", [50, 95])
    rest = latencies.agg(F.max("latency_ms").alias("max"), F.count_if(F.col("latency_ms").isNull()).alias("unmeasured"))
    return rest.crossJoin(pct).withColumn("passed", F.col("p95") <= max_p95_ms)  # single rows


def best_setting(results: DataFrame, order: list[Column]) -> DataFrame:
    """The first setting in a lexicographic order of measures."""
    return results.orderBy(*order).limit(1)
