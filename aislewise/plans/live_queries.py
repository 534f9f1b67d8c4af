"""Queries over rules that change, workbooks, tables changed by batches, rates and grids of settings, with their SQL."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from aislewise.functions import settings
from aislewise.functions.shared import stored
from aislewise.operators import grid, ingest, rates, reload, rules
from aislewise.plans import proxies as P
from aislewise.plans.event_queries import _UUID, _VALIDATE, _WINDOWS, RULES, envelopes
from aislewise.plans.proxies import table
from aislewise.sources import files, folders, xlsx
from aislewise.streaming import upserts

_MS = "(epoch_us(ts) // 1000)"

# ---- rules that change (W14) --------------------------------------------------------------------------------------


def document(r: rules.Rules) -> str:
    """A rules document of these parameters."""
    span = lambda ms: f"PT{ms / 1000:g}S" if ms % 60_000 else f"PT{ms // 60_000}M"
    params = {
        "R-QUEUE-001": (r.queue, {"threshold": r.threshold, "sustain": span(r.sustain), "hysteresis": r.hysteresis, "clearSustain": span(r.clear_sustain)}),
        "R-DWELL-001": (r.dwell, {"zones": list(r.dwell_zones), "limit": span(r.limit), "sessionTtl": span(r.ttl), "stitch": span(r.stitch)}),
        "R-ABS-001": (r.absence, {"trigger": "R-QUEUE-001", "expect": r.expect, "within": span(r.within)}),
        "R-FOOT-001": (r.footfall, {"zones": list(r.footfall_zones), "window": span(r.window), "history": span(r.window * r.history), "factor": r.factor, "minCount": r.min_count, "countAppeared": r.count_appeared}),
    }
    return json.dumps({"grace": span(r.grace), "rules": [{"id": rule, "version": own.version, "mode": own.mode, "severity": own.severity, "params": p} for rule, (own, p) in params.items()]})


_LATER, _BACK = 1_704_672_000_000, 1_705_708_800_000  # 2024-01-08 and 2024-01-20


def _schedule() -> reload.Schedule:
    """The file; from 2024-01-08 a document with a lower factor and a new major version; a refused one; from 2024-01-20 the file again."""
    schedule = reload.Schedule(document(RULES))
    schedule.publish(document(replace(RULES, factor=1.2, min_count=2, footfall=rules.Rule("R-FOOT-001", "2.0.0", "shadow", "high"))), _LATER)
    schedule.publish(document(replace(RULES, factor=9.0, footfall=rules.Rule("R-FOOT-001", "2.0.0", "shadow", "high"))), _LATER)
    schedule.publish(None, _BACK)
    return schedule


def footfall_reload(spark, d):
    """Spikes while documents replace each other, each window under the document valid at its end."""
    windows = rules.footfall_windows(P.rule_events(spark, d), RULES)
    out = reload.with_incident_ids(reload.footfall_spikes_scheduled(windows, _schedule()))
    return out.select("incident_id", "kind", "key", "onset_ms", "detected_ms", "version", "mode", "severity")


_RELOAD = f"""WITH {_WINDOWS}, d AS (SELECT *, start_ms + 3600000 >= {_LATER} AND start_ms + 3600000 < {_BACK} AS new FROM win),
h AS (SELECT *, count(*) OVER p AS c, coalesce(sum(n) OVER p, 0) AS s FROM d WINDOW p AS (PARTITION BY who, zone_id ORDER BY start_ms ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, c = 12 AND n >= CASE WHEN new THEN 2 ELSE 3 END AND n * 12 > CASE WHEN new THEN 1.2 ELSE 1.5 END * s AS spike FROM h),
l AS (SELECT *, coalesce(lag(spike) OVER (PARTITION BY who, zone_id ORDER BY start_ms), false) AS was FROM k),
o AS (SELECT *, last_value(CASE WHEN spike AND NOT was THEN start_ms END IGNORE NULLS) OVER (PARTITION BY who, zone_id ORDER BY start_ms) AS onset_ms FROM l),
r AS (SELECT *, md5('R-FOOT-001|' || CASE WHEN new THEN '2' ELSE '1' END || '|' || who || '|' || zone_id || '|' || onset_ms) AS m FROM o WHERE spike <> was)
SELECT {_UUID} AS incident_id, CASE WHEN spike THEN 'OPENED' ELSE 'RESOLVED' END AS kind, zone_id AS key, onset_ms, start_ms + 3600000 AS detected_ms,
 CASE WHEN new THEN '2.0.0' ELSE '1.1.0' END AS version, CASE WHEN new THEN 'shadow' ELSE 'enforce' END AS mode, CASE WHEN new THEN 'high' ELSE 'low' END AS severity FROM r"""


def rule_fold_reload(spark, d):
    """All stateful rules by the fold while documents replace each other."""
    before = replace(RULES, stitch=30_000)
    later = replace(before, threshold=4, queue=rules.Rule("R-QUEUE-001", "1.1.0", "shadow", "high"), limit=6 * 3_600_000, dwell=rules.Rule("R-DWELL-001", "1.2.0"))
    published = [(_LATER, document(later)), (_LATER, document(replace(later, threshold=9))), (_BACK, None)]
    return reload.with_incident_ids(reload.fold_incidents_scheduled(P.rule_events(spark, d), document(before), published))


def setting_columns(spark, d):
    """Durations, versions and clamped limits of rows (F17, F18, P12): null where a text is none."""
    e = P.events(spark, d)
    duration = F.concat(F.when(F.col("k") % 3 == 0, "P1DT").otherwise("PT"), F.col("user_id") % 24, F.when(F.col("k") % 7 == 0, "X").otherwise("H"), F.col("k"), F.lit("M"), F.when(F.col("k") % 2 == 0, "1.5S").otherwise(""))
    version = F.concat_ws(".", F.col("user_id"), F.col("k"), F.when(F.col("k") % 5 > 0, F.col("event_id") % 13))
    out = e.select("event_id", settings.duration_ms_of(duration).alias("duration_ms"), settings.version_of(version).alias("v"), settings.limit_of(F.col("k") * 20 - 100).alias("clamped"))
    return out.select("event_id", "duration_ms", "v.major", "v.minor", "v.patch", "clamped")


_SETTINGS = """WITH e AS (SELECT event_id, user_id AS u, (props->>'k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN k % 7 <> 0 THEN (CASE WHEN k % 3 = 0 THEN 86400000 ELSE 0 END + (u % 24) * 3600000 + k * 60000 + CASE WHEN k % 2 = 0 THEN 1500 ELSE 0 END)::BIGINT END AS duration_ms,
 CASE WHEN k % 5 > 0 THEN u::BIGINT END AS major, CASE WHEN k % 5 > 0 THEN k END AS minor, CASE WHEN k % 5 > 0 THEN (event_id % 13)::BIGINT END AS patch, greatest(1, least(1000, k * 20 - 100))::BIGINT AS clamped FROM e"""


# ---- workbooks (S2) -----------------------------------------------------------------------------------------------


def xlsx_scan(spark, d):
    """All parts written as workbooks and scanned: numbers, texts with blanks at their ends, dates.

    A task's rows beyond those of a sheet are in its next sheets, so all sheets are read.
    """
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("Part"), F.concat(F.lit(" "), "p_name", F.lit(" <&>")).alias("Name"), F.col("p_retailprice").alias("Price"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("Day"), (F.col("p_size") > 25).alias("Large"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("Kind"))
    path = P.scratch(spark, "workbooks")
    xlsx.write_xlsx(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "Part"), path, "Parts")
    back = xlsx.read_xlsx(spark, path, rows.columns, "*")
    return back.select(F.col("Part").cast("long").alias("part"), F.col("Name").alias("name"), F.col("Price").cast("double").alias("price"), F.to_date("Day").alias("day"), F.col("Large").cast("boolean").alias("large"), F.col("Kind").alias("kind"))


_XLSX = """SELECT p_partkey AS part, ' ' || p_name || ' <&>' AS name, p_retailprice AS price, DATE '2024-01-01' + p_size AS day, p_size > 25 AS large, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind FROM part"""


# ---- tables changed by batches (D3, D5, D6, S16, S19) -------------------------------------------------------------


def _thirds(rows, order: str):
    """Three batches of all rows."""
    return [rows.where(F.pmod(F.xxhash64(order), F.lit(3)) == k) for k in range(3)]


def incident_batches(spark, d):
    """The incident table after three batches of its log and of reviews; repeats of the second change nothing."""
    e = P.events(spark, d)
    incident = F.concat(F.lit("i"), F.col("user_id") % 997)
    log = e.where("event_type in ('purchase', 'click')").select(incident.alias("incident_id"), F.when(F.col("event_type") == "purchase", "OPENED").otherwise("RESOLVED").alias("kind"), F.col("t_ms").alias("onset_ms"), (F.col("t_ms") + F.col("k")).alias("detected_ms"), "event_id")
    actions = e.where("event_type = 'error'").select(incident.alias("incident_id"), F.col("t_ms").alias("at_ms"), F.when(F.col("k") % 2 == 0, "ACKNOWLEDGED").otherwise("CONFIRMED").alias("status"), "event_id")
    store = upserts.incidents(spark, P.scratch(spark, "incidents"), 16)
    parts = [upserts.incident_changes(a, b) for a, b in zip(_thirds(log, "event_id"), _thirds(actions, "event_id"))]
    for number in (0, 1, 1, 2):
        store.upsert(parts[number], number)
    return upserts.incident_rows(store.read())


_INCIDENTS = f"""WITH e AS (SELECT 'i' || (user_id % 997) AS incident_id, event_type AS ty, {_MS} AS t, (props->>'k')::BIGINT AS k FROM events),
f AS (SELECT incident_id, min(t) FILTER (ty = 'purchase') AS onset_ms, min(t + k) FILTER (ty = 'purchase') AS detected_ms, min(t + k) FILTER (ty = 'click') AS resolved_ms,
 arg_max(CASE WHEN k % 2 = 0 THEN 'ACKNOWLEDGED' ELSE 'CONFIRMED' END, (t, CASE WHEN k % 2 = 0 THEN 'ACKNOWLEDGED' ELSE 'CONFIRMED' END)) FILTER (ty = 'error') AS st, count(*) FILTER (ty = 'error') AS n FROM e GROUP BY 1),
j AS (SELECT *, coalesce(st, 'OPEN') AS s, resolved_ms IS NOT NULL AND coalesce(st, 'OPEN') IN ('OPEN', 'ACKNOWLEDGED') AS r FROM f WHERE detected_ms IS NOT NULL)
SELECT incident_id, onset_ms, detected_ms, resolved_ms, CASE WHEN r THEN 'AUTO_RESOLVED' ELSE s END AS status, n + r::INT AS version FROM j"""


def score_batches(spark, d):
    """First scores of rule and run, and last heartbeats of a task, after three batches each."""
    e = P.events(spark, d).select(F.concat(F.lit("r"), F.col("user_id") % 400).alias("id"), F.col("event_id").alias("at"), F.col("value"))
    out = []
    for name, merge in (("first", upserts.first_rows(["id"], ["at"], ["value"])), ("last", upserts.latest_rows(["id"], ["at"], ["value"]))):
        store = upserts.BucketedTable(spark, P.scratch(spark, f"scores-{name}"), "id string, at long, value double", ["id"], merge, 16)
        out.append(upserts.in_batches(store, _thirds(e, "at")).withColumn("kept", F.lit(name)))
    return out[0].union(out[1])


_BATCHES = """SELECT 'r' || (user_id % 400) AS id, min(event_id) AS at, arg_min(value, event_id) AS value, 'first' AS kept FROM events GROUP BY 1
UNION ALL SELECT 'r' || (user_id % 400), max(event_id), arg_max(value, event_id), 'last' FROM events GROUP BY 1"""
_NOW = 1_705_276_800_000  # 2024-01-15


def outbox_purge(spark, d):
    """An outbox of all events, published in a second batch, less what was published over 72 hours before 2024-01-15."""
    e = P.events(spark, d)
    row = lambda state, tries, at: e.select(F.concat(F.lit("s"), F.col("user_id") % 7).alias("source"), F.col("event_id").alias("sequence"), F.col("event_type").alias("record"), F.lit(state).alias("state"), F.lit(tries).cast("long").alias("tries"), at.cast("long").alias("published_ms"), "k")
    store = upserts.outbox(spark, P.scratch(spark, "outbox"), 16)
    store.upsert(row("pending", 0, F.lit(None)), 0)
    store.upsert(row("published", 1, F.col("t_ms") + F.col("k") * 60_000).where("k % 4 > 0"), 1)
    upserts.purge_published(store, _NOW, 0)
    return store.read()


_PURGE = f"""WITH e AS (SELECT 's' || (user_id % 7) AS source, event_id AS sequence, event_type AS record, (props->>'k')::BIGINT AS k, {_MS} AS t FROM events)
SELECT source, sequence, record, CASE WHEN k % 4 > 0 THEN 'published' ELSE 'pending' END AS state, CASE WHEN k % 4 > 0 THEN 1 ELSE 0 END::BIGINT AS tries, CASE WHEN k % 4 > 0 THEN t + k * 60000 END AS published_ms
FROM e WHERE k % 4 = 0 OR t + k * 60000 >= {_NOW} - 259200000"""


def log_dropped(spark, d):
    """The event log by day after days over ten days before 2024-01-20 were removed."""
    e = P.events(spark, d).select(F.concat(F.lit("s"), F.col("user_id") % 7).alias("store_id"), F.col("event_type").alias("type"), "t_ms", F.col("t_ms").alias("received_ms"), "event_id")
    path = P.scratch(spark, "log")
    files.write_log(e, path)
    folders.drop_expired_days(spark, path, date(2024, 1, 20), 10)
    return spark.read.parquet(path).select("store_id", "type", "t_ms", "event_id", "received_date")


_DROPPED = f"SELECT 's' || (user_id % 7) AS store_id, event_type AS type, {_MS} AS t_ms, event_id, ts::DATE AS received_date FROM events WHERE ts >= TIMESTAMP '2024-01-10'"


# ---- dead letters and drop folders (S18, S5) ----------------------------------------------------------------------


def dead_letters(spark, d):
    """Invalid and conflicting envelopes: every seventh is sent again with another length, every eleventh unchanged."""
    e = envelopes(spark, d).drop("t_ms")
    again = e.where(F.col("arrival") % 7 == 0).withColumns({"data": F.replace("data", F.lit('"openRegisters":1'), F.lit('"openRegisters":2')), "arrival": F.col("arrival") + 10_000_000})
    same = e.where(F.col("arrival") % 11 == 0).withColumn("arrival", F.col("arrival") + 20_000_000)
    hashed = ingest.hashed(ingest.validate(e.union(again).union(same), F.lit(1_706_745_600_000).cast("long")))
    once = stored(hashed.select("source", "id", "arrival", "payload_hash", "errors"), "hashed")  # the first of each id and all copies come from here
    return ingest.dead_letters(ingest.dedup(once), 60).select("id", "arrival", "reason", "errors")


_LETTERS = f"""WITH v AS ({_VALIDATE}), e AS (SELECT id, id::BIGINT AS arrival, false AS other, errors FROM v
 UNION ALL SELECT id, id::BIGINT + 10000000, id::BIGINT % 19 <> 0, errors FROM v WHERE id::BIGINT % 7 = 0 UNION ALL SELECT id, id::BIGINT + 20000000, false, errors FROM v WHERE id::BIGINT % 11 = 0)
SELECT id, arrival, CASE WHEN errors <> '' THEN 'INVALID' ELSE 'CONFLICT' END AS reason, left(errors, 60) AS errors FROM e WHERE errors <> '' OR other"""


def drop_folder(spark, d):
    """Events dropped as files by type: those that match and have settled are taken, read and moved; files of a bad row are set aside."""
    e = P.events(spark, d).select("event_id", "event_type", "k", F.col("event_type").alias("part"))
    inbox, work, done, failed = (P.scratch(spark, f"drop-{n}") for n in ("in", "work", "done", "failed"))
    staged = P.scratch(spark, "drop-staged")
    e.repartition("part").write.partitionBy("part").json(staged)
    for part in (f for f in folders.children(spark, staged) if f.startswith("part=")):
        for name in (f for f in folders.children(spark, f"{staged}/{part}") if f.endswith(".json")):
            folders.move(spark, f"{staged}/{part}/{name}", f"{inbox}/{part.partition('=')[2]}-{name}")
    taken = files.take_settled(spark, inbox, "[a-p]*.json", work, min_age_s=0)  # click, error, purchase
    rows = spark.read.schema("event_id long, event_type string, k long").json(work).withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    good, bad = files.finish_files(spark, taken, rows.where("event_type = 'error'").select("_file"), done, failed)
    moved = lambda folder, state: spark.read.schema("event_id long, event_type string, k long").json(folder).withColumn("state", F.lit(state))
    return moved(done, "done").union(moved(failed, "failed")) if good and bad else moved(done if good else failed, "done" if good else "failed")


_FOLDER = "SELECT event_id, event_type, (props->>'k')::BIGINT AS k, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS state FROM events WHERE event_type IN ('click', 'error', 'purchase')"


# ---- rates (A23) --------------------------------------------------------------------------------------------------


def late_ratios(spark, d):
    """Late and received counters of each source, which start again now and then, as ratios over hours."""
    e = P.events(spark, d).select(F.concat(F.lit("s"), F.col("user_id") % 8).alias("series"), "t_ms", (F.col("event_id") % 1700).alias("value"))
    out = rates.late_ratio(e.withColumn("value", F.floor(F.col("value") / 40)), e, 3_600_000, least=0.01, most=0.024)
    return out.withColumns({c: F.round(c, 9) for c in ("late_rate", "received_rate", "ratio")})


_RATIOS = f"""WITH e AS (SELECT 's' || (user_id % 8) AS series, {_MS} AS t, event_id % 1700 AS v FROM events),
i AS (SELECT t, CASE WHEN v >= b THEN v - b ELSE v END AS inc, CASE WHEN v // 40 >= c THEN v // 40 - c ELSE v // 40 END AS linc
 FROM (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY t, v) AS b, lag(v // 40) OVER (PARTITION BY series ORDER BY t, v // 40) AS c FROM e) WHERE b IS NOT NULL),
w AS (SELECT t - t % 3600000 AS start_ms, sum(linc) / 3600.0 AS l, sum(inc) / 3600.0 AS r FROM i GROUP BY 1)
SELECT start_ms, round(l, 9) AS late_rate, round(r, 9) AS received_rate, round(l / greatest(r, 0.01), 9) AS ratio, l / greatest(r, 0.01) > 0.024 AS alert FROM w"""
_BORDERS = [5.0, 10.0, 25.0, 50.0, 75.0]


def latency_quantiles(spark, d):
    """The 95th and 50th percentile of values by hour and type, from histograms of fixed borders."""
    e = P.events(spark, d).withColumn("start_ms", F.col("t_ms") - F.col("t_ms") % 3_600_000)
    by = ["event_type", "start_ms"]
    buckets = rates.histogram(e, by, "value", _BORDERS)
    out = rates.histogram_quantile(buckets, by, 0.95).withColumnRenamed("quantile", "p95").join(rates.histogram_quantile(buckets, by, 0.5).withColumnRenamed("quantile", "p50"), by)
    return out.withColumns({c: F.round(c, 9) for c in ("p95", "p50")})


def _quantile(share: float) -> str:
    return f"min(CASE WHEN c >= {share} * a THEN struct_pack(le := le, v := CASE WHEN le = 'inf'::DOUBLE THEN lo ELSE lo + (le - lo) * ({share} * a - b) / (c - b) END) END).v"


_QUANTILES = f"""WITH e AS (SELECT event_type, {_MS} - {_MS} % 3600000 AS start_ms, value FROM events), l AS (SELECT unnest([{', '.join(map(str, _BORDERS))}, 'inf'::DOUBLE]) AS le),
h AS (SELECT event_type, start_ms, le, count(*) FILTER (value <= le) AS c, count(*) AS a FROM e, l GROUP BY 1, 2, 3),
p AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(c) OVER w, 0) AS b FROM h WINDOW w AS (PARTITION BY event_type, start_ms ORDER BY le))
SELECT event_type, start_ms, round({_quantile(0.95)}, 9) AS p95, round({_quantile(0.5)}, 9) AS p50 FROM p GROUP BY 1, 2"""


# ---- grids of settings (M16) --------------------------------------------------------------------------------------

_GRID = {"value": [5.0, 10.0, 20.0, 30.0, 50.0], "k": [0.0, 20.0, 40.0, 60.0]}


def _grid_counts(spark, d):
    e = P.events(spark, d).select(F.concat(F.lit("c"), F.col("user_id") % 5).alias("sequence"), (F.floor(F.col("t_ms") / 14_400_000) * 14_400_000).alias("t_ms"), "value", "k", "event_id")
    truth = e.groupBy("sequence", "t_ms").agg(F.count_if((F.col("value") >= 18) & (F.col("k") >= 45)).alias("truth"))
    return grid.grid_counts(e, truth, "sequence", _GRID)


def grid_settings(spark, d):
    """Every setting of a grid of thresholds against counted truth, in one pass over the rows."""
    return grid.grid_results(_grid_counts(spark, d), "sequence", _GRID, 0.9, 1.0)


def grid_choice(spark, d):
    return grid.choose(grid_settings(spark, d))


_SETTING_ROWS = f"""e AS (SELECT 'c' || (user_id % 5) AS q, {_MS} // 14400000 AS t, value, (props->>'k')::BIGINT AS k FROM events),
g AS (SELECT (i * 4 + j)::INT AS setting, [5.0, 10.0, 20.0, 30.0, 50.0][i + 1]::DOUBLE AS gv, [0.0, 20.0, 40.0, 60.0][j + 1]::DOUBLE AS gk FROM range(5) a(i), range(4) b(j)),
c AS (SELECT setting, any_value(gv) AS gv, any_value(gk) AS gk, q, t, count(*) FILTER (value >= gv AND k >= gk) - count(*) FILTER (value >= 18 AND k >= 45) AS x FROM e, g GROUP BY setting, q, t),
o AS (SELECT setting, any_value(gv) AS gv, any_value(gk) AS gk, q, avg((abs(x) <= 1)::INT) AS w, avg(abs(x)) AS m FROM c GROUP BY setting, q),
r AS (SELECT setting, any_value(gv) AS value, any_value(gk) AS k, count(*) FILTER (w >= 0.9 AND m <= 1.0) AS passing, round(avg(w), 4) AS mean_within1, round(avg(m), 4) AS mean_mae FROM o GROUP BY setting)"""

QUERIES = {f.__name__: f for f in (footfall_reload, rule_fold_reload, setting_columns, xlsx_scan, incident_batches, score_batches, outbox_purge, log_dropped, dead_letters, drop_folder, late_ratios, latency_quantiles, grid_settings, grid_choice)}
SQL = {
    "footfall_reload": _RELOAD, "setting_columns": _SETTINGS, "xlsx_scan": _XLSX, "incident_batches": _INCIDENTS, "score_batches": _BATCHES, "outbox_purge": _PURGE, "log_dropped": _DROPPED,
    "dead_letters": _LETTERS, "drop_folder": _FOLDER, "late_ratios": _RATIOS, "latency_quantiles": _QUANTILES, "grid_settings": f"WITH {_SETTING_ROWS} SELECT * FROM r",
    "grid_choice": f"WITH {_SETTING_ROWS} SELECT * FROM r ORDER BY passing DESC, mean_within1 DESC, mean_mae, setting LIMIT 1",
}
