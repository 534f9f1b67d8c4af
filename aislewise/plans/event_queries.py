"""Queries over events: rules, traffic, incidents, reviews, scores and ingest, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aislewise.functions import buckets as B
from aislewise.functions import money, stats
from aislewise.functions.shared import stored
from aislewise.operators import billing, fold, incidents, ingest, rules, scoring, traffic
from aislewise.plans import proxies as P
from aislewise.plans.proxies import ZONE, table

FROM, TO = datetime(2024, 1, 3), datetime(2024, 1, 6)
_F, _T = "epoch_ms(TIMESTAMP '2024-01-03')", "epoch_ms(TIMESTAMP '2024-01-06')"
HOUR = 3_600_000
#: Rules whose times fit the sparse events of the driver's tables.
RULES = rules.Rules(grace=10 * 60_000, threshold=6, sustain=20 * 60_000, hysteresis=2, clear_sustain=10 * 60_000, dwell_zones=("z0", "z1"), limit=12 * HOUR, ttl=48 * HOUR, stitch=0, within=HOUR, footfall_zones=("z0", "z1", "z2"), window=HOUR, history=12, factor=1.5, min_count=3)
_EV = """e AS (SELECT event_id AS id, (epoch_us(ts) // 1000) AS t, user_id AS u, 's' || (user_id % 4) || '|' || CASE WHEN user_id % 5 = 0 THEN 'run-1' ELSE 'null' END AS who, event_type AS ty, value, ((epoch_us(ts) // 1000) + CASE WHEN event_id % 11 = 0 THEN (event_id * 7919 % 40) * 60000 ELSE 0 END) * 100000 + event_id AS arr FROM events),
late AS (SELECT *, coalesce(t <= max(t) OVER (PARTITION BY who ORDER BY arr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000, false) AS late FROM e),
rel AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY who) - 600000 AS wm FROM late WHERE NOT late) WHERE t <= wm)"""


# ---- rules --------------------------------------------------------------------------------------------------------


def late_split(spark, d):
    return rules.late_split(P.rule_events(spark, d), RULES.grace).select("id", "t_ms", "late")


def _short(df):
    return df.select("incident_id", "kind", "key", "subject", "onset_ms", "detected_ms")


def rule_queue_islands(spark, d):
    return _short(rules.queue_alerts(P.rule_events(spark, d), RULES))


_UUID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || substr('89ab', ('0x' || substr(m, 17, 1))::INT % 4 + 1, 1) || substr(m, 18, 3) || '-' || substr(m, 21, 12)"


def _with_id(rule: str, rows: str, subject: str) -> str:
    return f"SELECT {_UUID} AS incident_id, kind, key, {subject} AS subject, onset_ms, detected_ms FROM (SELECT *, md5('{rule}|1|' || who || '|' || key || '|' || onset_ms) AS m FROM ({rows}))"


def _island_sql(name: str, holds: str) -> str:
    return f"""{name}0 AS (SELECT *, {holds} AS p, lead(t) OVER w AS nx, row_number() OVER w AS rn FROM q WINDOW w AS (PARTITION BY who, k ORDER BY t, id)),
{name}1 AS (SELECT *, sum(CASE WHEN p AND NOT coalesce(lp, false) THEN 1 ELSE 0 END) OVER (PARTITION BY who, k ORDER BY rn) AS g FROM (SELECT *, lag(p) OVER (PARTITION BY who, k ORDER BY rn) AS lp FROM {name}0)),
{name} AS (SELECT who, k, g, min(t) AS st, arg_max(coalesce(nx, -1), rn) AS nx, max(wm) AS wm FROM {name}1 WHERE p GROUP BY who, k, g)"""


_QUEUE_ROWS = f"""q AS (SELECT who, 'q' || (u % 16) AS k, t, id, floor(value / 10)::INT AS len, wm FROM rel WHERE ty = 'purchase'),
{_island_sql('hi', 'len >= 6')}, {_island_sql('lo', 'len <= 4')},
c AS (SELECT who, k, 'OPENED' AS kind, st, st + 1200000 AS at_ms FROM hi WHERE CASE WHEN nx >= 0 THEN st + 1200000 < nx ELSE st + 1200000 <= wm END
 UNION ALL SELECT who, k, 'RESOLVED', st, st + 600000 FROM lo WHERE CASE WHEN nx >= 0 THEN st + 600000 < nx ELSE st + 600000 <= wm END),
s AS (SELECT * FROM c QUALIFY kind <> coalesce(lag(kind) OVER (PARTITION BY who, k ORDER BY at_ms, kind DESC), 'RESOLVED')),
o AS (SELECT who, kind, k AS key, at_ms AS detected_ms, last_value(CASE WHEN kind = 'OPENED' THEN st END IGNORE NULLS) OVER (PARTITION BY who, k ORDER BY at_ms, kind DESC) AS onset_ms FROM s)"""
_QUEUE = f"WITH {_EV}, {_QUEUE_ROWS}\n" + _with_id("R-QUEUE-001", "SELECT * FROM o", "'queue:' || key")


def rule_dwell(spark, d):
    return _short(rules.dwell_alerts(P.rule_events(spark, d), RULES))


_DWELL = f"""WITH {_EV}, z AS (SELECT *, lead(t) OVER (PARTITION BY u ORDER BY t, lpad(id::VARCHAR, 12, '0')) AS nx FROM rel WHERE ty IN ('view', 'click') AND u % 3 IN (0, 1)),
o AS (SELECT who, 'trk-' || u || '|z' || (u % 3) AS key, t AS onset_ms, t + 43200000 AS op, CASE WHEN (nx IS NULL AND t + 172800000 <= wm) OR t + 172800000 < nx THEN t + 172800000 ELSE nx END AS en FROM z WHERE ty = 'view' AND CASE WHEN nx IS NULL THEN t + 43200000 <= wm ELSE t + 43200000 < nx END)
""" + _with_id("R-DWELL-001", "SELECT who, 'OPENED' AS kind, key, onset_ms, op AS detected_ms FROM o UNION ALL SELECT who, 'RESOLVED', key, onset_ms, en FROM o WHERE en IS NOT NULL", "'zone:' || split_part(key, '|', 2)")


def rule_footfall_spike(spark, d):
    return _short(rules.footfall_spikes(rules.footfall_windows(P.rule_events(spark, d), RULES), RULES))


def footfall_windows(spark, d):
    return rules.footfall_windows(P.rule_events(spark, d), RULES).select("start_ms", "zone_id", "n")


_WINDOWS = f"""{_EV}, w AS (SELECT *, t - t % 3600000 AS st, max(t) OVER (PARTITION BY who) AS top, greatest(t, coalesce(max(t) OVER (PARTITION BY who ORDER BY arr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t)) AS seen FROM e),
win AS (SELECT who, st AS start_ms, zone_id, count(*) FILTER (ty = 'view' AND 'z' || (u % 3) = zone_id) AS n FROM (SELECT * FROM w WHERE st + 4200000 > seen), (VALUES ('z0'), ('z1'), ('z2')) v(zone_id)
 WHERE st + 4200000 <= top GROUP BY 1, 2, 3)"""
_FOOT = f"""WITH {_WINDOWS}, h AS (SELECT *, count(*) OVER p AS c, coalesce(sum(n) OVER p, 0) AS s FROM win WINDOW p AS (PARTITION BY who, zone_id ORDER BY start_ms ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, c = 12 AND n >= 3 AND n * 12 > 1.5 * s AS spike FROM h), l AS (SELECT *, coalesce(lag(spike) OVER (PARTITION BY who, zone_id ORDER BY start_ms), false) AS was FROM k),
o AS (SELECT *, last_value(CASE WHEN spike AND NOT was THEN start_ms END IGNORE NULLS) OVER (PARTITION BY who, zone_id ORDER BY start_ms) AS onset_ms FROM l)
""" + _with_id("R-FOOT-001", "SELECT who, CASE WHEN spike THEN 'OPENED' ELSE 'RESOLVED' END AS kind, zone_id AS key, onset_ms, start_ms + 3600000 AS detected_ms FROM o WHERE spike <> was", "'zone:' || key")


def rule_fold(spark, d):
    """All stateful rules by the fold: queues share the store's absence slot, visits stitch."""
    from dataclasses import replace

    return fold.fold_incidents(P.rule_events(spark, d), replace(RULES, stitch=30_000))


#: Absence: what a store sees in order (register events before deadlines of an instant; queues that calm before queues that
#: grow long), walked row by row. Slot: queue, onset and whether it was reported; a row may report it and may end it.
_ABSENCE = f"""it AS (SELECT row_number() OVER (PARTITION BY who ORDER BY t, place, key) AS n, * FROM (SELECT who, t, 0 AS place, '' AS key FROM rel WHERE ty = 'signup' UNION ALL SELECT who, detected_ms, CASE kind WHEN 'RESOLVED' THEN 1 ELSE 2 END, key FROM o)),
sl AS (SELECT DISTINCT who, 0::BIGINT AS n, NULL::VARCHAR AS q, NULL::BIGINT AS onset, false AS rep, NULL::VARCHAR AS oq, NULL::BIGINT AS oo, NULL::VARCHAR AS rq, NULL::BIGINT AS ro, NULL::BIGINT AS rt FROM it
 UNION ALL SELECT who, n, CASE WHEN ends THEN NULL WHEN starts THEN key ELSE q END, CASE WHEN ends THEN NULL WHEN starts THEN t ELSE onset END, NOT ends AND NOT starts AND seen,
  CASE WHEN seen AND NOT rep THEN q END, CASE WHEN seen AND NOT rep THEN onset END, CASE WHEN ends AND seen THEN q END, CASE WHEN ends AND seen THEN onset END, CASE WHEN ends AND seen THEN t END
 FROM (SELECT it.who, it.n, t, it.key, q, onset, rep, q IS NOT NULL AND (rep OR onset + 3600000 < t) AS seen, q IS NOT NULL AND (place = 0 OR (place = 1 AND it.key = q)) AS ends, q IS NULL AND place = 2 AS starts FROM sl JOIN it ON it.who = sl.who AND it.n = sl.n + 1)),
la AS (SELECT who, max(n) AS n FROM sl GROUP BY 1), wms AS (SELECT who, max(wm) AS wm FROM rel GROUP BY 1),
ab AS (SELECT who, 'OPENED' AS kind, oq AS key, oo AS onset_ms, oo + 3600000 AS detected_ms FROM sl WHERE oq IS NOT NULL UNION ALL SELECT who, 'RESOLVED', rq, ro, rt FROM sl WHERE rq IS NOT NULL
 UNION ALL SELECT who, 'OPENED', q, onset, onset + 3600000 FROM sl JOIN la USING (who, n) JOIN wms USING (who) WHERE q IS NOT NULL AND NOT rep AND onset + 3600000 <= wm)"""
#: Dwell as in rule_dwell, but a late exit ends a visit that is not reported when it arrives.
_REPAIRED = """le AS (SELECT u, t, w FROM (SELECT *, max(t) OVER (PARTITION BY who ORDER BY arr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000 AS w FROM e) WHERE t <= w AND ty = 'click' AND u % 3 IN (0, 1)),
z AS (SELECT *, lead(t) OVER (PARTITION BY u ORDER BY t, lpad(id::VARCHAR, 12, '0')) AS nx FROM rel WHERE ty IN ('view', 'click') AND u % 3 IN (0, 1)),
v AS (SELECT z.* FROM z WHERE ty = 'view' AND NOT EXISTS (SELECT 1 FROM le WHERE le.u = z.u AND le.t >= z.t AND le.w >= z.t AND le.w < z.t + 43200000 AND (z.nx IS NULL OR le.w < z.nx))),
dw AS (SELECT who, 'trk-' || u || '|z' || (u % 3) AS key, t AS onset_ms, t + 43200000 AS op, CASE WHEN (nx IS NULL AND t + 172800000 <= wm) OR t + 172800000 < nx THEN t + 172800000 ELSE nx END AS en FROM v WHERE CASE WHEN nx IS NULL THEN t + 43200000 <= wm ELSE t + 43200000 < nx END)"""
_FOLD = f"""WITH RECURSIVE {_EV}, {_QUEUE_ROWS}, {_ABSENCE}, {_REPAIRED}
SELECT rule, kind, split_part(who, '|', 1) AS store_id, nullif(split_part(who, '|', 2), 'null') AS run_id, key, onset_ms, detected_ms FROM (SELECT who, 'R-QUEUE-001' AS rule, kind, key, onset_ms, detected_ms FROM o UNION ALL SELECT who, 'R-ABS-001', kind, key, onset_ms, detected_ms FROM ab
 UNION ALL SELECT who, 'R-DWELL-001', 'OPENED', key, onset_ms, op FROM dw UNION ALL SELECT who, 'R-DWELL-001', 'RESOLVED', key, onset_ms, en FROM dw WHERE en IS NOT NULL)"""


def incident_upsert(spark, d):
    actions = P.events(spark, d).where("event_type = 'error'").select(F.col("event_id"), F.col("t_ms").alias("at_ms"), F.when(F.col("k") % 2 == 0, "ACKNOWLEDGED").otherwise("CONFIRMED").alias("status"))
    log = stored(rules.queue_alerts(P.rule_events(spark, d), RULES), "alerts")
    ids = log.select("incident_id", "onset_ms").distinct()
    first = ids.groupBy((F.col("onset_ms") % 1000).alias("turn")).agg(F.min("incident_id").alias("incident_id"))  # an action is of one incident
    touched = first.join(actions, F.col("turn") == F.col("event_id") % 1000).select("incident_id", "at_ms", "status")
    return incidents.incident_table(log, touched)


_UPSERT = f"""WITH log AS ({_QUEUE}), act AS (SELECT i.incident_id, (epoch_us(ts) // 1000) AS at_ms, CASE WHEN (props->>'k')::INT % 2 = 0 THEN 'ACKNOWLEDGED' ELSE 'CONFIRMED' END AS status
 FROM (SELECT onset_ms % 1000 AS turn, min(incident_id) AS incident_id FROM log GROUP BY 1) i JOIN events ON i.turn = event_id % 1000 WHERE event_type = 'error'),
f AS (SELECT incident_id, min(onset_ms) FILTER (kind = 'OPENED') AS onset_ms, min(detected_ms) FILTER (kind = 'OPENED') AS detected_ms, min(detected_ms) FILTER (kind = 'RESOLVED') AS resolved_ms FROM log GROUP BY 1),
a AS (SELECT incident_id, arg_max(status, (at_ms, status)) AS st, count(*) AS n FROM act GROUP BY 1),
j AS (SELECT f.*, coalesce(st, 'OPEN') AS s, coalesce(n, 0) AS n FROM f LEFT JOIN a USING (incident_id) WHERE detected_ms IS NOT NULL)
SELECT incident_id, onset_ms, detected_ms, resolved_ms, CASE WHEN resolved_ms IS NOT NULL AND s IN ('OPEN', 'ACKNOWLEDGED') THEN 'AUTO_RESOLVED' ELSE s END AS status,
 n + CASE WHEN resolved_ms IS NOT NULL AND s IN ('OPEN', 'ACKNOWLEDGED') THEN 1 ELSE 0 END AS version FROM j"""


# ---- traffic ------------------------------------------------------------------------------------------------------


def _bins(spark, bucket="hour"):
    return B.covering_bins(spark, FROM, TO, ZONE, bucket)


def traffic_bins(spark, d):
    entries = P.events(spark, d).where("event_type = 'view'").select("t_ms", F.when(F.col("k") % 5 == 0, "appeared").otherwise("crossed").alias("how"))
    return traffic.visitors(entries, _bins(spark), FROM, TO, ZONE, "hour")


_BINS = "bins AS (SELECT b AS bin_start, epoch_ms(b - INTERVAL 330 MINUTE) AS b0, epoch_ms(b + INTERVAL 30 MINUTE - INTERVAL 300 MINUTE) AS b1 FROM generate_series(TIMESTAMP '2024-01-03 05:00:00', TIMESTAMP '2024-01-06 05:00:00', INTERVAL 1 HOUR) g(b))"
_VISITS = f"""v AS (SELECT date_trunc('hour', ts + INTERVAL 330 MINUTE) AS bin_start, count(*) AS n FROM events WHERE event_type = 'view' AND (props->>'k')::INT % 5 <> 0 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06' GROUP BY 1)"""


def _steps(spark, d):
    e = P.events(spark, d)
    return e.select(F.concat(F.lit("q"), F.col("user_id") % 8).alias("key"), "t_ms", F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("value"))


def queue_time_weighted(spark, d):
    return traffic.step_stats(_steps(spark, d), _bins(spark), FROM, TO)


_STEPS = f"""s AS (SELECT 'q' || (user_id % 8) AS key, (epoch_us(ts) // 1000) AS t, event_id AS seq, floor(value)::BIGINT AS v FROM events),
own AS (SELECT key, {_F} AS t, -1 AS seq, arg_max(v, (t, seq)) AS v FROM s WHERE t < {_F} AND t >= {_F} - 43200000 GROUP BY 1 UNION ALL SELECT * FROM s WHERE t >= {_F} AND t < {_T}),
sp AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY key ORDER BY t, seq), {_T}) AS u FROM own),
pc AS (SELECT key, bin_start, v, least(u, b1, {_T}) - greatest(t, b0, {_F}) AS ms FROM sp JOIN bins ON t < b1 AND u > b0 WHERE u > t),
st AS (SELECT key, bin_start, sum(v * ms)::DOUBLE / sum(ms)::DOUBLE AS mean, max(v) AS peak FROM pc WHERE ms > 0 GROUP BY 1, 2),
qs AS (SELECT key, bin_start, floor(mean * 100 + 0.5) / 100 AS mean, peak FROM (SELECT k.key, bins.bin_start FROM (SELECT DISTINCT key FROM own) k CROSS JOIN bins) g LEFT JOIN st USING (key, bin_start))"""


def joined_buckets(spark, d):
    sales = P.events(spark, d).where((F.col("event_type") == "purchase") & billing.in_window(FROM, TO)).groupBy(B.local_bin(B.from_ms(F.col("t_ms")), ZONE, "hour").alias("bucket_start")).agg(F.count("*").alias("bills"), F.sum(P.minor("value")).alias("sales_minor"))
    return traffic.joined_buckets(traffic_bins(spark, d), queue_time_weighted(spark, d), sales).withColumn("queue_mean", F.round("queue_mean", 6))


def asof_carry(spark, d):
    """The last value of each key before the window."""
    return traffic.carried_in(_steps(spark, d), FROM, 43_200_000)


def floor_state(spark, d):
    e = P.rule_events(spark, d).withColumn("run_id", F.when(F.col("arrival") % 3 == 0, F.lit("run-1"))).withColumn("store_id", F.concat(F.lit("s"), F.substring("zone_id", 2, 1)))
    return traffic.floor_state(e.withColumns({"queue_id": F.when(F.col("type").endswith("queue.length"), F.col("queue_id")), "zone_id": F.when(F.col("type").rlike(r"zone\."), F.col("zone_id"))}))


_FLOOR = f"""WITH {_EV.split(',' + chr(10) + 'late')[0]}, x AS (SELECT *, 's' || (u % 3) AS store_id, CASE WHEN arr % 3 = 0 THEN 'run-1' END AS run FROM e),
l AS (SELECT store_id, arg_max_null(run, arr) AS r FROM x GROUP BY 1), o AS (SELECT x.* FROM x JOIN l USING (store_id) WHERE x.run IS NOT DISTINCT FROM l.r)
SELECT store_id, 'zone' AS kind, 'z' || (u % 3) AS id, greatest(0, sum(CASE ty WHEN 'view' THEN 1 ELSE -1 END))::BIGINT AS value FROM o WHERE ty IN ('view', 'click') GROUP BY 1, 2, 3
UNION ALL SELECT store_id, 'queue', 'q' || (u % 16), arg_max(floor(value / 10)::INT, (t, arr))::BIGINT FROM o WHERE ty = 'purchase' GROUP BY 1, 2, 3"""


def clamped_occupancy(spark, d):
    """Occupancy when each exit of an empty place is ignored, per user."""
    e = P.events(spark, d).where("event_type in ('view', 'click')").withColumn("sign", F.when(F.col("event_type") == "view", 1).otherwise(-1))
    return traffic.clamped_occupancy(e, ["user_id"], ["t_ms", "event_id"], "sign")


_CLAMPED = """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN 1 ELSE -1 END AS s FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, list_reduce(list_prepend(0, list(s ORDER BY (epoch_us(ts) // 1000), event_id)), lambda a, b: greatest(0, a + b))::BIGINT AS occupancy FROM e GROUP BY 1"""


def alerting_zones(spark, d):
    i = rules.queue_alerts(P.rule_events(spark, d), RULES).withColumn("severity", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("onset_ms") % 3 + 1).cast("int")))
    queues = spark.range(16).select(F.concat(F.lit("q"), "id").alias("queue_id"), F.concat(F.lit("z"), F.col("id") % 3).alias("zone_id"))
    return traffic.alerting_zones(traffic.zone_of_incident(i, queues))


# ---- incidents, reviews, scores -----------------------------------------------------------------------------------


def _some_incidents(spark, d):
    e = P.events(spark, d).where("event_type = 'error'")
    return e.select(F.col("event_id").cast("string").alias("incident_id"), F.lit("s1").alias("store_id"), P.null_run(), F.col("t_ms").alias("onset_ms"), (F.col("t_ms") + 60_000).alias("detected_ms"), F.when(F.col("k") % 2 == 0, F.col("t_ms") + F.col("k") * 120_000).alias("resolved_ms"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("queue:q"), F.col("user_id") % 16)).otherwise(F.concat(F.lit("zone:z"), F.col("user_id") % 3)).alias("subject"))


def incident_timeline(spark, d):
    e = P.events(spark, d).where("event_type = 'click'")
    tills = e.select(F.lit("s1").alias("store_id"), P.null_run(), "t_ms", F.concat(F.lit("r"), F.col("user_id") % 5).alias("till_id"), F.when(F.col("k") % 2 == 0, "void").otherwise("open").alias("kind"), F.col("k").alias("amount_minor"))
    serving = spark.range(16).select(F.concat(F.lit("q"), "id").alias("queue_id"), F.concat(F.lit("r"), F.col("id") % 5).alias("register_id"))
    return incidents.timeline(_some_incidents(spark, d), P.rule_events(spark, d).withColumns({"store_id": F.lit("s1"), "run_id": F.lit(None).cast("string")}), tills=tills, serving=serving)


_TIMELINE = f"""WITH {_EV.split(',' + chr(10) + 'late')[0]}, i0 AS (SELECT event_id::VARCHAR AS incident_id, (epoch_us(ts) // 1000) AS o, (epoch_us(ts) // 1000) + 60000 AS dt, CASE WHEN (props->>'k')::INT % 2 = 0 THEN (epoch_us(ts) // 1000) + (props->>'k')::INT * 120000 END AS r,
  CASE WHEN (props->>'k')::INT % 3 = 0 THEN 'q' || (user_id % 16) END AS q, CASE WHEN (props->>'k')::INT % 3 <> 0 THEN 'z' || (user_id % 3) END AS z FROM events WHERE event_type = 'error'),
i AS (SELECT *, o - 600000 AS a, least(greatest(coalesce(r, dt), dt) + 300000, o - 600000 + 7200000) AS b FROM i0),
c AS (SELECT incident_id, 'queue' AS kind, a AS t_ms, arg_max(floor(value / 10)::INT, (t, arr))::BIGINT AS value FROM i JOIN e ON ty = 'purchase' AND 'q' || (u % 16) = q AND t < a AND t >= a - 7200000 GROUP BY incident_id, a),
s AS (SELECT incident_id, 'queue' AS kind, t AS t_ms, floor(value / 10)::BIGINT AS value FROM i JOIN e ON ty = 'purchase' AND 'q' || (u % 16) = q AND t BETWEEN a AND b),
m AS (SELECT incident_id, 'register.opened' AS kind, t AS t_ms, NULL::BIGINT AS value FROM i JOIN e ON ty = 'signup' AND t BETWEEN a AND b),
g AS (SELECT incident_id, a, unnest(generate_series(a, b, 60000)) AS t_ms, z, b FROM i WHERE z IS NOT NULL),
n AS (SELECT g.incident_id, 'zone' AS kind, g.t_ms, (SELECT count(*) FROM e WHERE ty = 'view' AND 'z' || (u % 3) = g.z AND t >= g.t_ms AND t < g.t_ms + 60000 AND t <= g.b)::BIGINT AS value FROM g),
y AS (SELECT incident_id, 'till.' || CASE WHEN (props->>'k')::INT % 2 = 0 THEN 'void' ELSE 'open' END AS kind, epoch_us(ts) // 1000 AS t_ms, (props->>'k')::BIGINT AS value FROM i JOIN events ON event_type = 'click' AND user_id % 5 = substr(q, 2)::INT % 5 AND epoch_us(ts) // 1000 BETWEEN a AND b),
x AS (SELECT * FROM c UNION ALL SELECT * FROM s UNION ALL SELECT * FROM m UNION ALL SELECT * FROM n UNION ALL SELECT * FROM y)
SELECT *, count(*) OVER (PARTITION BY incident_id, kind IN ('queue', 'zone')) > 500 AS truncated FROM x QUALIFY row_number() OVER (PARTITION BY incident_id, kind IN ('queue', 'zone') ORDER BY t_ms, kind, value) <= 500"""


def processing_latency(spark, d):
    e = P.events(spark, d).select(F.concat(F.lit("s"), F.col("user_id") % 4).alias("store_id"), "t_ms", (F.col("t_ms") + F.col("k") * 1000).alias("received_ms"), "event_type", "event_id")
    asked = e.where("event_type = 'purchase'").select("store_id", F.col("event_id").alias("incident_id"), F.col("t_ms").alias("detected_ms"), (F.col("t_ms") + 400_000).alias("created_ms"))
    return incidents.processing_latency(asked, e, 300_000)


_LATENCY = """WITH e AS (SELECT 's' || (user_id % 4) AS store_id, (epoch_us(ts) // 1000) AS t, (epoch_us(ts) // 1000) + (props->>'k')::INT * 1000 AS rcv, event_type, event_id FROM events),
m AS (SELECT store_id, t, min(min(rcv)) OVER (PARTITION BY store_id ORDER BY t DESC) AS f FROM e GROUP BY 1, 2)
SELECT p.store_id, p.event_id::VARCHAR AS incident_id, CASE WHEN m.f IS NULL THEN NULL ELSE greatest(0, p.t + 400000 - m.f) END AS latency_ms FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN m ON p.store_id = m.store_id AND p.t + 300000 <= m.t"""


def latency_gate(spark, d):
    return scoring.latency_gate(processing_latency(spark, d), 100_000)


def _reviews(spark, d):
    e = P.events(spark, d)
    inc = e.where("event_type = 'purchase'").select(F.col("event_id").alias("incident_id"), F.concat(F.lit("R-"), F.col("user_id") % 5).alias("rule_id"), F.col("t_ms").alias("created_ms"))
    act = e.where("event_type in ('view', 'click')").select((F.col("event_id") - F.col("k") % 7).alias("incident_id"), F.col("t_ms").alias("at_ms"), F.col("event_id").alias("seq"), F.when(F.col("k") % 3 == 0, "CONFIRMED").when(F.col("k") % 3 == 1, "DISMISSED").alias("decision"), F.concat(F.lit("R-"), F.col("user_id") % 5).alias("rule_id"), F.when(F.col("k") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("reason-"), F.col("k") % 6)).alias("reason"))
    return inc, act


def review_metrics(spark, d):
    out = incidents.review_metrics(*_reviews(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("confirm_rate", "rate_low", "rate_high")})


_WILSON = "CASE WHEN {n} = 0 THEN {z} ELSE {f}({z}, ({k}::DOUBLE / {n} + 1.96 * 1.96 / (2 * {n}) {s} 1.96 * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})) END"
_LOW = lambda k, n: _WILSON.format(k=k, n=n, z="0.0::DOUBLE", f="greatest", s="-")
_HIGH = lambda k, n: _WILSON.format(k=k, n=n, z="1.0::DOUBLE", f="least", s="+")
_REVIEWS = f"""WITH i AS (SELECT event_id AS id, 'R-' || (user_id % 5) AS rule_id, (epoch_us(ts) // 1000) AS c FROM events WHERE event_type = 'purchase'),
a AS (SELECT event_id - (props->>'k')::INT % 7 AS id, (epoch_us(ts) // 1000) AS at_ms, event_id AS seq, CASE (props->>'k')::INT % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'DISMISSED' END AS d FROM events WHERE event_type IN ('view', 'click')),
t AS (SELECT id, min(at_ms) AS touch FROM a GROUP BY 1), x AS (SELECT id, arg_max(d, (at_ms, seq)) AS d, max(at_ms) AS dat FROM a WHERE d IS NOT NULL GROUP BY 1),
g AS (SELECT rule_id, count(*) AS incidents, count(touch) AS acted, count(d) AS decided, count(*) FILTER (d = 'CONFIRMED') AS confirmed, count(*) FILTER (d = 'DISMISSED') AS dismissed,
 quantile_cont((touch - c)::DOUBLE, 0.5) AS touch_p50, quantile_cont((touch - c)::DOUBLE, 0.9) AS touch_p90, quantile_cont((dat - c)::DOUBLE, 0.5) AS decide_p50 FROM i LEFT JOIN t USING (id) LEFT JOIN x USING (id) GROUP BY 1)
SELECT *, acted - decided AS undecided, round(confirmed::DOUBLE / nullif(decided, 0), 9) AS confirm_rate, round({_LOW('confirmed', 'decided')}, 9) AS rate_low, round({_HIGH('confirmed', 'decided')}, 9) AS rate_high FROM g"""


def dismissal_reasons(spark, d):
    return incidents.dismissal_reasons(_reviews(spark, d)[1])


_REASONS = """SELECT 'R-' || (user_id % 5) AS rule_id, CASE WHEN (props->>'k')::INT % 4 = 0 THEN 'UNSPECIFIED' ELSE 'reason-' || ((props->>'k')::INT % 6) END AS reason, count(*) AS n FROM events
 WHERE event_type IN ('view', 'click') AND (props->>'k')::INT % 3 = 1 GROUP BY 1, 2"""


def _score_rows(spark, d):
    e = P.events(spark, d).where("event_type <> 'error'")
    return e.select(F.concat(F.lit("R-"), F.col("user_id") % 5).alias("rule_id"), F.concat(F.lit("1."), F.floor(F.col("event_id") / 4000), F.lit(".0")).alias("rule_version"), F.when(F.col("user_id") % 2 == 0, "enforce").otherwise("shadow").alias("mode"), F.col("t_ms").alias("run_ms"), F.col("event_id").alias("seq"), (F.col("k") % 30).alias("tp"), (F.col("k") % 3).alias("fp"), (F.col("k") % 2).alias("fn"))


def rule_scores_wilson(spark, d):
    out = incidents.rule_readiness(_score_rows(spark, d), 1_704_500_000_000)
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "precision_low", "recall_low")})


_READY = f"""WITH s AS (SELECT 'R-' || (user_id % 5) AS rule_id, '1.' || (event_id // 4000) || '.0' AS rule_version, CASE WHEN user_id % 2 = 0 THEN 'enforce' ELSE 'shadow' END AS mode, (epoch_us(ts) // 1000) AS r, event_id AS q, (props->>'k')::INT AS k FROM events WHERE event_type <> 'error'),
c AS (SELECT rule_id, arg_max(rule_version, (r, q)) AS rule_version, arg_max(mode, (r, q)) AS mode FROM s GROUP BY 1),
t AS (SELECT rule_id, rule_version, mode, count(*) AS runs, sum(k % 30)::BIGINT AS tp, sum(k % 3)::BIGINT AS fp, sum(k % 2)::BIGINT AS fn FROM s JOIN c USING (rule_id, rule_version, mode) WHERE r >= 1704500000000 GROUP BY 1, 2, 3),
u AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS rc FROM t),
w AS (SELECT *, concat_ws('; ', CASE WHEN tp + fn < 30 THEN 'too few cases' END, CASE WHEN coalesce(p, 0) < 0.95 THEN 'precision under the gate' END, CASE WHEN coalesce(rc, 0) < 0.95 THEN 'recall under the gate' END) AS reasons FROM u)
SELECT rule_id, rule_version, mode, runs, tp, fp, fn, round(p, 9) AS precision, round(rc, 9) AS recall, round({_LOW('tp', '(tp + fp)')}, 9) AS precision_low, round({_LOW('tp', '(tp + fn)')}, 9) AS recall_low, reasons, reasons = '' AS ready FROM w"""


def match_incidents(spark, d):
    e = P.events(spark, d)
    key = F.concat(F.lit("q"), F.col("user_id") % 8)
    truth = e.where("event_type = 'view'").select(F.lit("R-1").alias("rule_id"), F.lit("s1").alias("store_id"), key.alias("key"), F.col("event_id").cast("string").alias("gt_id"), F.col("t_ms").alias("at_ms"))
    inc = e.where("event_type = 'click'").select(F.lit("R-1").alias("rule_id"), F.lit("s1").alias("store_id"), key.alias("key"), F.col("event_id").cast("string").alias("incident_id"), F.lit("OPENED").alias("kind"), F.col("t_ms").alias("detected_ms"))
    matched = scoring.matches(truth, inc, 300_000, 1_200_000)
    return scoring.rule_scores(truth, inc, matched).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "precision_low", "precision_high", "recall_low", "recall_high")})


def band_candidates(spark, d):
    e = P.events(spark, d)
    key = F.concat(F.lit("q"), F.col("user_id") % 8)
    truth = e.where("event_type = 'view'").select(F.lit("R-1").alias("rule_id"), F.lit("s1").alias("store_id"), key.alias("key"), F.col("event_id").cast("string").alias("gt_id"), F.col("t_ms").alias("at_ms"))
    inc = e.where("event_type = 'click'").select(F.lit("R-1").alias("rule_id"), F.lit("s1").alias("store_id"), key.alias("key"), F.col("event_id").cast("string").alias("incident_id"), F.lit("OPENED").alias("kind"), F.col("t_ms").alias("detected_ms"))
    return scoring.candidates(truth, inc, 300_000, 1_200_000).select("gt_id", "incident_id", (F.col("detected_ms") - F.col("at_ms")).alias("delta_ms"))


#: All matchings in order of both sides, truth by truth in each cluster; of each cluster the one with most pairs, then the least distance.
_MATCHES = f"""WITH RECURSIVE x AS (SELECT user_id % 8 AS key, {{ms}} AS t, event_type = 'view' AS tr, event_id AS id FROM events WHERE event_type IN ('view', 'click')),
c AS (SELECT *, sum((t - p > 1500000)::INT) OVER (PARTITION BY key ORDER BY t) AS cl FROM (SELECT *, coalesce(lag(t) OVER (PARTITION BY key ORDER BY t), t) AS p FROM x)),
g AS (SELECT *, row_number() OVER (PARTITION BY key, cl ORDER BY t, id) AS i, count(*) OVER (PARTITION BY key, cl) AS n FROM c WHERE tr), d AS (SELECT *, row_number() OVER (PARTITION BY key, cl ORDER BY t, id) AS j FROM c WHERE NOT tr),
op AS (SELECT g.key, g.cl, g.i, d.j, d.t - g.t AS delta FROM g JOIN d ON d.key = g.key AND d.cl = g.cl AND d.t - g.t BETWEEN -300000 AND 1200000 UNION ALL SELECT key, cl, i, NULL, NULL FROM g),
m AS (SELECT DISTINCT key, cl, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS pairs, 0::BIGINT AS far, []::BIGINT[] AS lat FROM g
 UNION ALL SELECT m.key, m.cl, op.i, coalesce(op.j, m.j), pairs + (op.j IS NOT NULL)::INT, far + coalesce(abs(delta), 0), CASE WHEN op.j IS NULL THEN lat ELSE list_append(lat, delta) END
 FROM m JOIN op ON op.key = m.key AND op.cl = m.cl AND op.i = m.i + 1 WHERE op.j IS NULL OR op.j > m.j),
b AS (SELECT arg_max(lat, (pairs, -far)) AS lat FROM m JOIN (SELECT DISTINCT key, cl, n FROM g) q USING (key, cl) WHERE m.i = q.n GROUP BY key, cl), l AS (SELECT unnest(lat) AS v FROM b),
s AS (SELECT (SELECT count(*) FROM g) AS nt, (SELECT count(*) FROM d) AS ni, count(*) AS tp, max(v) AS latency_max, list(v ORDER BY v) AS vs FROM l),
r AS (SELECT *, ni - tp AS fp, nt - tp AS fn, tp::DOUBLE / ni AS p, tp::DOUBLE / nt AS rc FROM s)
SELECT 'R-1' AS rule_id, tp, latency_max, fp, fn, round(p, 9) AS precision, round(rc, 9) AS recall, round(2 * p * rc / (p + rc), 9) AS f1, round({_LOW('tp', 'ni')}, 9) AS precision_low, round({_HIGH('tp', 'ni')}, 9) AS precision_high,
 round({_LOW('tp', 'nt')}, 9) AS recall_low, round({_HIGH('tp', 'nt')}, 9) AS recall_high, vs[round_even(0.5 * (tp - 1), 0)::INT + 1] AS p50, vs[round_even(0.95 * (tp - 1), 0)::INT + 1] AS p95 FROM r""".replace("{ms}", "(epoch_us(ts) // 1000)")
_BAND = """SELECT g.event_id::VARCHAR AS gt_id, i.event_id::VARCHAR AS incident_id, (epoch_us(i.ts) // 1000) - (epoch_us(g.ts) // 1000) AS delta_ms FROM events g JOIN events i ON g.event_type = 'view' AND i.event_type = 'click' AND g.user_id % 8 = i.user_id % 8
 AND (epoch_us(i.ts) // 1000) - (epoch_us(g.ts) // 1000) BETWEEN -300000 AND 1200000"""


def asof_counts(spark, d):
    e = P.events(spark, d).withColumn("z", F.concat(F.lit("z"), F.col("user_id") % 3))
    changes = scoring.occupancy_changes(e.where("event_type in ('view', 'click')").select("z", F.col("user_id").alias("track_id"), "t_ms", F.col("event_id").alias("seq"), (F.col("event_type") == "view").cast("int").alias("inside")), ["z"])
    return scoring.counts_at(changes, e.where("event_type = 'signup'").select("z", "t_ms").distinct(), ["z"])


_OCC = """m AS (SELECT 'z' || (user_id % 3) AS z, user_id, (epoch_us(ts) // 1000) AS t, event_id, (event_type = 'view')::INT AS i FROM events WHERE event_type IN ('view', 'click')),
ch AS (SELECT z, t, event_id, sum(d) OVER (PARTITION BY z ORDER BY t, event_id) AS v FROM (SELECT *, i - coalesce(lag(i) OVER (PARTITION BY user_id ORDER BY t, event_id), 0) AS d FROM m)),
la AS (SELECT z, t, arg_max(v, event_id)::BIGINT AS v FROM ch GROUP BY 1, 2)"""
_ASOF = f"WITH {_OCC}, s AS (SELECT DISTINCT 'z' || (user_id % 3) AS z, (epoch_us(ts) // 1000) AS t_ms FROM events WHERE event_type = 'signup') SELECT s.z, s.t_ms, coalesce(la.v, 0)::BIGINT AS count FROM s ASOF LEFT JOIN la ON s.z = la.z AND s.t_ms >= la.t"


def count_score(spark, d):
    e = P.events(spark, d).withColumn("z", F.concat(F.lit("z"), F.col("user_id") % 3))
    changes = scoring.occupancy_changes(e.where("event_type in ('view', 'click')").select("z", F.col("user_id").alias("track_id"), "t_ms", F.col("event_id").alias("seq"), (F.col("event_type") == "view").cast("int").alias("inside")), ["z"])
    truth = e.where("event_type = 'signup'").groupBy("z", "t_ms").agg(F.max("k").alias("truth"))
    return scoring.count_scores(truth, changes, ["z"]).withColumns({c: F.round(c, 6) for c in ("mae", "within1", "bias", "mean_truth")})


_COUNT = f"""WITH {_OCC}, s AS (SELECT 'z' || (user_id % 3) AS z, (epoch_us(ts) // 1000) AS t_ms, max((props->>'k')::BIGINT) AS truth FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
j AS (SELECT s.z, truth, coalesce(la.v, 0) - truth AS e FROM s ASOF LEFT JOIN la ON s.z = la.z AND s.t_ms >= la.t)
SELECT z, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg((abs(e) <= 1)::INT), 6) AS within1, round(avg(e), 6) AS bias, max(abs(e))::BIGINT AS max_abs, round(avg(truth), 6) AS mean_truth, avg((abs(e) <= 1)::INT) >= 0.95 AND avg(abs(e)) <= 0.5 AS passed FROM j GROUP BY 1"""


def ks_two_sample(spark, d):
    e = P.events(spark, d).where("event_type in ('view', 'click')")
    return stats.ks_two_sample(e, "value", F.col("event_type") == "view").select(F.round("d", 9).alias("d"), F.round("p", 9).alias("p"), "n1", "n2")


_KS = """WITH c AS (SELECT value, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
n AS (SELECT sum(a)::BIGINT AS n1, sum(b)::BIGINT AS n2 FROM c), s AS (SELECT sum(a) OVER (ORDER BY value) AS ca, sum(b) OVER (ORDER BY value) AS cb FROM c),
k AS (SELECT max(abs(ca::DOUBLE / n1 - cb::DOUBLE / n2)) AS d, any_value(n1) AS n1, any_value(n2) AS n2 FROM s, n),
l AS (SELECT *, (sqrt(n1::DOUBLE * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1::DOUBLE * n2 / (n1 + n2))) * d AS lam FROM k)
SELECT round(d, 9) AS d, round(CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum([CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * lam * lam) for j in range(1, 101)]))) END, 9) AS p, n1, n2 FROM l"""


def wls_fit(spark, d):
    e = P.events(spark, d).groupBy("event_type", "k").agg(F.count("*").cast("double").alias("w"), (F.avg("value") / 1000).alias("y"))
    return stats.weighted_line(e, ["event_type"], "k", "y", "w").withColumns({"base": F.round("base", 9), "per": F.round("per", 9)})


_WLS = """WITH g AS (SELECT event_type, (props->>'k')::INT AS x, count(*)::DOUBLE AS w, avg(value) / 1000 AS y FROM events GROUP BY 1, 2),
s AS (SELECT event_type, sum(w) AS w, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM g GROUP BY 1), p AS (SELECT *, (w * xy - sx * sy) / (w * xx - sx * sx) AS per FROM s)
SELECT event_type, round(least(1.0, greatest(0.0, CASE WHEN per < 0 THEN sy / w ELSE sy / w - per * sx / w END)), 9) AS base, round(least(1.0, greatest(0.0, per)), 9) AS per FROM p"""


def empirical_dist(spark, d):
    return stats.empirical(P.events(spark, d).withColumn("v", F.floor("value")), ["event_type"], "v").withColumn("share", F.round("share", 12))


def moments(spark, d):
    return stats.moments(P.events(spark, d), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("mean", "sd", "log_mean", "log_sd")})


def nearest_rank(spark, d):
    return stats.nearest_rank(P.events(spark, d), ["event_type"], "value", [50, 90, 95])


def baseline_diff(spark, d):
    e = P.events(spark, d)
    half = lambda p: e.where(p).groupBy("user_id").agg((F.avg((F.col("event_type") == "view").cast("double"))).alias("share"))
    return scoring.baseline_diff(half(F.col("event_id") % 2 == 0), half(F.col("event_id") % 2 == 1), ["user_id"], "share", 5.0).withColumns({"before": F.round("before", 9), "after": F.round("after", 9)})


_BASE = """WITH b AS (SELECT user_id, avg((event_type = 'view')::INT) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT user_id, avg((event_type = 'view')::INT) AS s FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT * FROM (SELECT coalesce(b.user_id, c.user_id) AS user_id, round(b.s, 9) AS before, round(c.s, 9) AS after, CASE WHEN c.s IS NULL THEN 'removed' WHEN b.s IS NULL THEN 'new' WHEN (c.s - b.s) * 100 < -5 THEN 'drop' WHEN (c.s - b.s) * 100 > 5 THEN 'rise' END AS change FROM b FULL JOIN c ON b.user_id = c.user_id) WHERE change IS NOT NULL"""


def examples(spark, d):
    return scoring.examples(P.events(spark, d).withColumn("text", F.col("event_id").cast("string")), ["event_type"], "t_ms", "text").withColumn("examples", F.array_join("examples", ","))


def audit_chain_verify(spark, d):
    """A chain over the nations in which row 13 was changed and row 20 left out."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.lit("op").alias("actor"), F.lit("edit").alias("action"), F.col("n_name").alias("target"), F.col("n_regionkey").cast("string").alias("details"))
    content = F.to_json(F.struct("seq", "actor", "action", "target", "details"))
    lines = n.select(F.collect_list(F.struct("seq", content.alias("c"))).alias("l")).select(F.array_sort("l").alias("l"))  # 25 rows
    chain = lines.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.aggregate(F.slice("l", F.lit(1), i), F.lit("0" * 64), lambda h, x: F.sha2(F.concat(h, F.lit("\n"), x["c"]), 256)))).alias("seq", "row_hash"))
    log = n.join(chain.withColumn("seq", F.col("seq").cast("long")), "seq")
    before = chain.select((F.col("seq") + 1).cast("long").alias("seq"), F.col("row_hash").alias("prev_hash"))
    log = log.join(before, "seq", "left").withColumn("prev_hash", F.coalesce("prev_hash", F.lit("0" * 64)))
    return incidents.verify_audit(log.withColumn("target", F.when(F.col("seq") == 13, "changed").otherwise(F.col("target"))).where("seq <> 20"))


def exactly_once(spark, d):
    e = P.events(spark, d)
    rows = e.select(F.concat(F.lit("edge-"), F.col("user_id") % 10).alias("source"), F.col("event_id").alias("id"), "t_ms")
    return incidents.exactly_once(rows.withColumn("sequence", F.row_number().over(W.partitionBy("source").orderBy("id")) + F.when((F.col("source") == "edge-3") & (F.col("id") > 500), 1).otherwise(0)))


_ONCE = """WITH r AS (SELECT 'edge-' || (user_id % 10) AS source, event_id AS id FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) + CASE WHEN source = 'edge-3' AND id > 500 THEN 1 ELSE 0 END AS sq FROM r)
SELECT source, count(*) AS rows, count(DISTINCT id) AS ids, min(sq)::INT AS first, max(sq)::INT AS last, count(DISTINCT sq) AS sequences, min(sq) = 1 AND max(sq) = count(DISTINCT sq) AND count(*) = count(DISTINCT id) AS complete FROM s GROUP BY 1"""


def counter_rates(spark, d):
    s = P.events(spark, d).select("user_id", (F.col("t_ms") / 1000).alias("t"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("value"), F.when(F.col("event_type") == "error", "down").alias("error"))
    return incidents.counter_rates(s, ["user_id"]).withColumn("rate", F.round("rate", 9))


_RATES = """SELECT user_id, t, round((value - v) / (t - p), 9) AS rate FROM (SELECT *, lag(value) OVER w AS v, lag(t) OVER w AS p FROM (SELECT user_id, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS t, event_id AS value FROM events WHERE event_type <> 'error') WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE p IS NOT NULL"""


def topk_recent(spark, d):
    return P.events(spark, d).orderBy(F.desc("t_ms"), F.desc("event_id")).limit(50).select("event_id", "t_ms", "event_type")


def latest_per_key(spark, d):
    return traffic.latest(P.events(spark, d), ["user_id"], ["t_ms", "event_id"], ["event_type", "value"])


def round_functions(spark, d):
    e = P.events(spark, d)
    x = F.col("k") / 8.0
    return e.select("event_id", money.round_half_up(x, 2).alias("half_up"), money.round_half_even(x, 2).alias("half_even"), money.basis_points(F.col("k") - 50, F.col("k"), F.lit(50)).alias("bp"))


# ---- ingest -------------------------------------------------------------------------------------------------------


def _copies(spark, d):
    e = P.events(spark, d).select(F.concat(F.lit("src-"), F.col("user_id") % 5).alias("source"), F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("arrival"), F.md5(F.concat_ws("|", "event_type", F.col("value").cast("string"))).alias("payload_hash"), "event_id")
    again = e.where("event_id % 7 = 0").withColumn("arrival", F.col("arrival") + 10_000_000)
    other = e.where("event_id % 9 = 0").withColumns({"arrival": F.col("arrival") + 20_000_000, "payload_hash": F.md5(F.col("id"))})
    return e.union(again).union(other).drop("event_id")


def dedup_conflict(spark, d):
    return ingest.dedup(_copies(spark, d)).select("source", "id", "arrival", "result")


_DEDUP = """WITH e AS (SELECT 'src-' || (user_id % 5) AS source, event_id::VARCHAR AS id, event_id AS arrival, 0 AS h, event_id FROM events), a AS (SELECT * FROM e UNION ALL SELECT source, id, arrival + 10000000, 0, event_id FROM e WHERE event_id % 7 = 0 UNION ALL SELECT source, id, arrival + 20000000, 1, event_id FROM e WHERE event_id % 9 = 0)
SELECT source, id, arrival, CASE WHEN row_number() OVER w = 1 THEN 'ACCEPTED' WHEN h = first_value(h) OVER w THEN 'DUPLICATE' ELSE 'CONFLICT' END AS result FROM a WINDOW w AS (PARTITION BY source, id ORDER BY arrival)"""


def envelopes(spark, d):
    """Events as envelopes, with faults planted by id."""
    e = P.dealt(P.events(spark, d).select("event_id", "user_id", "t_ms", "k"), "event_id")
    i = F.col("event_id")
    kind = F.when(i % 13 == 0, "com.retail.store.unheard").otherwise("com.retail.store.queue.length")
    data = F.to_json(F.struct(F.concat(F.lit("q"), F.col("user_id") % 4).alias("queueId"), F.when(i % 17 == 0, F.lit("many")).otherwise(F.col("k").cast("string")).alias("length"), F.when(i % 19 != 0, F.lit(1)).alias("openRegisters")))
    return e.select(
        F.lit("1.0").alias("specversion"), i.cast("string").alias("id"), F.lit("urn:retail:edge:s1:a").alias("source"), kind.alias("type"), F.when(i % 23 == 0, "yesterday").otherwise(F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("time"),
        F.when(i % 29 == 0, "zone:a").otherwise("queue:q1").alias("subject"), F.lit("https://schemas.example/store.queue.length-1.0.0.json").alias("dataschema"), F.lit("application/json").alias("datacontenttype"), F.lit("s1").alias("storeid"),
        F.when(i % 31 == 0, "s2").otherwise("s1").alias("partitionkey"), F.lit(None).cast("string").alias("simrunid"), i.cast("string").alias("sequence"), F.lit(None).cast("string").alias("traceparent"), F.lit(None).cast("string").alias("tracestate"), data.alias("data"), i.alias("arrival"), "t_ms",
    )


def validate_collect_errors(spark, d):
    out = ingest.validate(envelopes(spark, d).drop("t_ms"), F.lit(1_706_745_600_000).cast("long"))
    return out.select("id", F.array_join("errors", "; ").alias("errors"))


_VALIDATE = """SELECT event_id::VARCHAR AS id, concat_ws('; ', CASE WHEN event_id % 13 = 0 THEN 'unknown type com.retail.store.unheard' END,
 CASE WHEN event_id % 13 <> 0 AND event_id % 29 = 0 THEN 'subject does not fit the type' END, CASE WHEN event_id % 13 <> 0 AND event_id % 17 = 0 THEN 'data.length is not an integer' END, CASE WHEN event_id % 13 <> 0 AND event_id % 19 = 0 THEN 'data.openRegisters is missing' END,
 CASE WHEN event_id % 23 = 0 THEN 'time is not a timestamp' END, CASE WHEN event_id % 23 <> 0 AND (epoch_us(ts) // 1000) < 1706745600000 - 86400000 THEN 'time is too old' END, CASE WHEN event_id % 31 = 0 THEN 'partitionkey is not the store' END) AS errors FROM events"""


def canonical_hash(spark, d):
    """Hash groups of envelopes that differ in trace context only (F1, F2)."""
    e = envelopes(spark, d).drop("t_ms")
    both = e.union(e.withColumn("traceparent", F.lit("00-1")))
    return ingest.hashed(both).groupBy("id").agg(F.count_distinct("payload_hash").alias("hashes"), F.count("*").alias("copies"))


def local_bins(spark, d):
    """Bins on a local clock with daylight saving (T1): the hour that comes twice and the one that never comes."""
    e = P.events(spark, d).where("event_type = 'view'")
    at = B.from_ms((F.col("t_ms") - 1_704_067_200_000) + F.lit(1_698_500_000_000))
    return e.select("event_id", B.local_bin(at, "Europe/Berlin", "hour").alias("bin_start"), B.local_date(at, "Europe/Berlin").alias("day"))


_LOCAL = """WITH a AS (SELECT event_id, make_timestamp(((epoch_us(ts) // 1000) - 1704067200000 + 1698500000000) * 1000) AS u FROM events WHERE event_type = 'view'),
l AS (SELECT event_id, u + CASE WHEN u < TIMESTAMP '2023-10-29 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS t FROM a) SELECT event_id, date_trunc('hour', t) AS bin_start, t::DATE AS day FROM l"""

QUERIES = {
    f.__name__: f
    for f in (
        late_split, rule_queue_islands, rule_dwell, footfall_windows, rule_footfall_spike, rule_fold, incident_upsert, traffic_bins, queue_time_weighted, joined_buckets, asof_carry, floor_state, clamped_occupancy, alerting_zones,
        incident_timeline, processing_latency, latency_gate, review_metrics, dismissal_reasons, rule_scores_wilson, match_incidents, band_candidates, asof_counts, count_score, ks_two_sample, wls_fit, empirical_dist, moments, nearest_rank,
        baseline_diff, examples, audit_chain_verify, exactly_once, counter_rates, topk_recent, latest_per_key, round_functions, dedup_conflict, validate_collect_errors, canonical_hash, local_bins,
    )
}
SQL = {
    "late_split": f"WITH {_EV} SELECT id::VARCHAR AS id, t AS t_ms, late FROM late",
    "rule_queue_islands": _QUEUE,
    "rule_dwell": _DWELL,
    "footfall_windows": f"WITH {_WINDOWS} SELECT start_ms, zone_id, n FROM win",
    "rule_footfall_spike": _FOOT,
    "rule_fold": _FOLD,
    "incident_upsert": _UPSERT,
    "traffic_bins": f"WITH {_BINS}, {_VISITS} SELECT bin_start, coalesce(n, 0) AS visitors FROM bins LEFT JOIN v USING (bin_start)",
    "queue_time_weighted": f"WITH {_BINS}, {_STEPS} SELECT key, bin_start, mean, peak FROM qs",
    "joined_buckets": f"""WITH {_BINS}, {_VISITS}, {_STEPS}, q AS (SELECT bin_start, sum(mean) AS m, max(peak) AS p FROM qs GROUP BY 1),
 sa AS (SELECT date_trunc('hour', ts + INTERVAL 330 MINUTE) AS bin_start, count(*) AS bills, sum(round(value * 100)::BIGINT)::BIGINT AS sales_minor FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06' GROUP BY 1)
 SELECT bin_start, coalesce(n, 0) AS visitors, round(m, 6) AS queue_mean, p AS queue_peak, coalesce(bills, 0) AS bills, coalesce(sales_minor, 0) AS sales_minor FROM bins LEFT JOIN v USING (bin_start) LEFT JOIN q USING (bin_start) LEFT JOIN sa USING (bin_start)""",
    "asof_carry": f"SELECT 'q' || (user_id % 8) AS key, {_F} AS t_ms, -1::BIGINT AS seq, arg_max(floor(value)::BIGINT, ((epoch_us(ts) // 1000), event_id)) AS value FROM events WHERE (epoch_us(ts) // 1000) < {_F} AND (epoch_us(ts) // 1000) >= {_F} - 43200000 GROUP BY 1",
    "floor_state": _FLOOR,
    "clamped_occupancy": _CLAMPED,
    "alerting_zones": f"WITH i AS ({_QUEUE}), z AS (SELECT 'z' || (substr(key, 2)::INT % 3) AS zone_id, onset_ms % 3 AS r FROM i) SELECT zone_id, ['low', 'medium', 'high'][max(r) + 1] AS severity FROM z GROUP BY 1",
    "incident_timeline": _TIMELINE,
    "processing_latency": _LATENCY,
    "latency_gate": f"WITH l AS ({_LATENCY}), r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM l WHERE latency_ms IS NOT NULL) SELECT (SELECT max(latency_ms) FROM l) AS max, (SELECT count(*) FROM l WHERE latency_ms IS NULL) AS unmeasured, max(latency_ms) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(latency_ms) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, max(n) AS n, max(latency_ms) FILTER (i = round_even(0.95 * (n - 1), 0)) <= 100000 AS passed FROM r",
    "review_metrics": _REVIEWS,
    "dismissal_reasons": _REASONS,
    "rule_scores_wilson": _READY,
    "band_candidates": _BAND,
    "match_incidents": _MATCHES,
    "asof_counts": _ASOF,
    "count_score": _COUNT,
    "ks_two_sample": _KS,
    "wls_fit": _WLS,
    "empirical_dist": "SELECT event_type, floor(value)::BIGINT AS v, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY event_type), 12) AS share FROM events GROUP BY 1, 2",
    "moments": "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(avg(ln(value)), 6) AS log_mean, round(stddev_pop(ln(value)), 6) AS log_sd FROM events GROUP BY 1",
    "nearest_rank": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (i = round_even(0.9 * (n - 1), 0)) AS p90, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, max(n) AS n FROM r GROUP BY 1",
    "baseline_diff": _BASE,
    "examples": "SELECT event_type, string_agg(x, ',' ORDER BY x) AS examples FROM (SELECT event_type, event_id::VARCHAR AS x FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000), event_id::VARCHAR) <= 3) GROUP BY 1",
    "audit_chain_verify": "SELECT count(*) AS rows, 13::BIGINT AS broken_at_seq FROM nation WHERE n_nationkey <> 20",
    "exactly_once": _ONCE,
    "counter_rates": _RATES,
    "topk_recent": "SELECT event_id, (epoch_us(ts) // 1000) AS t_ms, event_type FROM events ORDER BY 2 DESC, 1 DESC LIMIT 50",
    "latest_per_key": "SELECT DISTINCT ON (user_id) user_id, event_type, value FROM events ORDER BY user_id, (epoch_us(ts) // 1000) DESC, event_id DESC",
    "round_functions": "SELECT event_id, floor(k / 8.0::DOUBLE * 100 + 0.5) / 100 AS half_up, round_even(k / 8.0::DOUBLE, 2) AS half_even, CASE WHEN k = 50 THEN 0.0::DOUBLE ELSE abs(k - 50) * 10000.0::DOUBLE / greatest(k, 50) END AS bp FROM (SELECT event_id, (props->>'k')::INT AS k FROM events)",
    "dedup_conflict": _DEDUP,
    "validate_collect_errors": _VALIDATE,
    "canonical_hash": "SELECT event_id::VARCHAR AS id, 1::BIGINT AS hashes, 2::BIGINT AS copies FROM events",
    "local_bins": _LOCAL,
}
