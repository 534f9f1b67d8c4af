"""Queries over reports: health, gates, drops, floor rows, queues and zones, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.operators import incidents, rules, scoring, traffic
from aislewise.operators import tracking as T
from aislewise.plans import proxies as P
from aislewise.plans.proxies import table
from aislewise.plans.event_queries import _DWELL, _EV, _QUEUE, RULES
from aislewise.plans.vision_queries import _BOXES, boxes

_MS = "epoch_us(ts) // 1000"


def source_health(spark, d):
    """State and next try of polled sources: a customer is a source."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    s = c.select("c_custkey", F.when(k % 5 > 0, 100_000 - k * 7 % 2000).alias("last_success_s"), (60 + k % 7 * 60).alias("interval_s"), (k % 30 - 25).alias("f"), F.when(k % 3 > 0, 99_000 + k).alias("last_try_s")).withColumn("failures", F.greatest(F.lit(0).cast("long"), "f"))
    return incidents.source_health(s, F.lit(100_000)).select("c_custkey", "state", "next_try_s")


_HEALTH = """WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 > 0 THEN 100000 - c_custkey * 7 % 2000 END AS ok, 60 + c_custkey % 7 * 60 AS i, greatest(0, c_custkey % 30 - 25) AS f, CASE WHEN c_custkey % 3 > 0 THEN 99000 + c_custkey END AS t FROM customer),
h AS (SELECT *, ok IS NULL OR 100000 - ok > 3 * i AS stale FROM s)
SELECT k AS c_custkey, CASE WHEN f = 0 THEN CASE WHEN stale THEN 'stale' ELSE 'ok' END WHEN stale THEN 'down' ELSE 'failing' END AS state, (coalesce(t, 0) + least(3600, i * 2 ** least(f, 20)))::BIGINT AS next_try_s FROM h"""


def edge_agents(spark, d):
    """Latest heartbeat of each user's agent in seven days, stale flag."""
    e = P.events(spark, d).select(F.concat(F.lit("u"), "user_id").alias("source"), "t_ms", F.concat(F.lit("1."), F.col("k")).alias("agent_version"), F.col("event_id").alias("arrival"))
    return incidents.agent_rows(e, 1_704_067_200_000 + 29 * 86_400_000, 3_600_000, 50)


_AGENTS = f"""WITH e AS (SELECT 'u' || user_id AS source, {_MS} AS t_ms, '1.' || (props->>'k') AS v, event_id FROM events WHERE {_MS} >= 1705968000000)
SELECT source, max(t_ms) AS t_ms, arg_max(v, (t_ms, event_id)) AS agent_version, max(t_ms) < 1706569200000 AS stale FROM e GROUP BY 1 ORDER BY t_ms DESC, source LIMIT 50"""


def heartbeat_upsert(spark, d):
    """The newest heartbeat per task of an agent."""
    e = P.events(spark, d)
    return traffic.latest(e, ["user_id", "event_type"], ["t_ms", "event_id"], ["t_ms", "value"])


def _scores(spark, d):
    e = P.events(spark, d).where("event_type <> 'error'")
    s = e.groupBy((F.col("user_id") % 3).cast("string").alias("scenario"), F.concat(F.lit("R-"), F.col("user_id") % 5).alias("rule_id")).agg(F.count("*").alias("n_precision"), F.count_if(F.col("k") % 9 > 0).alias("good"), F.count_if(F.col("k") % 4 > 0).alias("n_recall"))
    return s.select("scenario", "rule_id", (F.col("good") / F.col("n_precision")).alias("precision"), (F.col("n_recall") / F.col("n_precision")).alias("recall"), (F.col("good") / F.col("n_precision") - 0.05).alias("precision_low"), (F.col("n_recall") / F.col("n_precision") - 0.1).alias("recall_low"), F.col("n_precision"), (F.col("n_recall") % 60).alias("n_recall"))


_SCORES = """sc AS (SELECT (user_id % 3)::VARCHAR AS scenario, 'R-' || (user_id % 5) AS rule_id, count(*) AS n, count(*) FILTER ((props->>'k')::INT % 9 > 0) AS good, count(*) FILTER ((props->>'k')::INT % 4 > 0) AS r FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
s AS (SELECT scenario, rule_id, good / n AS precision, r / n AS recall, good / n - 0.05 AS precision_low, r / n - 0.1 AS recall_low, n AS n_precision, r % 60 AS n_recall FROM sc)"""
GATES = [("*", "*", 0.85, 0.7), ("0", "*", 0.9, 0.76), ("*", "R-1", 0.89, 0.75), ("1", "R-2", 0.95, 0.5)]


def gated_scores(spark, d):
    """Failures and warnings of scores under gates: a scenario's rule, its own default, a rule's, the default (M4)."""
    out = scoring.gated(_scores(spark, d), spark.createDataFrame(GATES, "scenario string, rule_id string, precision double, recall double"))
    return out.select("scenario", "rule_id", "failures", "warnings")


_GATED = f"""WITH {_SCORES}, g AS (SELECT * FROM (VALUES {', '.join(map(str, GATES))}) g(gs, gr, gp, gc)),
b AS (SELECT s.*, arg_max(gp, CASE WHEN gs = '*' THEN 0 ELSE 2 END + CASE WHEN gr = '*' THEN 0 ELSE 1 END) OVER w AS p, arg_max(gc, CASE WHEN gs = '*' THEN 0 ELSE 2 END + CASE WHEN gr = '*' THEN 0 ELSE 1 END) OVER w AS c, row_number() OVER w AS n FROM s JOIN g ON (gs = scenario OR gs = '*') AND (gr = rule_id OR gr = '*') WINDOW w AS (PARTITION BY scenario, rule_id))
SELECT scenario, rule_id, concat_ws('; ', CASE WHEN precision < p THEN 'precision under the gate' END, CASE WHEN n_precision >= 30 AND precision_low < 0.9 THEN 'precision lower bound under 0.9' END, CASE WHEN recall < c THEN 'recall under the gate' END, CASE WHEN n_recall >= 30 AND recall_low < 0.9 THEN 'recall lower bound under 0.9' END) AS failures,
 concat_ws('; ', CASE WHEN n_precision > 0 AND n_precision < 30 AND precision_low < p THEN 'precision: too few samples' END, CASE WHEN n_recall > 0 AND n_recall < 30 AND recall_low < c THEN 'recall: too few samples' END) AS warnings FROM b WHERE n = 1"""


def noise_report(spark, d):
    """Largest losses against the clean run per noise profile."""
    base = _scores(spark, d).select("scenario", "rule_id", "precision", "recall")
    noisy = base.withColumn("profile", F.explode(F.array(F.lit("p1"), F.lit("p2"))))
    noisy = noisy.withColumns({"precision": F.col("precision") * F.when(F.col("profile") == "p1", 0.9).otherwise(1.1), "recall": F.col("recall") - F.length("rule_id") * 0.01 - F.col("scenario").cast("int") * 0.02})
    out = scoring.worst_drops(base, noisy, ["scenario", "rule_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision_drop", "recall_drop")})


_DROPS = f"""WITH {_SCORES}, n AS (SELECT 'p' || k AS profile, scenario, rule_id, (precision - precision * CASE WHEN k = 1 THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END) * 100 AS pd, (recall - (recall - length(rule_id) * 0.01::DOUBLE - scenario::INT * 0.02::DOUBLE)) * 100 AS rd FROM s, (VALUES (1), (2)) v(k)),
r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY round(greatest(pd, rd), 9) DESC, scenario, rule_id) AS rank FROM n)
SELECT profile, scenario, rule_id, round(pd, 6) AS precision_drop, round(rd, 6) AS recall_drop, rank FROM r WHERE rank <= 5"""


def best_setting(spark, d):
    """The first of all settings in a lexicographic order of measures."""
    s = _scores(spark, d)
    return scoring.best_setting(s.select("scenario", "rule_id", "n_recall"), [F.col("n_recall") < 10, F.desc(F.col("n_recall") % 10), F.col("scenario"), F.col("rule_id")])


def incident_list(spark, d):
    """Latest incidents under filters of mode, states and rule (P10, K2)."""
    e = P.events(spark, d).select(F.col("event_id").alias("incident_id"), F.col("t_ms").alias("detected_ms"), F.when(F.col("k") % 2 == 0, "enforce").otherwise("shadow").alias("mode"), F.upper("event_type").alias("status"), F.concat(F.lit("R-"), F.col("user_id") % 5).alias("rule_id"), F.lit("s1").alias("store_id"))
    return incidents.selected(e, "enforce", ["VIEW", "CLICK"], "s1", "R-3", 200).select("incident_id", "detected_ms")


def occupancy_errors(spark, d):
    """Noisy less clean counts at each hour where the clean one is from 2 to 8."""
    e = P.events(spark, d)
    change = lambda cut: e.where(f"k % 7 <> {cut}").select(F.concat(F.lit("z"), F.col("user_id") % 3).alias("zone"), "t_ms", F.col("event_id").alias("seq"), (F.col("k") % 11).alias("value"))
    hours = e.select(F.concat(F.lit("z"), F.col("user_id") % 3).alias("zone"), (F.floor(F.col("t_ms") / 3_600_000) * 3_600_000).alias("t_ms")).distinct()
    return scoring.occupancy_errors(change(9), change(0), ["zone"], hours)


_OCC = f"""WITH e AS (SELECT 'z' || (user_id % 3) AS zone, {_MS} AS t, event_id, (props->>'k')::INT AS k FROM events), h AS (SELECT DISTINCT zone, t // 3600000 * 3600000 AS t_ms FROM e),
c AS (SELECT h.zone, h.t_ms, coalesce(arg_max(k % 11, (t, event_id)), 0) AS clean, coalesce(arg_max(k % 11, (t, event_id)) FILTER (k % 7 <> 0), 0) AS noisy FROM h LEFT JOIN e ON e.zone = h.zone AND e.t <= h.t_ms GROUP BY 1, 2)
SELECT zone, t_ms, noisy - clean AS error FROM c WHERE clean BETWEEN 2 AND 8"""


def ignored_tracks(spark, d):
    """Tracker boxes that are left when those over ignore regions go."""
    b = boxes(spark, d).select("sequence", "frame", "track_id", "x1", "y1", "x2", "y2")
    moved = b.withColumns({"x1": F.col("x1") + 4, "x2": F.col("x2") + 4})
    return T.without_ignored(moved, b.where("track_id % 3 = 0"), b.where("track_id % 3 = 1")).select("sequence", "frame", "track_id")


_IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s"
_IGNORED = f"""WITH {_BOXES}, t AS (SELECT *, det_id % 8 AS track_id FROM b), m AS (SELECT sequence, frame, track_id, x1 + 4 AS x1, y1, x2 + 4 AS x2, y2 FROM t),
p AS (SELECT a.sequence, a.frame, a.track_id, b.track_id % 3 AS kind, {_IOU} FROM m a JOIN t b ON a.sequence = b.sequence AND a.frame = b.frame), o AS (SELECT *, i / (s - i) > 0.5 - 1e-9 AS hit FROM p),
k AS (SELECT sequence, frame, track_id, bool_or(hit AND kind = 1) AND NOT bool_or(hit AND kind = 0) AS waste FROM o GROUP BY 1, 2, 3) SELECT sequence, frame, track_id FROM k WHERE NOT waste"""


def queue_lengths(spark, d):
    """Queue lengths after joins and leaves."""
    e = P.events(spark, d).where("event_type in ('view', 'click')").select(F.lit("c").alias("sequence"), (F.floor(F.col("t_ms") / 60_000) * 60_000).alias("t_ms"), F.when(F.col("event_type") == "view", "queue.joined").otherwise("queue.left").alias("kind"), F.concat(F.lit("q"), F.col("user_id") % 16).alias("queue_id"))
    return T.queue_lengths(e)


_LENGTHS = f"""WITH s AS (SELECT 'q' || (user_id % 16) AS queue_id, {_MS} // 60000 * 60000 AS t_ms, sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) AS d FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2 HAVING sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) <> 0)
SELECT 'c' AS sequence, queue_id, t_ms, sum(d) OVER (PARTITION BY queue_id ORDER BY t_ms)::BIGINT AS length FROM s"""


def clock_ticks(spark, d):
    e = P.events(spark, d).select(F.concat(F.lit("c"), F.col("user_id") % 3).alias("sequence"), "t_ms")
    return T.ticks(e, 3_600_000)


def routed_rules(spark, d):
    """Queue incidents by where their rule's mode sends them."""
    from dataclasses import replace

    both = rules.queue_alerts(P.rule_events(spark, d), RULES).unionByName(rules.dwell_alerts(P.rule_events(spark, d), replace(RULES, dwell=rules.Rule("R-DWELL-001", "1.1.0", "shadow", "low"))))
    return rules.routed(both, "enforce").groupBy(F.lit("enforce").alias("mode"), "rule_id").agg(F.count("*").alias("n")).union(rules.routed(both, "shadow").groupBy(F.lit("shadow"), "rule_id").agg(F.count("*")))


def floor_table(spark, d):
    """People and alerts of each zone of the layout."""
    e = P.events(spark, d)
    zone = F.concat(F.lit("z"), F.col("user_id") % 40)
    people = traffic.occupancy(e.where("event_type in ('view', 'click')").withColumn("zone_id", zone), ["zone_id"], F.when(F.col("event_type") == "view", 1).otherwise(-1))
    alerts = traffic.alerting_zones(e.where("event_type = 'error'").select(zone.alias("zone_id"), F.element_at(F.array(*map(F.lit, traffic.SEVERITIES)), (F.col("event_id") % 3 + 1).cast("int")).alias("severity")))
    zones = table(spark, d, "nation").select(F.concat(F.lit("z"), F.col("n_nationkey") * 2).alias("zone_id"))
    return traffic.floor_rows(people.select(F.lit("zone").alias("kind"), F.col("zone_id").alias("id"), F.col("occupancy").alias("value")), zones, alerts)


_FLOOR = """WITH z AS (SELECT 'z' || (n_nationkey * 2) AS zone_id FROM nation), p AS (SELECT 'z' || (user_id % 40) AS zone_id, greatest(0, sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END))::BIGINT AS people FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
a AS (SELECT 'z' || (user_id % 40) AS zone_id, max(event_id % 3) AS r FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT zone_id, coalesce(people, 0) AS people, ['low', 'medium', 'high'][r + 1] AS alert FROM z LEFT JOIN p USING (zone_id) LEFT JOIN a USING (zone_id)"""


def floor_queues(spark, d):
    """Waiting people, registers and alerts of each queue of the layout."""
    e = P.events(spark, d)
    queues = table(spark, d, "nation").select(F.concat(F.lit("q"), "n_nationkey").alias("queue_id"), F.concat(F.lit("z"), F.col("n_nationkey") % 7).alias("zone_id"), (F.col("n_nationkey") * 7 % 25).alias("position"))
    zones = table(spark, d, "region").select(F.concat(F.lit("z"), "r_regionkey").alias("zone_id"), F.col("r_name").alias("name"))
    registers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("register_id"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("q"), "s_nationkey")).alias("queue_id"))
    lengths = e.where("event_type = 'purchase'").select(F.concat(F.lit("q"), F.col("user_id") % 20).alias("queue_id"), "t_ms", F.col("event_id").alias("arrival"), F.floor(F.col("value") / 10).alias("length"), (F.col("k") % 4).alias("open_registers"))
    errors = e.where("event_type = 'error'").select(F.concat(F.lit("z"), F.col("user_id") % 6).alias("zone_id"), F.element_at(F.array(*map(F.lit, traffic.SEVERITIES)), (F.col("user_id") % 3 + 1).cast("int")).alias("severity"))
    return traffic.queue_rows(queues, zones, registers, lengths, traffic.alerting_zones(errors))


_QUEUES = f"""WITH q AS (SELECT 'q' || n_nationkey AS queue_id, 'z' || (n_nationkey % 7) AS zone_id, n_nationkey * 7 % 25 AS position FROM nation), f AS (SELECT arg_min(queue_id, position) AS first FROM q),
z AS (SELECT 'z' || r_regionkey AS zone_id, r_name AS name FROM region), g AS (SELECT CASE WHEN s_suppkey % 3 > 0 THEN 'q' || s_nationkey ELSE (SELECT first FROM f) END AS queue_id, count(*) AS registers FROM supplier GROUP BY 1),
l AS (SELECT 'q' || (user_id % 20) AS queue_id, arg_max(floor(value / 10)::BIGINT, ({_MS}, event_id)) AS length, arg_max((props->>'k')::BIGINT % 4, ({_MS}, event_id)) AS open_registers FROM events WHERE event_type = 'purchase' GROUP BY 1),
a AS (SELECT 'z' || (user_id % 6) AS zone_id, ['low', 'medium', 'high'][max(user_id % 3) + 1] AS alert FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT queue_id, coalesce(name, zone_id) AS zone, coalesce(length, 0) AS waiting, coalesce(open_registers, 0) AS open_registers, coalesce(registers, 0) AS registers, alert FROM q LEFT JOIN z USING (zone_id) LEFT JOIN g USING (queue_id) LEFT JOIN l USING (queue_id) LEFT JOIN a USING (zone_id)"""


def queue_registers(spark, d):
    """Registers that serve each queue; those that name none serve the first."""
    queues = table(spark, d, "nation").select(F.concat(F.lit("q"), "n_nationkey").alias("queue_id"), (F.col("n_nationkey") * 7 % 25).alias("position"))
    registers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("register_id"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("q"), "s_nationkey")).alias("queue_id"))
    return traffic.registers_of_queues(queues, registers)


_REGISTERS = "SELECT CASE WHEN s_suppkey % 3 > 0 THEN 'q' || s_nationkey ELSE 'q0' END AS queue_id, s_suppkey AS register_id FROM supplier"


def dropped_late(spark, d):
    """Late events per store."""
    from aislewise.operators.fold import dropped_late as late

    return late(P.rule_events(spark, d), RULES).select("store_id", "late")


def precision_recall_at(spark, d):
    """Precision and recall of detections over score thresholds (M8)."""
    lab = table(spark, d, "labels")
    m = lab.select(F.concat(F.lit("t"), F.col("toxic")).alias("sequence"), (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("score"), F.col("quality").alias("tp"))
    n = m.groupBy("sequence").agg((F.sum("tp") + 5).alias("n"))
    out = T.precision_recall_at(m, n, [0.0, 0.25, 0.5, 0.9])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


_PR = """WITH m AS (SELECT 't' || toxic AS sequence, doc_id * 7919 % 1000 / 1000.0::DOUBLE AS score, quality AS tp FROM labels), n AS (SELECT sequence, sum(tp) + 5 AS n FROM m GROUP BY 1)
SELECT sequence, threshold::DOUBLE AS threshold, round(sum(tp) / count(*), 9) AS precision, round(sum(tp) / max(n), 9) AS recall FROM m JOIN n USING (sequence), (VALUES (0.0), (0.25), (0.5), (0.9)) v(threshold) WHERE score >= threshold GROUP BY 1, 2"""


def zone_stays(spark, d):
    """Entries and exits of all users in the zone of 64 cameras: hysteresis, back-dating and losses."""
    m = T.Membership(margin=1.0, enter_s=1800.0, exit_s=3600.0, lost_s=86_400.0, handover_s=0)
    zone = T.Zone("z", ((2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)))
    return T.zone_events(walks(spark, d), (zone,), m).select("sequence", "t_ms", "kind", "track_id", "how")


def walks(spark, d):
    """Positions of all users, dealt to 64 cameras; a user has one place at an instant."""
    e = P.events(spark, d)
    return e.groupBy(F.concat(F.lit("cam-"), F.col("user_id") % 64).alias("sequence"), "t_ms", F.col("user_id").alias("track_id")).agg(F.max(F.col("value") % 10).alias("x")).withColumn("y", F.col("x") * 7 % 10)


_STAYS = f"""WITH w AS (SELECT user_id % 64 AS cam, {_MS} AS t, user_id AS u, max(value % 10) AS x FROM events GROUP BY 1, 2, 3), f AS (SELECT DISTINCT cam, t FROM w), fb AS (SELECT *, lag(t) OVER (PARTITION BY cam ORDER BY t) AS b FROM f),
p AS (SELECT w.*, x * 7 % 10 AS y, fb.b, coalesce(fb.b - lag(t) OVER (PARTITION BY cam, u ORDER BY t) > 86400000, false) AS cut FROM w JOIN fb USING (cam, t)),
l AS (SELECT *, sum(cut::INT) OVER (PARTITION BY cam, u ORDER BY t) AS life, CASE WHEN x > 2 AND x < 8 AND y > 2 AND y < 8 THEN least(x - 2, 8 - x, y - 2, 8 - y) ELSE -sqrt(greatest(0, 2 - x, x - 8) ** 2 + greatest(0, 2 - y, y - 8) ** 2) END AS depth FROM p),
s AS (SELECT *, last_value(CASE WHEN depth >= 1 THEN 1 WHEN depth <= -1 THEN -1 END IGNORE NULLS) OVER (PARTITION BY cam, u, life ORDER BY t) AS side FROM l),
i AS (SELECT *, sum((side IS DISTINCT FROM pv)::INT) OVER (PARTITION BY cam, u, life ORDER BY t) AS island FROM (SELECT *, lag(side) OVER (PARTITION BY cam, u, life ORDER BY t) AS pv FROM s WHERE side IS NOT NULL)),
g AS (SELECT *, min(t) OVER (PARTITION BY cam, u, life, island) AS begun FROM i),
c AS (SELECT *, coalesce(last_value(CASE WHEN t - begun >= CASE side WHEN 1 THEN 1800000 ELSE 3600000 END THEN side END IGNORE NULLS) OVER (PARTITION BY cam, u, life ORDER BY t), -1) AS state FROM g),
k AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY cam, u, life ORDER BY t), -1) AS was, lead(t) OVER (PARTITION BY cam, u, life ORDER BY t) AS nx FROM c)
SELECT 'cam-' || cam AS sequence, begun AS t_ms, 'zone.entered' AS kind, u AS track_id, CASE WHEN island = 1 THEN 'appeared' ELSE 'crossed' END AS how FROM k WHERE state = 1 AND was = -1
UNION ALL SELECT 'cam-' || cam, begun, 'zone.exited', u, 'crossed' FROM k WHERE state = -1 AND was = 1 UNION ALL SELECT 'cam-' || cam, t, 'zone.exited', u, 'lost' FROM k WHERE state = 1 AND nx IS NULL"""

QUERIES = {
    f.__name__: f
    for f in (source_health, edge_agents, heartbeat_upsert, gated_scores, noise_report, best_setting, incident_list, occupancy_errors, ignored_tracks, queue_lengths, clock_ticks, routed_rules, floor_table, floor_queues, queue_registers, dropped_late, precision_recall_at, zone_stays)
}
SQL = {
    "source_health": _HEALTH, "edge_agents": _AGENTS,
    "heartbeat_upsert": f"SELECT user_id, event_type, max({_MS}) AS t_ms, arg_max(value, ({_MS}, event_id)) AS value FROM events GROUP BY 1, 2",
    "gated_scores": _GATED, "noise_report": _DROPS,
    "best_setting": f"WITH {_SCORES} SELECT scenario, rule_id, n_recall FROM s ORDER BY n_recall < 10, n_recall % 10 DESC, scenario, rule_id LIMIT 1",
    "incident_list": f"SELECT event_id AS incident_id, {_MS} AS detected_ms FROM events WHERE (props->>'k')::INT % 2 = 0 AND event_type IN ('view', 'click') AND user_id % 5 = 3 ORDER BY detected_ms DESC, incident_id LIMIT 200",
    "dropped_late": f"WITH {_EV} SELECT split_part(who, '|', 1) AS store_id, count(*) FILTER (late) AS late FROM late GROUP BY who",
    "routed_rules": f"SELECT 'enforce' AS mode, 'R-QUEUE-001' AS rule_id, count(*) AS n FROM ({_QUEUE}) UNION ALL SELECT 'shadow', 'R-DWELL-001', count(*) FROM ({_DWELL})",
    "occupancy_errors": _OCC, "ignored_tracks": _IGNORED, "queue_lengths": _LENGTHS,
    "clock_ticks": f"WITH s AS (SELECT user_id % 3 AS c, min({_MS}) AS a, max({_MS}) AS b FROM events GROUP BY 1) SELECT 'c' || c AS sequence, i::INT AS seq, (a + i * 3600000) AS t_ms FROM (SELECT c, a, unnest(range(0, (b - a) // 3600000 + 1)) AS i FROM s)",
    "floor_table": _FLOOR, "floor_queues": _QUEUES, "queue_registers": _REGISTERS, "precision_recall_at": _PR, "zone_stays": _STAYS,
}
