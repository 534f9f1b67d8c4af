"""Queries over boxes, tracks and zones made from the embeddings, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions import geometry as G
from aislewise.operators import tracking as T
from aislewise.plans.proxies import table

ZONES = {"left": [(-0.4, -0.4), (0.0, -0.4), (0.0, 0.4), (-0.4, 0.4)], "tip": [(0.0, 0.0), (0.3, -0.3), (0.3, 0.3)]}


def boxes(spark, d, start: int = 1):
    """A box per vector: its first components give the corner and size; 8 vectors make a frame, labels are sequences."""
    e = table(spark, d, "embeddings")
    at = lambda i: F.element_at("embedding", start + i).cast("double")
    x, y = at(0) * 100 + 50, at(1) * 100 + 50
    return e.select(F.concat(F.lit("cam-"), F.col("label") % 4).alias("sequence"), F.floor(F.col("vec_id") / 8).alias("frame"), (F.floor(F.col("vec_id") / 8) * 100).alias("t_ms"), F.col("vec_id").alias("det_id"), (F.col("vec_id") % 8).alias("track_id"), F.lit("person").alias("cls"), x.alias("x1"), y.alias("y1"), (x + 20 + F.abs(at(2)) * 50).alias("x2"), (y + 20 + F.abs(at(3)) * 50).alias("y2"), (F.abs(at(4)) * 2).alias("score"))


_BOXES = """b AS (SELECT 'cam-' || (label % 4) AS sequence, vec_id // 8 AS frame, vec_id AS det_id, embedding[1]::DOUBLE * 100 + 50 AS x1, embedding[2]::DOUBLE * 100 + 50 AS y1,
 embedding[1]::DOUBLE * 100 + 50 + 20 + abs(embedding[3]::DOUBLE) * 50 AS x2, embedding[2]::DOUBLE * 100 + 50 + 20 + abs(embedding[4]::DOUBLE) * 50 AS y2, abs(embedding[5]::DOUBLE) * 2 AS score FROM embeddings)"""


def iou_pairs(spark, d):
    b = boxes(spark, d).select("sequence", "frame", "det_id", "x1", "y1", "x2", "y2")
    return T.iou_pairs(b, b, 0.1).where("a_det_id < b_det_id").select("sequence", "frame", F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"), F.round("iou", 9).alias("iou"))


def nms(spark, d):
    return T.nms(boxes(spark, d), 0.3).select("sequence", "frame", "det_id", F.round("score", 9).alias("score"))


def point_in_polygon_counts(spark, d):
    e = table(spark, d, "embeddings")
    points = e.select(F.lit("cam").alias("sequence"), (F.col("vec_id") % 20).alias("frame"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return T.zone_counts(points, ZONES)


def edge_distances(spark, d):
    e = table(spark, d, "embeddings")
    x, y = F.element_at("embedding", 1).cast("double"), F.element_at("embedding", 2).cast("double")
    return e.select("vec_id", F.round(G.edge_distance(x, y, ZONES["left"]), 9).alias("depth"))


def average_precision(spark, d):
    """Detections found by label: a labelled document is a truth, its score a share of its length."""
    lab = table(spark, d, "labels")
    m = lab.select(F.concat(F.lit("t"), F.col("toxic")).alias("sequence"), (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("score"), F.col("quality").alias("tp"), F.col("doc_id").alias("det_id"), F.lit(0).alias("frame"))
    n = m.groupBy("sequence").agg((F.sum("tp") + 5).alias("n"))
    return T.average_precision(m, n).withColumn("ap", F.round("ap", 9))


_AP = """WITH m AS (SELECT 't' || toxic AS sequence, doc_id * 7919 % 1000 / 1000.0::DOUBLE AS score, quality AS tp, doc_id FROM labels),
p AS (SELECT *, sum(tp) OVER w::DOUBLE / row_number() OVER w AS pr, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY sequence ORDER BY score DESC, doc_id)),
q AS (SELECT *, max(pr) OVER (PARTITION BY sequence ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM p)
SELECT sequence, round(coalesce(sum(best) FILTER (tp = 1), 0) / (sum(tp) + 5), 9) AS ap FROM q GROUP BY 1"""


def _truth_and_tracks(spark, d):
    b = boxes(spark, d).select("sequence", "frame", "t_ms", "track_id", "x1", "y1", "x2", "y2")
    moved = b.where("(frame + track_id) % 6 <> 0").withColumns({"x1": F.col("x1") + 2, "x2": F.col("x2") + 2, "track_id": F.when((F.col("frame") > 20) & (F.col("track_id") == 3), 30).otherwise(F.col("track_id"))})
    return b, moved


def clear_mot(spark, d):
    return T.clear_mot(*_truth_and_tracks(spark, d))


def identity_f1(spark, d):
    return T.identity_f1(*_truth_and_tracks(spark, d)).withColumn("idf1", F.round("idf1", 9))


def hota(spark, d):
    return T.hota(*_truth_and_tracks(spark, d)).withColumns({c: F.round(c, 9) for c in ("hota", "det_a", "ass_a")})


def sequence_noise(spark, d):
    return T.sequence_noise(*_truth_and_tracks(spark, d))


def byte_track(spark, d):
    return T.byte_track(boxes(spark, d).withColumn("score", F.least(F.lit(1.0), F.col("score") + 0.5)))


def best_zone(spark, d):
    points = boxes(spark, d).select("frame", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return T.best_zone(points, 100, 100, 5, 2, 4)


def zone_events(spark, d):
    """Zone and queue events of all users over 64 cameras, with hand-overs."""
    from aislewise.plans.report_queries import walks

    zone = T.Zone("z", ((2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)), "q", (5.0, 5.0), 2.0)
    return T.zone_events(walks(spark, d), (zone,), T.Membership(enter_s=0, exit_s=0, lost_s=86_400.0, min_dwell_s=0, max_speed=1e9, handover_s=7200.0))


_AREA = "greatest(0, least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1)) * greatest(0, least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1))"
_SIZE = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_NMS = f"""WITH RECURSIVE {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY sequence, frame ORDER BY score DESC, det_id) AS n FROM b),
k AS (SELECT sequence, frame, 1 AS n, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det_id': det_id, 'score': score}}] AS kept FROM r WHERE n = 1 UNION ALL
 SELECT r.sequence, r.frame, r.n::INT, CASE WHEN len(list_filter(kept, lambda q: {_AREA.format('q', 'r')} / ({_SIZE.format('q')} + {_SIZE.format('r')} - {_AREA.format('q', 'r')}) > 0.3)) = 0
  THEN list_append(kept, {{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2, 'det_id': r.det_id, 'score': r.score}}) ELSE kept END FROM k JOIN r ON r.sequence = k.sequence AND r.frame = k.frame AND r.n = k.n + 1),
l AS (SELECT sequence, frame, arg_max(kept, n) AS kept FROM k GROUP BY 1, 2), u AS (SELECT sequence, frame, unnest(kept) AS q FROM l) SELECT sequence, frame, q.det_id AS det_id, round(q.score, 9) AS score FROM u"""
_NOISE = f"""WITH {_BOXES}, t AS (SELECT *, det_id % 8 AS track_id FROM b), m AS (SELECT sequence, frame, CASE WHEN frame > 20 AND track_id = 3 THEN 30 ELSE track_id END AS track_id, x1 + 2 AS x1, y1, x2 + 2 AS x2, y2 FROM t WHERE (frame + track_id) % 6 <> 0),
p AS (SELECT a.sequence, a.frame, a.track_id, q.track_id AS other, {_AREA.format('a', 'q')} / ({_SIZE.format('a')} + {_SIZE.format('q')} - {_AREA.format('a', 'q')}) AS iou FROM t a JOIN m q ON a.sequence = q.sequence AND a.frame = q.frame),
x AS (SELECT sequence, frame, track_id, arg_max(other, (iou, -other)) AS matched FROM p WHERE iou > 0.5 - 1e-9 GROUP BY 1, 2, 3),
r AS (SELECT t.sequence, t.frame, t.track_id, matched, last_value(matched IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls, lag(matched) OVER w AS pv FROM t LEFT JOIN x USING (sequence, frame, track_id) WINDOW w AS (PARTITION BY t.sequence, t.track_id ORDER BY t.frame))
SELECT sequence, track_id, count(*) AS frames, count(*) FILTER (matched IS NULL) AS misses, count(*) FILTER (matched <> ls) AS switches, count(*) FILTER (matched IS NOT NULL AND pv IS NULL AND ls IS NOT NULL) AS fragments FROM r GROUP BY 1, 2"""
_BEST = f"""WITH {_BOXES}, c AS (SELECT frame, least(4, floor(x1 * 5 / 100))::INT AS cx, least(4, floor(y1 * 5 / 100))::INT AS cy FROM b), i AS (SELECT range::INT AS v FROM range(5)),
q AS (SELECT a.v AS x0, c.v AS y0, b.v AS x1, d.v AS y1 FROM i a JOIN i b ON a.v <= b.v CROSS JOIN i c JOIN i d ON c.v <= d.v),
n AS (SELECT x0, y0, x1, y1, frame, count(*) AS n FROM c JOIN q ON cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY ALL)
SELECT * FROM (SELECT x0, y0, x1, y1, count(*) FILTER (n BETWEEN 2 AND 4) AS good FROM n GROUP BY ALL) ORDER BY good DESC, (x1 - x0 + 1) * (y1 - y0 + 1), x0, y0, x1, y1 LIMIT 1"""
_TRACKS = f"""{_BOXES}, t AS (SELECT *, det_id % 8 AS track_id FROM b), m AS (SELECT sequence, frame, CASE WHEN frame > 20 AND track_id = 3 THEN 30 ELSE track_id END AS track_id, x1 + 2 AS x1, y1, x2 + 2 AS x2, y2 FROM t WHERE (frame + track_id) % 6 <> 0),
p AS (SELECT a.sequence, a.frame, a.track_id AS gt, q.track_id AS tr, {_AREA.format('a', 'q')} / ({_SIZE.format('a')} + {_SIZE.format('q')} - {_AREA.format('a', 'q')}) AS iou FROM t a JOIN m q ON a.sequence = q.sequence AND a.frame = q.frame),
gn AS (SELECT sequence, track_id AS gt, count(*) AS gt_n FROM t GROUP BY 1, 2), tn AS (SELECT sequence, track_id AS tr, count(*) AS tr_n FROM m GROUP BY 1, 2)"""


def _assigned(name: str, key: str, weight: str) -> str:
    """CTEs that end in {name}8: for each key and set of used tracks the heaviest choice, the eight true persons one after the other."""
    first = f"{name}0 AS (SELECT DISTINCT {key}, 0 AS used, 0.0::DOUBLE AS total, []::STRUCT(gt BIGINT, tr BIGINT, iou DOUBLE)[] AS picks FROM {name})"
    step = f"""{{n}} AS (SELECT {key}, used, max(total) AS total, arg_max(picks, total) AS picks FROM (SELECT * FROM {{b}} UNION ALL
 SELECT {key}, used + bit, total + {weight}, list_append(picks, {{{{'gt': gt, 'tr': tr, 'iou': iou}}}}) FROM {{b}} JOIN (SELECT *, 1 << CASE WHEN tr = 30 THEN 8 ELSE tr::INT END AS bit FROM {name} WHERE gt = {{g}}) c USING ({key}) WHERE used & bit = 0) GROUP BY {key}, used)"""
    return ", ".join([first, *[step.format(n=f"{name}{g + 1}", b=f"{name}{g}", g=g) for g in range(8)]])


_IDENTITY = f"""WITH {_TRACKS}, w AS (SELECT sequence, gt, tr, count(*)::DOUBLE AS iou FROM p WHERE iou >= 0.5 - 1e-9 GROUP BY 1, 2, 3), {_assigned('w', 'sequence', 'iou')},
i AS (SELECT sequence, max(total)::BIGINT AS idtp FROM w8 GROUP BY 1), g AS (SELECT sequence, sum(gt_n) AS g FROM gn GROUP BY 1), h AS (SELECT sequence, sum(tr_n) AS h FROM tn GROUP BY 1)
SELECT sequence, round(2 * coalesce(idtp, 0)::DOUBLE / greatest(g + h, 1), 9) AS idf1, coalesce(idtp, 0) AS idtp, (h - coalesce(idtp, 0))::BIGINT AS idfp, (g - coalesce(idtp, 0))::BIGINT AS idfn FROM g JOIN h USING (sequence) LEFT JOIN i USING (sequence)"""
_HOTA = f"""WITH {_TRACKS}, o AS (SELECT * FROM p WHERE iou > 0), f AS (SELECT *, sum(iou) OVER (PARTITION BY sequence, frame, gt) + sum(iou) OVER (PARTITION BY sequence, frame, tr) - iou AS u FROM o),
al AS (SELECT sequence, gt, tr, sum(iou / u) AS s, any_value(gt_n) AS gt_n, any_value(tr_n) AS tr_n FROM f JOIN gn USING (sequence, gt) JOIN tn USING (sequence, tr) GROUP BY 1, 2, 3),
w AS (SELECT sequence, frame, gt, tr, iou, s / (gt_n + tr_n - s) * iou AS score FROM o JOIN al USING (sequence, gt, tr)), {_assigned('w', 'sequence, frame', 'score')},
x AS (SELECT sequence, unnest(arg_max(picks, total)) AS k FROM w8 GROUP BY sequence, frame), l AS (SELECT (i * 0.05)::DOUBLE AS alpha FROM range(1, 20) r(i)),
hm AS (SELECT sequence, alpha, k.gt AS gt, k.tr AS tr, count(*) AS n FROM x JOIN l ON k.iou >= alpha - 1e-9 GROUP BY 1, 2, 3, 4),
ha AS (SELECT sequence, alpha, sum(n) AS tp, sum(n::DOUBLE * n / greatest(1, gt_n + tr_n - n)) AS s FROM hm JOIN gn USING (sequence, gt) JOIN tn USING (sequence, tr) GROUP BY 1, 2),
tt AS (SELECT sequence, alpha, g, h FROM (SELECT sequence, sum(gt_n) AS g FROM gn GROUP BY 1) JOIN (SELECT sequence, sum(tr_n) AS h FROM tn GROUP BY 1) USING (sequence) CROSS JOIN l),
v AS (SELECT sequence, coalesce(tp, 0)::DOUBLE / greatest(1, g + h - coalesce(tp, 0)) AS det, coalesce(s, 0) / greatest(1, coalesce(tp, 0)) AS ass FROM tt LEFT JOIN ha USING (sequence, alpha))
SELECT sequence, round(avg(sqrt(det * ass)), 9) AS hota, round(avg(det), 9) AS det_a, round(avg(ass), 9) AS ass_a FROM v GROUP BY 1"""
QUERIES = {f.__name__: f for f in (iou_pairs, nms, point_in_polygon_counts, edge_distances, average_precision, clear_mot, identity_f1, hota, sequence_noise, byte_track, best_zone, zone_events)}
SQL = {
    "iou_pairs": f"""WITH {_BOXES}, p AS (SELECT a.sequence, a.frame, a.det_id AS a, b.det_id AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
 FROM b a JOIN b ON a.sequence = b.sequence AND a.frame = b.frame AND a.det_id < b.det_id) SELECT sequence, frame, a, b, round(i / (s - i), 9) AS iou FROM p WHERE i / (s - i) > 0.1""",
    "point_in_polygon_counts": """WITH p AS (SELECT vec_id % 20 AS frame, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
 z AS (SELECT frame, 'left' AS zone_id FROM p WHERE x >= -0.4 AND x < 0 AND y >= -0.4 AND y < 0.4 UNION ALL SELECT frame, 'tip' FROM p WHERE x < 0.3 AND y >= -0.3 AND y < 0.3 AND x > abs(y)) SELECT 'cam' AS sequence, frame, zone_id, count(*) AS n FROM z GROUP BY 1, 2, 3""",
    "edge_distances": """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), q AS (SELECT *, x > -0.4 AND x < 0 AND y > -0.4 AND y < 0.4 AS inside FROM p)
 SELECT vec_id, round(CASE WHEN inside THEN least(x + 0.4, -x, y + 0.4, 0.4 - y) ELSE -sqrt(greatest(0, -0.4 - x, x) ** 2 + greatest(0, -0.4 - y, y - 0.4) ** 2) END, 9) AS depth FROM q""",
    "average_precision": _AP,
    "nms": _NMS,
    "sequence_noise": _NOISE,
    "best_zone": _BEST,
    "identity_f1": _IDENTITY,
    "hota": _HOTA,
}
SQL = {k: v for k, v in SQL.items() if v}
