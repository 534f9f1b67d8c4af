"""Queries that write the driver's tables in a source's format and scan them again, with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.operators import ingest
from aislewise.plans import proxies as P
from aislewise.plans.proxies import table
from aislewise.plans.vision_queries import boxes
from aislewise.sources import files, kafka, polling


def csv_scan(spark, d):
    """Customers as one semicolon file, read in its order with row numbers."""
    path = P.scratch(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("Segment Name")).repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").write.csv(path, header=True, sep=";")
    rows = files.read_csv(spark, path, ["c_custkey", "Segment Name"], sep=";")
    least = rows.groupBy("_file").agg(F.min(F.col("c_custkey").cast("long")).alias("_from"))
    return rows.join(least, "_file").select("c_custkey", "c_name", F.col("Segment Name").alias("segment"), (F.col("c_custkey").cast("long") - F.col("_from") + 2 == F.col("_row")).alias("in_place"))


def json_document_scan(spark, d):
    """Nations as the array at a dotted path of one document (S3)."""
    path = P.scratch(spark, "json")
    doc = table(spark, d, "nation").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows")).alias("data"))).alias("value"))  # a fixed list of countries
    doc.coalesce(1).write.text(path)
    return files.read_json_document(spark, path, "n_nationkey long, n_name string", "data.rows")


def ndjson_scan(spark, d):
    """Customers as JSON lines of which every tenth is cut off: that line is a row with an error."""
    path = P.scratch(spark, "ndjson")
    c = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name")).alias("value"))
    c.select(F.when(F.col("c_custkey") % 10 == 0, F.left("value", F.lit(9))).otherwise(F.col("value")).alias("value")).write.text(path)
    rows = files.read_ndjson(spark, path, "c_custkey long, c_name string")
    return rows.groupBy(F.col("_error").isNotNull().alias("bad"), "c_custkey", "c_name").agg(F.count("*").alias("n"))


def event_log_scan(spark, d):
    """Events as JSON lines, read as envelopes whose data stays text."""
    path = P.scratch(spark, "log")
    e = P.events(spark, d)
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("com.retail."), "event_type").alias("type"), F.col("user_id").cast("string").alias("storeid"), F.struct(F.col("value").alias("v"), F.col("k").alias("k")).alias("data")))
    e.select(line.alias("value")).write.text(path)
    rows = files.read_events(spark, path)
    return rows.select("id", "type", "storeid", F.get_json_object("data", "$.k").cast("long").alias("k"), F.col("simrunid").isNull().alias("live"))


def count_truth_scan(spark, d):
    """Counts by second and zone as CSV."""
    path = P.scratch(spark, "counts")
    e = P.events(spark, d)
    e.groupBy((F.floor(F.col("t_ms") / 3_600_000) * 3600).cast("double").alias("offset_s"), F.concat(F.lit("z"), F.col("user_id") % 3).alias("zone")).agg(F.count("*").alias("count")).write.csv(path, header=True)
    return files.read_count_truth(spark, path)


def track_files(spark, d):
    """Tracks written with what they were measured with, and read by sequence."""
    path = P.scratch(spark, "tracks")
    files.write_tracks(boxes(spark, d).select("sequence", "frame", "track_id", "x1", "y1"), path, {"detector": "none", "version": "1"})
    return files.read_tracks(spark, path).groupBy("sequence", "meta_detector", "meta_version").agg(F.count("*").alias("n"), F.round(F.sum("x1"), 3).alias("x"), F.sum("track_id").alias("tracks"))


def mot_truth_scan(spark, d):
    """Ground-truth text files of four recordings, split into people and regions to ignore."""
    base = P.scratch(spark, "mot")
    b = boxes(spark, d).select("sequence", "frame", "track_id", F.round("x1", 3).alias("x"), F.round("y1", 3).alias("y"), F.lit(20.0).alias("w"), F.lit(40.0).alias("h"), (F.col("det_id") % 5 > 0).cast("int").alias("consider"), (F.col("det_id") % 9).cast("int").alias("cls"), (F.col("det_id") % 4 / 4).alias("visibility"))
    for sequence in ("cam-0", "cam-1", "cam-2", "cam-3"):
        b.where(F.col("sequence") == sequence).drop("sequence").write.csv(f"{base}/{sequence}/gt")
    people, ignored = files.read_mot_truth(spark, f"{base}/*/gt")
    count = lambda df, kind: df.groupBy("sequence", F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x2") - F.col("x1")), 3).alias("width"), F.sum("track_id").alias("tracks"))
    return count(people, "people").union(count(ignored, "ignored"))


_MOT = """WITH b AS (SELECT 'cam-' || (label % 4) AS sequence, vec_id AS det, vec_id % 8 AS track_id, vec_id % 9 AS cls, vec_id % 5 > 0 AS consider, (vec_id % 4) / 4.0 AS vis FROM embeddings),
k AS (SELECT *, CASE WHEN cls = 1 AND consider AND vis >= 0.25 THEN 'people' WHEN cls IN (1, 2, 7, 8, 12) THEN 'ignored' END AS kind FROM b)
SELECT sequence, kind, count(*) AS n, round(20.0 * count(*), 3)::DOUBLE AS width, sum(track_id)::BIGINT AS tracks FROM k WHERE kind IS NOT NULL GROUP BY 1, 2"""


def voucher_scan(spark, d):
    """Suppliers' day book as XML vouchers: item lines of bills and credit notes."""
    path = P.scratch(spark, "xml")
    s = table(spark, d, "supplier")
    kind = F.element_at(F.array(*map(F.lit, ("Sales", "Credit Note", "Receipt", "Memo"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    item = lambda k: F.struct(F.concat(F.lit(f"item {k} of "), "s_name").alias("STOCKITEMNAME"), F.concat(F.lit(" 1,"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), F.lit(".5 kg")).alias("ACTUALQTY"), F.format_string("-%.2f", F.abs("s_acctbal") + k).alias("AMOUNT"))
    v = s.select(kind.alias("VOUCHERTYPENAME"), F.col("s_suppkey").cast("string").alias("VOUCHERNUMBER"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int")), "yyyyMMdd").alias("DATE"), F.array(item(1), item(2)).alias("ALLINVENTORYENTRIES.LIST"))
    v.write.option("rowTag", "VOUCHER").option("rootTag", "ENVELOPE").format("xml").save(path)
    return polling.voucher_lines(polling.read_vouchers(spark, path))


_VOUCHERS = """SELECT s_suppkey::VARCHAR AS number, DATE '2024-01-01' + (s_suppkey % 300)::INT AS date, CASE s_suppkey % 4 WHEN 0 THEN 'bill' ELSE 'refund' END AS kind, k::INT AS line_no, 'item ' || k || ' of ' || s_name AS sku,
 (1000000 + (s_suppkey % 1000) * 1000 + 500)::BIGINT AS qty_milli, round((abs(s_acctbal) + k) * 100)::BIGINT AS amount_minor FROM supplier, (VALUES (1), (2)) v(k) WHERE s_suppkey % 4 < 2"""


def bill_export(spark, d):
    """Lines of bills that are not voided, as a till system exports them."""
    lines = P.sale_lines(spark, d).withColumn("voided", F.col("bill_ref").cast("long") % 3 == 0)
    out = files.export_bills(lines, P.ZONE)
    return out.select(*[F.col(c).alias(c.lower().replace(" ", "_")) for c in out.columns])


_EXPORT = """SELECT l_orderkey::VARCHAR AS bill_no, strftime(l_shipdate + INTERVAL 330 MINUTE, '%Y-%m-%d') AS date, strftime(l_shipdate + INTERVAL 330 MINUTE, '%H:%M:%S') AS time, 'till-' || (l_suppkey % 4) AS counter, l_linenumber AS line, l_partkey::VARCHAR AS item_code,
 round(l_quantity * 1000)::BIGINT / 1000.0::DOUBLE AS qty, 'pcs' AS unit, printf('%.2f', round(l_extendedprice * 100)::BIGINT / 100.0::DOUBLE) AS amount, printf('%.2f', round(l_extendedprice * l_tax * 100)::BIGINT / 100.0::DOUBLE) AS tax FROM lineitem WHERE l_orderkey % 3 <> 0"""


def log_retention(spark, d):
    """The event log by day of arrival, and the days past their retention."""
    path = P.scratch(spark, "retained")
    e = P.events(spark, d).select(F.col("user_id").cast("string").alias("store_id"), F.col("event_type").alias("type"), "t_ms", (F.col("t_ms") + F.col("k") * 1000).alias("received_ms"))
    files.write_log(e, path)
    log = spark.read.parquet(path)
    gone = files.expired_days(log, F.lit("2024-02-02").cast("date")).select("received_date", F.lit(True).alias("expired"))
    return log.groupBy("received_date").agg(F.count("*").alias("n")).join(gone, "received_date", "left").select("received_date", "n", F.coalesce("expired", F.lit(False)).alias("expired"))


def _box(spark, d):
    e = P.events(spark, d)
    state = F.when(F.col("event_id") % 5 < 3, "sent").when(F.col("event_id") % 5 == 3, "rejected").otherwise("pending")
    return e.select(F.concat(F.lit("s"), F.col("user_id") % 7).alias("source"), F.col("event_id").alias("sequence"), state.alias("state"), F.length("props").cast("long").alias("bytes"), F.when(F.col("event_id") % 997 == 4, 10).otherwise(F.col("k") % 4).cast("int").alias("tries"))


_BOX = """b AS (SELECT 's' || (user_id % 7) AS source, event_id AS sequence, CASE WHEN event_id % 5 < 3 THEN 'sent' WHEN event_id % 5 = 3 THEN 'rejected' ELSE 'pending' END AS state, length(props)::BIGINT AS bytes,
 CASE WHEN event_id % 997 = 4 THEN 10 ELSE (props->>'k')::INT % 4 END::INT AS tries FROM events)"""


def outbox_stats(spark, d):
    return files.outbox_stats(_box(spark, d))


def outbox_evictions(spark, d):
    """Sent rows that go to keep each source's box under 5 KB."""
    return files.outbox_evictions(_box(spark, d), 5_000)


_EVICT = f"""WITH {_BOX}, t AS (SELECT source, sum(bytes) AS total FROM b GROUP BY 1), s AS (SELECT source, sequence, coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM b WHERE state = 'sent')
SELECT source, sequence FROM s JOIN t USING (source) WHERE total - freed > 5000"""


def outbox_claims(spark, d):
    """Pending rows in relay order with their batches, up to each source's first dead row."""
    return files.outbox_claims(_box(spark, d), 50).select("source", "sequence", "batch_no")


_CLAIMS = f"""WITH {_BOX}, x AS (SELECT source, min(sequence) AS dead FROM b WHERE state = 'pending' AND tries >= 10 GROUP BY 1)
SELECT source, sequence, (row_number() OVER (PARTITION BY source ORDER BY sequence) - 1) // 50 AS batch_no FROM b LEFT JOIN x USING (source) WHERE state = 'pending' AND (dead IS NULL OR sequence < dead)"""


def relay_answers(spark, d):
    """The box after a relay that accepted every second row."""
    box = _box(spark, d)
    answers = box.where("sequence % 2 = 0 or sequence % 3 = 0").select("source", "sequence", (F.col("sequence") % 2 == 0).alias("ok"))
    return files.after_relay(box, answers).select("source", "sequence", "state", "tries")


_RELAY = f"WITH {_BOX} SELECT source, sequence, CASE WHEN state = 'pending' AND sequence % 2 = 0 THEN 'sent' ELSE state END AS state, tries + CASE WHEN state = 'pending' AND (sequence % 2 = 0 OR sequence % 3 = 0) THEN 1 ELSE 0 END AS tries FROM b"


def sql_poll_page(spark, d):
    """A page of 100 rows after a cursor, with the rows of an hour behind it again."""
    e = P.events(spark, d).select("event_id", "t_ms")
    return polling.cursor_page(e, "t_ms", 1_704_200_000_000, 100, 3_600_000)


_POLL = """WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t_ms FROM events), l AS (SELECT max(t_ms) AS m FROM (SELECT t_ms FROM e WHERE t_ms > 1704200000000 ORDER BY t_ms LIMIT 100))
SELECT event_id, t_ms FROM e, l WHERE t_ms > 1704200000000 - 3600000 AND t_ms <= coalesce(m, 1704200000000)"""


def latest_of_overlap(spark, d):
    """The last row per key of pages that overlap."""
    e = P.events(spark, d).select("user_id", "event_type", "event_id")
    return polling.latest_per(e, ["user_id", "event_type"], "event_id")


def rule_projection(spark, d):
    """Valid store events as rows of the rules."""
    from aislewise.plans.event_queries import envelopes

    e = ingest.validate(envelopes(spark, d).drop("t_ms"), F.lit(1_704_067_200_000 + 20 * 86_400_000).cast("long"))
    return ingest.rule_events(e.withColumn("arrival", F.col("id").cast("long"))).select("id", "type", "zone_id", "track_id", "queue_id", "length")


def kafka_envelopes(spark, d):
    """Events as topic records and back: event time from the payload, else from the record."""
    e = P.events(spark, d)
    sent = kafka.records(e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 5 > 0, F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("soon").alias("time"), F.col("props").alias("data")), F.col("id"))
    stored = sent.select(F.col("value").cast("binary").alias("value"), F.timestamp_millis(F.lit(1_700_000_000_000)).alias("timestamp"), F.lit(0).alias("partition"), F.col("key").cast("long").alias("offset"))
    return kafka.envelopes(stored).select("id", "type", F.unix_millis("event_time").alias("t_ms"), F.get_json_object("data", "$.k").cast("long").alias("k"), "arrival")


QUERIES = {
    f.__name__: f
    for f in (csv_scan, json_document_scan, ndjson_scan, event_log_scan, count_truth_scan, track_files, mot_truth_scan, voucher_scan, bill_export, log_retention, outbox_stats, outbox_evictions, outbox_claims, relay_answers, sql_poll_page, latest_of_overlap, rule_projection, kafka_envelopes)
}
SQL = {
    "csv_scan": "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment AS segment, true AS in_place FROM customer",
    "json_document_scan": "SELECT n_nationkey, n_name FROM nation",
    "ndjson_scan": "SELECT c_custkey % 10 = 0 AS bad, CASE WHEN c_custkey % 10 > 0 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey % 10 > 0 THEN c_name END AS c_name, count(*) AS n FROM customer GROUP BY 1, 2, 3",
    "event_log_scan": "SELECT event_id::VARCHAR AS id, 'com.retail.' || event_type AS type, user_id::VARCHAR AS storeid, (props->>'k')::BIGINT AS k, true AS live FROM events",
    "count_truth_scan": "SELECT (epoch_us(ts) // 1000 // 3600000 * 3600)::DOUBLE AS offset_s, 'z' || (user_id % 3) AS zone, count(*) AS count FROM events GROUP BY 1, 2",
    "track_files": "SELECT 'cam-' || (label % 4) AS sequence, 'none' AS meta_detector, '1' AS meta_version, count(*) AS n, round(sum(embedding[1]::DOUBLE * 100 + 50), 3) AS x, sum(vec_id % 8)::BIGINT AS tracks FROM embeddings GROUP BY 1",
    "mot_truth_scan": _MOT, "voucher_scan": _VOUCHERS, "bill_export": _EXPORT,
    "log_retention": "SELECT r AS received_date, count(*) AS n, r < DATE '2024-02-02' - 30 AS expired FROM (SELECT make_timestamp(epoch_us(ts) // 1000 * 1000 + (props->>'k')::BIGINT * 1000000)::DATE AS r FROM events) GROUP BY 1",
    "outbox_stats": f"WITH {_BOX} SELECT source, state, count(*) AS rows, sum(bytes)::BIGINT AS bytes, min(sequence) AS first, max(sequence) AS last FROM b GROUP BY 1, 2",
    "outbox_evictions": _EVICT, "outbox_claims": _CLAIMS, "relay_answers": _RELAY, "sql_poll_page": _POLL,
    "rule_projection": """SELECT event_id::VARCHAR AS id, 'com.retail.store.queue.length' AS type, NULL::VARCHAR AS zone_id, NULL::VARCHAR AS track_id, 'q' || (user_id % 4) AS queue_id, (props->>'k')::INT AS length FROM events
 WHERE event_id % 13 > 0 AND event_id % 17 > 0 AND event_id % 19 > 0 AND event_id % 23 > 0 AND event_id % 29 > 0 AND event_id % 31 > 0 AND epoch_us(ts) // 1000 BETWEEN 1705795200000 - 86400000 AND 1705795200000 + 300000""",
    "kafka_envelopes": "SELECT event_id::VARCHAR AS id, event_type AS type, CASE WHEN event_id % 5 > 0 THEN epoch_us(ts) // 1000 ELSE 1700000000000 END AS t_ms, (props->>'k')::BIGINT AS k, event_id AS arrival FROM events",
    "latest_of_overlap": "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2",
}
