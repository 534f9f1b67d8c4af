"""Queries over billing import and ingest: profiles, formats, bills, stock deltas and typed tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions import geometry as G
from aislewise.operators import importer as I
from aislewise.operators import incidents, ingest
from aislewise.plans import proxies as P
from aislewise.plans.proxies import table

PROFILE = I.Profile(
    fields={"bill_no": "voucher.no", "date": "voucher.date", "till": "$.shop", "sku": "item", "qty": "qty", "amount": "amount"},
    values={"unit": {"a": "pcs", "n": "kg"}, "tender": {"1-urgent": "card", "2-high": "cash", "5-low": "upi"}}, zone="Asia/Kolkata", each="items",
)


def profile_extract(spark, d):
    """Each order as a document whose items are expanded: outer fields, dotted paths, blanks to null."""
    o = table(spark, d, "orders")
    item = lambda k: F.struct(F.concat(F.lit("i"), F.col("o_orderkey") + k).alias("item"), F.lit(k).alias("qty"), F.when(F.col("o_orderkey") % 7 == k, F.lit(" ")).otherwise(F.col("o_custkey").cast("string")).alias("amount"), F.struct(F.col("o_orderkey").alias("no"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("voucher"))
    record = F.to_json(F.struct(F.col("o_orderpriority").alias("shop"), F.array(item(1), item(2)).alias("items")))
    return I.extract(o.select(record.alias("record")), PROFILE).select("bill_no", "date", "till", "sku", "qty", "amount")


_EXTRACT = """SELECT o_orderkey::VARCHAR AS bill_no, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS till, 'i' || (o_orderkey + k) AS sku, k::VARCHAR AS qty,
 CASE WHEN o_orderkey % 7 = k THEN NULL ELSE o_custkey::VARCHAR END AS amount FROM orders, (VALUES (1), (2)) v(k)"""


def value_map(spark, d):
    """Order priorities through the tender map, with errors for unknown ones."""
    o = table(spark, d, "orders")
    value = F.concat(F.lit(" "), F.upper("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("  ")).otherwise(F.lit("")))
    out, error = I.mapped(PROFILE, "tender", value)
    return o.select("o_orderkey", out.alias("tender"), error.alias("error"))


_MAPPED = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN 'cash' WHEN '5-LOW' THEN 'upi' END AS tender,
 CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'unknown tender:  ' || upper(o_orderpriority) || CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE '' END END AS error FROM orders"""


def source_times(spark, d):
    """Event times of four source formats in the store's zone (F8)."""
    e = P.events(spark, d)
    text = lambda pattern: F.date_format(F.col("ts"), pattern)
    times = {
        "iso": I.event_time(PROFILE, text("yyyy-MM-dd"), text("HH:mm:ss")), "day": I.event_time(PROFILE, text("yyyy-MM-dd")),
        "zoned": I.event_time(PROFILE, F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))),
        "own": I.event_time(I.Profile({}, time_format="%d/%m/%Y %H:%M:%S"), text("dd/MM/yyyy"), text("HH:mm:ss")),
        "seconds": I.event_time(I.Profile({}, time_format="epoch_s"), (F.col("t_ms") / 1000).cast("decimal(20,3)").cast("string")),
        "bad": I.event_time(PROFILE, F.lit("no date"), text("HH:mm:ss")),
    }
    return e.select("event_id", *[c.alias(n) for n, c in times.items()])


_TIMES = """SELECT event_id, epoch_ms(date_trunc('second', ts)) - 19800000 AS iso, epoch_ms(date_trunc('day', ts) + INTERVAL 86399 SECOND) - 19800000 AS day, epoch_ms(date_trunc('second', ts)) - 7200000 AS zoned,
 epoch_ms(date_trunc('second', ts)) - 19800000 AS own, (epoch_us(ts) // 1000) AS seconds, NULL::BIGINT AS bad FROM events"""


def slugs_and_skus(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("  "), "p_name", F.lit(" / "), "p_type", F.lit(" #"), F.col("p_size"), F.lit("\t&b "))
    return p.select("p_partkey", I.slug(name).alias("slug"), I.sku(name).alias("sku"))


_SLUGS = r"""WITH n AS (SELECT p_partkey, '  ' || p_name || ' / ' || p_type || ' #' || p_size || chr(9) || '&b ' AS t FROM part)
SELECT p_partkey, substr(trim(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64) AS slug, substr(regexp_replace(regexp_replace(trim(t), '\s+', '-', 'g'), '[^A-Za-z0-9._-]', '', 'g'), 1, 64) AS sku FROM n"""


def _bill_rows(spark, d):
    """Lines of all orders as a source gives them: every eleventh line has an unreadable quantity, some bills repeat a line number."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("bill_no"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("time"), F.concat(F.lit("Till "), F.col("l_suppkey") % 4).alias("till"),
        F.col("l_linenumber").cast("string").alias("line_no"), F.concat(F.lit("p "), F.col("l_partkey")).alias("sku"), F.when(F.col("l_partkey") % 211 == 0, "many").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("qty"),
        F.col("l_returnflag").alias("unit"), F.format_string("%.2f", "l_extendedprice").alias("amount"), F.lit(None).cast("string").alias("tax"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_order"),
    ).withColumn("unit", F.when(F.col("unit").isin("A", "N"), F.col("unit")))


def _lines(spark, d):
    return I.bill_lines(_bill_rows(spark, d), PROFILE, b"secret")


def bill_line_rows(spark, d):
    """Source lines as canonical lines with what is wrong with each."""
    out = _lines(spark, d).select("bill_ref", F.col("_order").alias("place"), "till_id", "line_no", "sku", "t_ms", "qty_milli", "unit", "amount_minor", (F.col("error") != "").alias("bad"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("copies")).drop("bill_ref")  # a place has one bill, by which lines lie together


_L = """l AS (SELECT l_orderkey AS o, l_orderkey * 8 + l_linenumber AS place, 'till-' || (l_suppkey % 4) AS till_id, l_linenumber::INT AS line_no, 'p-' || l_partkey AS sku, epoch_ms(date_trunc('day', l_shipdate) + INTERVAL 86399 SECOND) - 19800000 AS t_ms,
 CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE l_quantity::INT * 1000 END::BIGINT AS qty_milli, CASE l_returnflag WHEN 'A' THEN 'pcs' WHEN 'N' THEN 'kg' ELSE 'pcs' END AS unit, round(l_extendedprice * 100)::BIGINT AS amount_minor, l_partkey % 211 = 0 AS bad FROM lineitem)"""
_LINE_ROWS = f"WITH {_L} SELECT place, till_id, line_no, sku, t_ms, qty_milli, unit, amount_minor, bad, count(*) AS copies FROM l GROUP BY ALL"


def _known(spark, d):
    """What an earlier import knows: orders whose key is even, with other contents where it is divisible by four."""
    lines = _lines(spark, d)
    first, _ = I.imported_bills(lines, spark.createDataFrame([], "bill_ref string, revision int, content string, total long, till_id string"))
    even = F.conv(F.substring("bill_ref", -1, 1), 16, 10).cast("int") % 2 == 0
    return first.where(even).select("bill_ref", F.lit(3).alias("revision"), F.when(F.col("total") % 2 == 0, F.col("content")).otherwise("other").alias("content"), (F.col("total") - 5).alias("total"), F.lit("till-9").alias("till_id"))


def bill_import(spark, d):
    """New, unchanged and revised bills of a second import by action, and bills held back by reason."""
    bills, held = I.imported_bills(_lines(spark, d), _known(spark, d))
    a = bills.groupBy("action").agg(F.count("*").alias("bills"), F.sum("total").alias("total"), F.sum("revision").alias("revisions"), F.sum(F.when(F.col("action") == "revised", F.col("void_amount"))).alias("voided"))
    return a.unionByName(held.groupBy(F.col("reason").alias("action")).agg(F.count("*").alias("bills")), allowMissingColumns=True)


def _hmac_blob(value: str) -> str:
    inner, outer = bytes(c ^ 0x36 for c in b"secret".ljust(64, b"\0")), bytes(c ^ 0x5C for c in b"secret".ljust(64, b"\0"))
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({value}))))"


_IMPORT = f"""WITH {_L}, b AS (SELECT o, count(*) FILTER (bad) AS bad, count(*) - count(DISTINCT line_no) AS again, sum(amount_minor)::BIGINT AS total FROM l GROUP BY 1),
r AS (SELECT *, ('0x' || substr({_hmac_blob('o::VARCHAR')}, 32, 1))::INT % 2 = 0 AS even FROM b),
a AS (SELECT CASE WHEN bad > 0 THEN 'a line is bad' WHEN again > 0 THEN 'repeated line numbers' WHEN NOT even THEN 'new' WHEN total % 2 = 0 THEN 'unchanged' ELSE 'revised' END AS action, * FROM r)
SELECT action, count(*) AS bills, CASE WHEN action IN ('new', 'unchanged', 'revised') THEN sum(total)::BIGINT END AS total,
 CASE action WHEN 'new' THEN 0 WHEN 'unchanged' THEN 3 * count(*) WHEN 'revised' THEN 4 * count(*) END::BIGINT AS revisions, CASE WHEN action = 'revised' THEN sum(total - 5)::BIGINT END AS voided FROM a GROUP BY action"""


def stock_deltas(spark, d):
    """Movements from a known stock to the new one: what was known is half of the quantity of each second item."""
    lines = _lines(spark, d)
    bills, _ = I.imported_bills(lines, spark.createDataFrame([], "bill_ref string, revision int, content string, total long, till_id string"))
    before = lines.where("error = ''").groupBy("bill_ref", "sku", "unit").agg((F.sum("qty_milli") * F.when(F.pmod(F.length("sku"), F.lit(2)) == 0, 2).otherwise(1)).alias("qty_milli"))
    out = I.stock_deltas(lines, bills, before.where(F.col("qty_milli") % 3000 > 0))
    return out.groupBy("sku", "unit", "direction", "reason").agg(F.count("*").alias("n"), F.sum("qty_milli").alias("qty_milli"))


_DELTAS = f"""WITH {_L}, ok AS (SELECT o FROM l GROUP BY o HAVING count(*) FILTER (bad) = 0 AND count(*) = count(DISTINCT line_no)), n AS (SELECT o, sku, unit, sum(qty_milli) AS q FROM l JOIN ok USING (o) GROUP BY ALL),
k AS (SELECT o, sku, unit, q * CASE WHEN length(sku) % 2 = 0 THEN 2 ELSE 1 END AS q FROM n WHERE (q * CASE WHEN length(sku) % 2 = 0 THEN 2 ELSE 1 END) % 3000 > 0),
e AS (SELECT sku, unit, coalesce(n.q, 0) - coalesce(k.q, 0) AS q FROM n FULL JOIN k USING (o, sku, unit))
SELECT sku, unit, CASE WHEN q > 0 THEN 'out' ELSE 'in' END AS direction, CASE WHEN q > 0 THEN 'sale' ELSE 'customer_return' END AS reason, count(*) AS n, sum(abs(q))::BIGINT AS qty_milli FROM e WHERE q <> 0 GROUP BY ALL"""


def numbered_payments(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("bill_ref"), F.substring("o_orderpriority", 1, 1).alias("tender"), F.lit("in").alias("direction"), F.floor(F.col("o_totalprice") / 100_000).cast("long").alias("amount_minor"), F.col("o_orderkey").alias("_order"))
    return I.numbered_payments(o).select(F.col("_order").alias("o_orderkey"), "payment_no", "occurrence")


_NUMBERED = """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS payment_no,
 row_number() OVER (PARTITION BY o_custkey, o_orderpriority[1], floor(o_totalprice / 100000) ORDER BY o_orderkey) AS occurrence FROM orders"""


def source_policy(spark, d):
    """Who may publish which source, and edge sources that name another store."""
    c = table(spark, d, "customer")
    client = F.concat(F.lit("c"), F.col("c_nationkey") % 4)
    source = F.concat(F.lit("urn:retail:"), F.when(F.col("c_custkey") % 2 == 0, "edge:").otherwise("till:"), F.lit("s"), F.col("c_custkey") % 5, F.lit(":"), "c_mktsegment")
    allowed = {"c0": ("urn:retail:edge:",), "c1": ("urn:retail:till:s1", "urn:retail:till:s2"), "c2": ()}
    store = F.concat(F.lit("s"), F.col("c_nationkey") % 5)
    return c.select("c_custkey", ingest.may_publish(client, source, allowed).alias("allowed"), ingest.edge_names_store(source, store).alias("own_store"))


_POLICY = """SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN c_custkey % 2 = 0 WHEN 1 THEN c_custkey % 2 = 1 AND c_custkey % 5 IN (1, 2) ELSE false END AS allowed,
 c_custkey % 2 = 1 OR c_custkey % 5 = c_nationkey % 5 AS own_store FROM customer"""


def _envelopes(spark, d):
    """Valid billing events of all lines: sale lines, and a payment for each first line."""
    li = table(spark, d, "lineitem")
    text = lambda c: c.cast("string")
    sale = F.struct(F.concat(F.lit("till-"), F.col("l_suppkey") % 4).alias("tillId"), F.col("l_orderkey").alias("billRef"), F.col("l_linenumber").alias("revision"), F.col("l_linenumber").alias("lineNo"), text(F.col("l_partkey")).alias("sku"), (F.col("l_quantity") * 1000).cast("long").alias("qtyMilli"), F.lit("pcs").alias("unit"), P.minor("l_extendedprice").alias("amountMinor"), F.col("l_returnflag").alias("currency"))
    pay = F.struct(F.concat(F.lit("till-"), F.col("l_suppkey") % 4).alias("tillId"), F.col("l_orderkey").alias("billRef"), F.lit(1).alias("paymentNo"), F.col("l_linestatus").alias("tender"), F.lit("in").alias("direction"), P.minor("l_extendedprice").alias("amountMinor"), F.col("l_returnflag").alias("currency"))
    first = F.col("l_linenumber") == 1
    return li.select(F.lit("s1").alias("storeid"), F.lit(None).cast("string").alias("simrunid"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("t_ms"), F.when(first, "pos.payment").otherwise("pos.sale.line").alias("short_type"), F.when(first, F.to_json(pay)).otherwise(F.to_json(sale)).alias("data"), F.col("l_orderkey").alias("arrival"), F.lit("urn:s").alias("source"))


def typed_tables(spark, d):
    """Rows and sums of the stored tables that billing events are routed to."""
    t = ingest.typed_tables(_envelopes(spark, d))
    one = lambda name: t[name].groupBy(F.lit(name).alias("name"), "till_id", "currency").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("amount_minor"), F.sum("t_ms").alias("t_ms"))
    return one("sale_lines").union(one("payments"))


_TYPED = """SELECT CASE WHEN l_linenumber = 1 THEN 'payments' ELSE 'sale_lines' END AS name, 'till-' || (l_suppkey % 4) AS till_id, l_returnflag AS currency, count(*) AS n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS amount_minor, sum(epoch_ms(l_shipdate))::BIGINT AS t_ms FROM lineitem GROUP BY ALL"""


def illegal_actions(spark, d):
    """Review rows that no allowed step leads to; orders of a customer are an incident's actions."""
    o = table(spark, d, "orders")
    action = F.element_at(F.array(*map(F.lit, ("ack", "confirm", "dismiss"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("ACKNOWLEDGED", "CONFIRMED", "DISMISSED"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return incidents.illegal_actions(o.select(F.col("o_custkey").alias("incident_id"), F.col("o_orderkey").alias("seq"), action.alias("action"), status.alias("status"))).select("incident_id", "seq", "was")


_ILLEGAL = """WITH a AS (SELECT o_custkey AS incident_id, o_orderkey AS seq, ['ACKNOWLEDGED', 'CONFIRMED', 'DISMISSED'][o_orderkey % 3 + 1] AS status FROM orders),
w AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY incident_id ORDER BY seq), 'OPEN') AS was FROM a)
SELECT incident_id, seq, was FROM w WHERE NOT (was = 'OPEN' OR (was = 'ACKNOWLEDGED' AND status <> 'ACKNOWLEDGED'))"""


def append_scores(spark, d):
    """Scores of runs and rules that are not stored yet."""
    e = P.events(spark, d).select((F.col("event_id") % 2000).alias("run_id"), F.concat(F.lit("R-"), F.col("user_id") % 5).alias("rule_id"), F.col("event_id"))
    return incidents.append_scores(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"))


_APPEND = """WITH e AS (SELECT event_id % 2000 AS run_id, 'R-' || (user_id % 5) AS rule_id, event_id FROM events)
SELECT * FROM e WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.event_id % 3 = 0 AND o.run_id = e.run_id AND o.rule_id = e.rule_id)"""



def review_round(spark, d):
    """Orders as review actions on customers' incidents, with versions and roles."""
    c = table(spark, d, "customer")
    own = c.where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("incident_id"), F.element_at(F.array(*map(F.lit, ("OPEN", "ACKNOWLEDGED", "AUTO_RESOLVED", "CONFIRMED"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("status"), (F.col("c_custkey") % 3).cast("int").alias("version"))
    o = table(spark, d, "orders")
    actions = o.select(F.col("o_custkey").alias("incident_id"), F.col("o_orderkey").alias("seq"), F.element_at(F.array(*map(F.lit, ("ack", "confirm", "dismiss"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("action"), F.when(F.col("o_orderkey") % 5 == 0, "viewer").otherwise("reviewer").alias("role"), (F.col("o_orderkey") % 4 % 3).cast("int").alias("expected_version"))
    return incidents.reviewed(own, actions)


_REVIEWS = """WITH i AS (SELECT c_custkey AS k, ['OPEN', 'ACKNOWLEDGED', 'AUTO_RESOLVED', 'CONFIRMED'][c_custkey % 4 + 1] AS status, (c_custkey % 3)::INT AS version FROM customer WHERE c_custkey % 7 > 0),
j AS (SELECT o_custkey AS incident_id, o_orderkey AS seq, ['ACKNOWLEDGED', 'CONFIRMED', 'DISMISSED'][o_orderkey % 3 + 1] AS becomes, o_orderkey % 5 > 0 AS reviewer, o_orderkey % 4 % 3 AS expected, status, version,
 coalesce(status IN ('OPEN', 'ACKNOWLEDGED', 'AUTO_RESOLVED') AND NOT (o_orderkey % 3 = 0 AND status <> 'OPEN'), false) AS legal FROM orders LEFT JOIN i ON k = o_custkey),
f AS (SELECT *, min(seq) FILTER (legal AND reviewer AND expected = version) OVER (PARTITION BY incident_id) AS first FROM j),
r AS (SELECT *, CASE WHEN version IS NULL THEN 'UNKNOWN' WHEN legal AND reviewer AND expected = version AND seq = first THEN 'APPLIED' WHEN expected <> version OR seq > first THEN 'CONFLICT' WHEN NOT legal THEN 'ILLEGAL' ELSE 'FORBIDDEN' END AS result FROM f)
SELECT incident_id, seq, result, version + (result = 'APPLIED')::INT AS version, CASE WHEN result = 'APPLIED' THEN becomes ELSE status END AS status FROM r"""


def api_rows(spark, d):
    """Latest events of a store with the field formats of the API."""
    e = P.events(spark, d).select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("com.retail."), "event_type").alias("type"), "t_ms", F.concat(F.lit("urn:retail:edge:"), F.col("user_id") % 9).alias("source"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("storeid"), F.col("props").alias("data"), F.col("event_id").alias("arrival"))
    return incidents.api_rows(e, "com.retail.", "s1", 100)


_API = """SELECT event_id::VARCHAR AS id, event_type AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS time, (user_id % 9)::VARCHAR AS source, props AS data FROM events WHERE user_id % 3 = 1 ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC LIMIT 100"""

H = ((1.5, 0.2, 3.0), (-0.1, 2.0, 1.0), (0.001, 0.002, 1.0))


def floor_positions(spark, d):
    """Image points of all vectors on the floor plan."""
    e = table(spark, d, "embeddings").select("vec_id", (F.element_at("embedding", 1).cast("double") * 100).alias("x"), (F.element_at("embedding", 2).cast("double") * 100).alias("y"))
    x, y = G.apply_homography(H, F.col("x"), F.col("y"))
    return e.select("vec_id", F.round(x, 6).alias("fx"), F.round(y, 6).alias("fy"))


_FLOOR = """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings), w AS (SELECT *, 0.001 * x + 0.002 * y + 1 AS w FROM e)
SELECT vec_id, round((1.5 * x + 0.2 * y + 3) / w, 6) AS fx, round((-0.1 * x + 2 * y + 1) / w, 6) AS fy FROM w"""

QUERIES = {
    f.__name__: f
    for f in (profile_extract, value_map, source_times, slugs_and_skus, bill_line_rows, bill_import, stock_deltas, numbered_payments, source_policy, typed_tables, illegal_actions, append_scores, floor_positions, review_round, api_rows)
}
SQL = {
    "profile_extract": _EXTRACT, "value_map": _MAPPED, "source_times": _TIMES, "slugs_and_skus": _SLUGS, "bill_line_rows": _LINE_ROWS, "bill_import": _IMPORT, "stock_deltas": _DELTAS, "numbered_payments": _NUMBERED,
    "source_policy": _POLICY, "typed_tables": _TYPED, "illegal_actions": _ILLEGAL, "append_scores": _APPEND, "floor_positions": _FLOOR,
    "review_round": _REVIEWS, "api_rows": _API,
}
