"""Queries over sales, payments and stock, with their SQL."""

from __future__ import annotations

import hmac

from datetime import datetime

from pyspark.sql import functions as F

from aislewise.functions import buckets as B
from aislewise.functions import ids, money
from aislewise.operators import billing, reconcile
from aislewise.plans import proxies as P
from aislewise.plans.proxies import ZONE, table

FROM, TO = datetime(1996, 1, 1), datetime(1999, 1, 1)
_LINES = """lines AS (SELECT epoch_ms(l_shipdate) AS t_ms, 'till-' || (l_suppkey % 4) AS till_id, l_orderkey::VARCHAR AS bill_ref, l_linenumber AS revision, l_partkey,
 round(l_extendedprice * 100)::BIGINT AS amount, round(l_extendedprice * l_tax * 100)::BIGINT AS tax, l_returnflag AS currency FROM lineitem)"""
_DAY = "date_trunc('day', make_timestamp(({}) * 1000) + INTERVAL 330 MINUTE)"
_F, _T = "epoch_ms(TIMESTAMP '1996-01-01')", "epoch_ms(TIMESTAMP '1999-01-01')"


def _sales(spark, d, bucket="day", till=None):
    return billing.sales(P.sale_lines(spark, d), P.till_events(spark, d), FROM, TO, ZONE, bucket, till)


def _sales_sql(start: str, till: str = "") -> str:
    return f"""
WITH {_LINES}, touched AS (SELECT DISTINCT bill_ref FROM lines WHERE t_ms >= {_F} AND t_ms < {_T}),
latest AS (SELECT bill_ref, max(revision) AS revision FROM lines WHERE bill_ref IN (SELECT bill_ref FROM touched) GROUP BY 1),
voids AS (SELECT o_orderkey::VARCHAR AS bill_ref, o_orderkey % 7 + 1 AS revision FROM orders WHERE o_orderstatus = 'P'),
bill AS (SELECT l.bill_ref, l.currency, min(t_ms) AS t, min(till_id) AS till, sum(amount) AS amount, sum(tax) AS tax, count(*) AS n,
  EXISTS (SELECT 1 FROM voids v WHERE v.bill_ref = l.bill_ref AND v.revision = x.revision) AS voided
 FROM lines l JOIN latest x ON x.bill_ref = l.bill_ref AND x.revision = l.revision GROUP BY l.bill_ref, l.currency, x.revision)
SELECT {start.format('t')} AS bucket_start, currency, count(*) FILTER (NOT voided) AS bills, coalesce(sum(amount) FILTER (NOT voided), 0)::BIGINT AS sales_minor,
 coalesce(sum(tax) FILTER (NOT voided), 0)::BIGINT AS tax_minor, coalesce(sum(n) FILTER (NOT voided), 0)::BIGINT AS lines, count(*) FILTER (voided) AS voided_bills
FROM bill WHERE t >= {_F} AND t < {_T} {till} GROUP BY 1, 2"""


def _payments(spark, d):
    return billing.payments(P.payment_rows(spark, d), FROM, TO, ZONE)


_PAYMENTS = f"""SELECT {_DAY.format('epoch_ms(o_orderdate)')} AS bucket_start, 'INR' AS currency, o_orderpriority AS tender,
 coalesce(sum(a) FILTER (dir = 'in'), 0)::BIGINT AS in_minor, coalesce(sum(a) FILTER (dir = 'out'), 0)::BIGINT AS out_minor,
 (coalesce(sum(a) FILTER (dir = 'in'), 0) - coalesce(sum(a) FILTER (dir = 'out'), 0))::BIGINT AS net_minor, count(*) FILTER (dir = 'in') AS payments_in, count(*) FILTER (dir = 'out') AS payments_out
 FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS a, CASE WHEN o_orderstatus = 'F' THEN 'out' ELSE 'in' END AS dir FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01') GROUP BY 1, 2, 3"""


def payment_totals(spark, d):
    return billing.totals(_payments(spark, d), ["currency", "tender"], ["in_minor", "out_minor", "net_minor", "payments_in", "payments_out"])


def stock_page(spark, d):
    out = billing.stock_page(P.movements(spark, d), P.levels(spark, d), FROM, TO, "sku-00000010", 100)
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return out.withColumns({"in_by_reason": text("in_by_reason"), "out_by_reason": text("out_by_reason")})


_MOVES = """mv AS (SELECT epoch_ms(l_shipdate) AS t_ms, 'sku-' || lpad(l_partkey::VARCHAR, 8, '0') AS sku, CASE WHEN l_linestatus = 'F' THEN 'in' ELSE 'out' END AS dir, l_returnflag AS reason,
 round(l_quantity * 1000)::BIGINT AS qty, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
lv AS (SELECT epoch_ms(l_shipdate) AS t_ms, 'sku-' || lpad(l_partkey::VARCHAR, 8, '0') AS sku, round(l_quantity * 1000)::BIGINT AS qty, l_orderkey * 1000 + round(l_quantity)::BIGINT AS seq FROM lineitem WHERE l_linenumber = 1)"""
_STOCK = f"""
WITH {_MOVES}, m AS (SELECT * FROM mv WHERE t_ms >= {_F} AND t_ms < {_T}), k AS (SELECT * FROM lv WHERE t_ms < {_T}),
head AS (SELECT sku FROM (SELECT sku FROM m UNION SELECT sku FROM k) WHERE sku > 'sku-00000010' ORDER BY sku LIMIT 101),
page AS (SELECT sku FROM head ORDER BY sku LIMIT 100),
s AS (SELECT sku, dir, reason, sum(qty)::BIGINT AS qty, count(*) AS n FROM m JOIN page USING (sku) GROUP BY 1, 2, 3),
r AS (SELECT sku, coalesce(sum(qty) FILTER (dir = 'in'), 0)::BIGINT AS in_milli, coalesce(sum(qty) FILTER (dir = 'out'), 0)::BIGINT AS out_milli,
  coalesce(string_agg(reason || '=' || qty, ',' ORDER BY reason || '=' || qty) FILTER (dir = 'in'), '') AS in_by_reason,
  coalesce(string_agg(reason || '=' || qty, ',' ORDER BY reason || '=' || qty) FILTER (dir = 'out'), '') AS out_by_reason, sum(n)::BIGINT AS movements FROM s GROUP BY 1),
l AS (SELECT DISTINCT ON (sku) sku, qty AS level_milli, t_ms AS level_ms FROM k JOIN page USING (sku) ORDER BY sku, t_ms DESC, seq DESC)
SELECT coalesce(r.sku, l.sku) AS sku, 'pcs' AS unit, coalesce(in_milli, 0) AS in_milli, coalesce(out_milli, 0) AS out_milli, coalesce(in_by_reason, '') AS in_by_reason, coalesce(out_by_reason, '') AS out_by_reason,
 coalesce(movements, 0) AS movements, coalesce(in_milli, 0) - coalesce(out_milli, 0) AS net_milli, level_milli, level_ms,
 CASE WHEN (SELECT count(*) FROM head) > 100 THEN (SELECT max(sku) FROM page) END AS next_after
FROM r FULL JOIN l ON r.sku = l.sku"""


def stock_level_latest(spark, d):
    return billing.latest_levels(P.levels(spark, d), TO)


def keyset_page(spark, d):
    """A page of customers after a name, in byte order, one row more than asked for to see whether there are more (K3)."""
    return table(spark, d, "customer").where("c_name > 'Customer#000000010'").orderBy("c_name").limit(21).select("c_custkey", "c_name")


def union_distinct(spark, d):
    return P.movements(spark, d).where(billing.in_window(FROM, TO)).select("sku").union(P.levels(spark, d).select("sku")).distinct()


def day_totals(spark, d):
    """A reported day total per local day: what payments say, off by one per cent every seventh day."""
    p = P.payment_rows(spark, d).withColumn("day", B.local_date(B.from_ms(F.col("t_ms")), ZONE))
    per = p.groupBy("store_id", "day", "tender").agg(F.sum(F.when(F.col("direction") == "in", F.col("amount_minor")).otherwise(-F.col("amount_minor"))).alias("net"), F.sum(F.when(F.col("direction") == "out", F.col("amount_minor")).otherwise(0)).alias("refund"), F.count("*").alias("n"))
    one = per.groupBy("store_id", "day").agg(F.sum("net").alias("sales"), F.sum("refund").alias("refunds"), F.sum("n").alias("bills"), F.map_from_entries(F.collect_list(F.struct("tender", "net"))).alias("payments_by_tender"))
    skew = F.when(F.day("day") % 7 == 0, F.col("sales") + F.floor(F.col("sales") / 100)).otherwise(F.col("sales") + F.col("refunds"))
    return one.select("store_id", F.col("day").alias("business_date"), F.lit(0).cast("long").alias("t_ms"), skew.alias("sales_minor"), F.col("refunds").alias("refunds_minor"), "bills", "payments_by_tender")


def reconcile_daily(spark, d):
    lines = P.sale_lines(spark, d)
    return reconcile.checks(lines, P.till_events(spark, d), P.payment_rows(spark, d), day_totals(spark, d), ZONE)


_LD = "(make_timestamp(({}) * 1000) + INTERVAL 330 MINUTE)::DATE"
_RECONCILE = f"""
WITH {_LINES}, rev AS (SELECT {_LD.format('t_ms')} AS day, bill_ref, revision, sum(amount)::BIGINT AS a FROM lines GROUP BY 1, 2, 3),
top AS (SELECT * FROM rev QUALIFY revision = max(revision) OVER (PARTITION BY day, bill_ref)),
v AS (SELECT DISTINCT {_LD.format('epoch_ms(o_orderdate)')} AS day, o_orderkey::VARCHAR AS bill_ref, o_orderkey % 7 + 1 AS revision FROM orders WHERE o_orderstatus = 'P'),
sales AS (SELECT day, sum(a)::BIGINT AS sales, count(*) AS bills FROM top WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.day = top.day AND v.bill_ref = top.bill_ref AND v.revision = top.revision) GROUP BY 1),
pay AS (SELECT {_LD.format('epoch_ms(o_orderdate)')} AS day, o_orderpriority AS tender, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE round(o_totalprice * 100)::BIGINT END AS i, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 100)::BIGINT ELSE 0 END AS o FROM orders),
ten AS (SELECT day, tender, sum(i - o)::BIGINT AS net, sum(o)::BIGINT AS refund, count(*) AS n FROM pay GROUP BY 1, 2),
per AS (SELECT day, sum(net)::BIGINT AS net, sum(refund)::BIGINT AS refunds, sum(n)::BIGINT AS n FROM ten GROUP BY 1),
tot AS (SELECT day, CASE WHEN day(day) % 7 = 0 THEN net + floor(net / 100)::BIGINT ELSE net + refunds END AS ts, refunds AS tr, n AS tb FROM per),
j AS (SELECT coalesce(sales.day, per.day) AS day, coalesce(sales, 0) AS sales, coalesce(bills, 0) AS bills, coalesce(refunds, 0) AS refunds, coalesce(net, 0) AS net FROM sales FULL JOIN per ON sales.day = per.day),
c AS (SELECT j.day, 'lines_vs_payments' AS name, sales - refunds AS ours, net AS theirs, true AS ex FROM j
 UNION ALL SELECT j.day, 'sales', sales, ts, false FROM j JOIN tot USING (day) UNION ALL SELECT j.day, 'refunds', refunds, tr, false FROM j JOIN tot USING (day)
 UNION ALL SELECT j.day, 'bills', bills, tb, true FROM j JOIN tot USING (day) UNION ALL SELECT day, 'tender:' || tender, net, net, false FROM ten),
b AS (SELECT *, ours - theirs AS diff, greatest(abs(ours), abs(theirs)) AS base FROM c)
SELECT 's1' AS store_id, day, name, ours::BIGINT AS ours, theirs::BIGINT AS theirs, diff::BIGINT AS diff, CASE WHEN diff = 0 THEN 0.0 ELSE round_even(abs(diff) * 10000.0::DOUBLE / base, 1) END AS diff_bp,
 CASE WHEN ex THEN diff = 0 WHEN diff = 0 THEN true ELSE abs(diff) * 10000.0::DOUBLE / base <= 50 END AS ok FROM b"""


def unexplained_stock(spark, d):
    lv = P.levels(spark, d).select("store_id", "sku", "t_ms", F.col("seq").alias("order"), "qty_milli")
    mv = P.movements(spark, d).select("store_id", "sku", "t_ms", "order", "direction", "qty_milli")
    wide = lambda df: df.withColumns({"sku": F.concat(F.lit("g"), (F.substring("sku", 5, 8).cast("long") % 40).cast("string")), "order": F.col("order") * 1_000_000 + F.col("qty_milli")})
    return reconcile.unexplained_stock(wide(lv), wide(mv.withColumn("order", F.col("order") + 1_000_000_000)), ZONE)


_UNEXPLAINED = f"""
WITH {_MOVES}, r AS (SELECT 'g' || (substr(sku, 5)::BIGINT % 40) AS sku, {_LD.format('t_ms')} AS day, t_ms, seq * 1000000 + qty AS ord, 1 AS lev, qty FROM lv
 UNION ALL SELECT 'g' || (substr(sku, 5)::BIGINT % 40), {_LD.format('t_ms')}, t_ms, (ord + 1000000000) * 1000000 + qty, 0, CASE WHEN dir = 'in' THEN qty ELSE -qty END FROM mv),
n AS (SELECT *, sum(lev) OVER (PARTITION BY sku, day ORDER BY t_ms, ord) AS l FROM r),
g AS (SELECT sku, day, l, max(qty) FILTER (lev = 1) AS qty, max(t_ms) FILTER (lev = 1) AS at_ms, coalesce(sum(qty) FILTER (lev = 0), 0)::BIGINT AS moved FROM n GROUP BY 1, 2, 3),
s AS (SELECT *, lag(qty) OVER w AS f, lag(moved) OVER w AS m, lag(at_ms) OVER w AS fa FROM g WHERE l > 0 WINDOW w AS (PARTITION BY sku, day ORDER BY l))
SELECT 's1' AS store_id, sku, day, f AS from_milli, qty AS to_milli, m AS moved, (qty - f - m)::BIGINT AS unexplained_milli, fa AS from_ms, at_ms AS to_ms FROM s WHERE f IS NOT NULL AND qty - f <> m"""


def day_summary(spark, d):
    visitors = P.events(spark, d).where("event_type = 'view'").agg(F.count("*").alias("visitors"))
    return billing.day_summary(_sales(spark, d), _payments(spark, d).withColumn("currency", F.lit("A")), visitors, "A")


def main_currency(spark, d):
    return billing.main_currency(_sales(spark, d), _payments(spark, d))


def money_text(spark, d):
    """Amounts written in several styles and read back exactly."""
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0 or o_orderkey % 3 <> 0")
    cents = P.minor("o_totalprice")
    whole, rest = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    plain = F.concat(whole.cast("string"), F.lit("."), rest)
    style = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("("), plain, F.lit(")"))).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("INR "), F.format_number(whole, 0), F.lit("."), rest)).when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("-"), plain)).when(F.col("o_orderkey") % 5 == 3, F.concat(plain, F.lit(" Dr"))).otherwise(F.concat(F.lit("₹"), plain))
    value, error = money.to_minor(F.col("text"))
    amount, tax = money.line_amounts(F.col("o_orderkey") % 1000 + 5, F.col("o_custkey") % 5000 + 250, F.lit(1800))
    return o.withColumn("text", style).select("o_orderkey", value.alias("minor"), error.isNotNull().alias("refused"), amount.alias("amount"), tax.alias("tax"))


_MONEY = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN -c WHEN 1 THEN c WHEN 2 THEN -c WHEN 3 THEN NULL ELSE c END AS minor, o_orderkey % 5 = 3 AS refused,
 a AS amount, CASE WHEN (2 * a * 1800) % (2 * 11800) = 11800 THEN 2 * ((a * 1800 // 11800 + 1) // 2) ELSE (2 * a * 1800 + 11800) // (2 * 11800) END AS tax FROM
 (SELECT *, round(o_totalprice * 100)::BIGINT AS c, CASE WHEN x % 1000 = 500 THEN 2 * ((x // 1000 + 1) // 2) ELSE (x + 500) // 1000 END AS a FROM (SELECT *, (o_orderkey % 1000 + 5) * (o_custkey % 5000 + 250) AS x FROM orders))"""


def hmac_refs(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", ids.reference("bill", F.col("c_name"), b"secret").alias("bill_ref"), ids.daily_pseudonym(b"secret", F.lit("2024-01-02"), F.col("c_name")).alias("track"))


def uuid_ids(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", ids.name_uuid(F.concat(F.lit("R-QUEUE-001|1|s1|null|"), F.col("c_name"), F.lit("|17"))).alias("uuid3"), ids.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("c_name")).alias("uuid5"))


_UUIDS = """SELECT c_custkey, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || substr('89ab', ('0x' || substr(m, 17, 1))::INT % 4 + 1, 1) || substr(m, 18, 3) || '-' || substr(m, 21, 12) AS uuid3,
 substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', ('0x' || substr(s, 17, 1))::INT % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS uuid5
 FROM (SELECT c_custkey, md5('R-QUEUE-001|1|s1|null|' || c_name || '|17') AS m, sha1('\\x6b\\xa7\\xb8\\x10\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::BLOB || encode(c_name)) AS s FROM customer)"""

QUERIES = {
    "sales_latest_revision": _sales,
    "sales_hourly_till": lambda s, d: _sales(s, d, "hour", "till-1"),
    "payments_by_tender": _payments,
    "payment_totals": payment_totals,
    "stock_page": stock_page,
    "stock_level_latest": stock_level_latest,
    "keyset_page": keyset_page,
    "union_distinct": union_distinct,
    "reconcile_daily": reconcile_daily,
    "reconcile_stock": unexplained_stock,
    "day_summary": day_summary,
    "main_currency": main_currency,
    "money_text": money_text,
    "hmac_refs": hmac_refs,
    "uuid_ids": uuid_ids,
}
def _pads(secret: bytes) -> tuple[str, str]:
    return bytes(c ^ 0x36 for c in secret.ljust(64, b"\0")).hex(), bytes(c ^ 0x5C for c in secret.ljust(64, b"\0")).hex()


def _hmac_sql(secret: bytes, text: str) -> str:
    inner, outer = _pads(secret)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


_DAY_KEY = hmac.new(b"secret", b"2024-01-02", "sha256").digest()
_REFS = f"SELECT c_custkey, 'bill-' || substr({_hmac_sql(b'secret', 'c_name')}, 1, 32) AS bill_ref, 'trk-' || substr({_hmac_sql(_DAY_KEY, 'c_name')}, 1, 16) AS track FROM customer"
SQL = {
    "hmac_refs": _REFS,
    "sales_latest_revision": _sales_sql(_DAY),
    "sales_hourly_till": _sales_sql("date_trunc('hour', make_timestamp(({}) * 1000) + INTERVAL 330 MINUTE)", "AND till = 'till-1'"),
    "payments_by_tender": _PAYMENTS,
    "payment_totals": f"SELECT currency, tender, sum(in_minor)::BIGINT AS in_minor, sum(out_minor)::BIGINT AS out_minor, sum(net_minor)::BIGINT AS net_minor, sum(payments_in)::BIGINT AS payments_in, sum(payments_out)::BIGINT AS payments_out FROM ({_PAYMENTS}) GROUP BY 1, 2",
    "stock_page": _STOCK,
    "stock_level_latest": f"WITH {_MOVES} SELECT DISTINCT ON (sku) sku, 'pcs' AS unit, qty AS level_milli, t_ms AS level_ms FROM lv WHERE t_ms < {_T} ORDER BY sku, t_ms DESC, seq DESC",
    "keyset_page": "SELECT c_custkey, c_name FROM customer WHERE c_name > 'Customer#000000010' ORDER BY c_name LIMIT 21",
    "union_distinct": f"WITH {_MOVES} SELECT sku FROM mv WHERE t_ms >= {_F} AND t_ms < {_T} UNION SELECT sku FROM lv",
    "reconcile_daily": _RECONCILE,
    "reconcile_stock": _UNEXPLAINED,
    "day_summary": f"""WITH s AS ({_sales_sql(_DAY)}), p AS ({_PAYMENTS}), x AS (SELECT sum(bills)::BIGINT AS bills, sum(sales_minor)::BIGINT AS sales_minor FROM s WHERE currency = 'A'),
 y AS (SELECT sum(out_minor)::BIGINT AS refunds_minor, sum(net_minor)::BIGINT AS net_minor FROM p), z AS (SELECT count(*) AS visitors FROM events WHERE event_type = 'view')
 SELECT *, floor(bills * 1000.0::DOUBLE / visitors + 0.5) / 10.0::DOUBLE AS bills_per_100 FROM x, y, z""",
    "main_currency": f"WITH s AS ({_sales_sql(_DAY)}), p AS ({_PAYMENTS}) SELECT currency FROM (SELECT currency, abs(sales_minor) AS a FROM s UNION ALL SELECT currency, abs(net_minor) FROM p) GROUP BY 1 ORDER BY sum(a) DESC, currency LIMIT 1",
    "money_text": _MONEY,
    "uuid_ids": _UUIDS,
}
