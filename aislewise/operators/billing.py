"""Sales, payments and stock (R1, R2, R3 and the operators they are made of)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aislewise.functions import buckets as B
from aislewise.functions.shared import dealt_by


def _ms(t: datetime) -> int:
    return round((t - datetime(1970, 1, 1)).total_seconds() * 1000)


def in_window(start: datetime, end: datetime, column: str = "t_ms") -> Column:
    """Half-open window."""
    return (F.col(column) >= _ms(start)) & (F.col(column) < _ms(end))


def of_store(df: DataFrame, store: str | None, run: str | None) -> DataFrame:
    """Rows of one store and run; a null run is matched as a value (P5). store None: all stores, for batch reports."""
    return df if store is None else df.where((F.col("store_id") == store) & F.col("run_id").eqNullSafe(F.lit(run).cast("string")))


def latest_bills(lines: DataFrame, till_events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row per bill and currency at the bill's latest revision.

    Bills with any line in the window are looked at; their revision and lines come from all time. bill_time is the
    earliest line of that revision, till_id its smallest; voided if that very revision was voided. Lines and voids are
    dealt once by bill; revisions, voids and windows of a bill meet there.
    """
    key = ["store_id", "run_id", "bill_ref"]
    run = F.coalesce("run_id", F.lit("")).alias("run_id")  # a null run is a value
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    voids = till_events.where(F.col("kind") == "void").select("store_id", run, "bill_ref", "revision", none("string", "currency"), none("long", "t_ms"), none("string", "till_id"), none("long", "amount_minor"), none("long", "tax_minor"), F.lit(True).alias("void"))
    own = lines.select("store_id", run, "bill_ref", "revision", "currency", "t_ms", "till_id", "amount_minor", F.coalesce("tax_minor", F.lit(0)).alias("tax_minor"), F.lit(False).alias("void"))
    rows = dealt_by(own.unionByName(voids).where("store_id is not null and bill_ref is not null"), *key)
    per_revision = rows.groupBy(*key, "revision", "currency", "void").agg(
        F.min("t_ms").alias("bill_ms"), F.min("till_id").alias("till_id"), F.sum("amount_minor").alias("amount"), F.sum("tax_minor").alias("tax"), F.count("*").alias("lines"), F.coalesce(F.bool_or(in_window(start, end)), F.lit(False)).alias("_touched")
    )
    bill = W.partitionBy(*key)
    bills = per_revision.withColumn("voided", F.bool_or("void").over(W.partitionBy(*key, "revision")))
    bills = bills.withColumns({"_touched": F.bool_or("_touched").over(bill), "_latest": F.max(F.when(~F.col("void"), F.col("revision"))).over(bill)})
    bills = bills.where(~F.col("void") & F.col("_touched") & (F.col("revision") == F.col("_latest"))).drop("void", "_touched", "_latest")
    return bills.withColumn("run_id", F.nullif("run_id", F.lit("")))


def sales(lines: DataFrame, till_events: DataFrame, start: datetime, end: datetime, zone: str, bucket: str = "day", till_id: str | None = None) -> DataFrame:
    """Bills, sales, tax, lines and voided bills per local bucket and currency."""
    bills = latest_bills(lines, till_events, start, end).where(in_window(start, end, "bill_ms"))
    if till_id is not None:
        bills = bills.where(F.col("till_id") == till_id)
    good = ~F.col("voided")
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).cast("long")
    return bills.groupBy(B.local_bin(B.from_ms(F.col("bill_ms")), zone, bucket).alias("bucket_start"), "currency").agg(
        F.count_if(good).alias("bills"), total("amount").alias("sales_minor"), total("tax").alias("tax_minor"), total("lines").alias("lines"), F.count_if("voided").alias("voided_bills")
    )


def payments(rows: DataFrame, start: datetime, end: datetime, zone: str, bucket: str = "day", till_id: str | None = None) -> DataFrame:
    """Money in and out per local bucket, currency and tender (R2). Voids don't touch payments."""
    rows = rows.where(in_window(start, end))
    if till_id is not None:
        rows = rows.where(F.col("till_id") == till_id)
    into, out = F.col("direction") == "in", F.col("direction") == "out"
    amount = lambda d: F.coalesce(F.sum(F.when(d, F.col("amount_minor"))), F.lit(0)).cast("long")
    return rows.groupBy(B.local_bin(B.from_ms(F.col("t_ms")), zone, bucket).alias("bucket_start"), "currency", "tender").agg(
        amount(into).alias("in_minor"), amount(out).alias("out_minor"), (amount(into) - amount(out)).alias("net_minor"), F.count_if(into).alias("payments_in"), F.count_if(out).alias("payments_out")
    )


def totals(buckets: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Bucket rows added up per key."""
    return buckets.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def latest_levels(levels: DataFrame, end: datetime) -> DataFrame:
    """Latest level per sku and unit before the end; ties by arrival."""
    return levels.where(F.col("t_ms") < _ms(end)).groupBy("sku", "unit").agg(F.max_by(F.struct("qty_milli", "t_ms"), F.struct("t_ms", "seq")).alias("l")).select("sku", "unit", F.col("l.qty_milli").alias("level_milli"), F.col("l.t_ms").alias("level_ms"))


def stock_page(movements: DataFrame, levels: DataFrame, start: datetime, end: datetime, after: str | None, limit: int) -> DataFrame:
    """Movements in and out by reason, and the latest level, of the next `limit` skus in byte order.

    The page's skus are chosen first (a top-k of limit rows, joined by broadcast), so only their movements are summed.
    next_after is the sku to pass as `after` for the next page, null on the last one.
    """
    moved, known = movements.where(in_window(start, end)), levels.where(F.col("t_ms") < _ms(end))
    skus = moved.select("sku").union(known.select("sku")).distinct()
    if after is not None:
        skus = skus.where(F.col("sku") > after)
    head = skus.orderBy("sku").limit(limit + 1)
    page = head.orderBy("sku").limit(limit)
    more = head.agg((F.count("*") > limit).alias("more"), F.max("sku").alias("last"))
    page = F.broadcast(page)
    sums = moved.join(page, "sku").groupBy("sku", "unit", "direction", "reason").agg(F.sum("qty_milli").alias("qty"), F.count("*").alias("n"))
    by = lambda d: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("reason", "qty")))))  # noqa: E731  a row per reason
    total = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("qty"))), F.lit(0))
    rows = sums.groupBy("sku", "unit").agg(total("in").alias("in_milli"), total("out").alias("out_milli"), by("in").alias("in_by_reason"), by("out").alias("out_by_reason"), F.sum("n").alias("movements"))
    latest = latest_levels(known.join(page, "sku"), end)
    out = rows.join(latest, ["sku", "unit"], "full_outer").crossJoin(F.broadcast(more))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    empty = F.create_map().cast("map<string,bigint>")
    return out.select(
        "sku", "unit", zero("in_milli"), zero("out_milli"), F.coalesce("in_by_reason", empty).alias("in_by_reason"), F.coalesce("out_by_reason", empty).alias("out_by_reason"), zero("movements"),
        (F.coalesce("in_milli", F.lit(0)) - F.coalesce("out_milli", F.lit(0))).alias("net_milli"), "level_milli", "level_ms", F.when(F.col("more"), F.max("sku").over(_everything())).alias("next_after"),
    )


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # the rows of one page


def main_currency(sales_rows: DataFrame, payment_rows: DataFrame) -> DataFrame:
    """Currency with the largest sum of absolute amounts; ties by name."""
    both = sales_rows.select("currency", F.abs("sales_minor").alias("a")).union(payment_rows.select("currency", F.abs("net_minor")))
    return both.groupBy("currency").agg(F.sum("a").alias("a")).orderBy(F.desc("a"), "currency").limit(1).select("currency")


def day_summary(sales_rows: DataFrame, payment_rows: DataFrame, traffic_rows: DataFrame, currency: str) -> DataFrame:
    """bills, sales, refunds, net, visitors and bills per 100 visitors of one currency."""
    from aislewise.functions.money import per_hundred

    s = sales_rows.where(F.col("currency") == currency).agg(F.coalesce(F.sum("bills"), F.lit(0)).alias("bills"), F.coalesce(F.sum("sales_minor"), F.lit(0)).alias("sales_minor"))
    p = payment_rows.where(F.col("currency") == currency).agg(F.coalesce(F.sum("out_minor"), F.lit(0)).alias("refunds_minor"), F.coalesce(F.sum("net_minor"), F.lit(0)).alias("net_minor"))
    t = traffic_rows.agg(F.sum("visitors").alias("visitors"))
    one = s.crossJoin(p).crossJoin(t)  # three single rows
    return one.withColumn("bills_per_100", per_hundred(F.col("bills"), F.col("visitors")))
