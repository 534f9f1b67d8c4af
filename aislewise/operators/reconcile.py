"""Daily reconcile of lines, payments, day totals and stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aislewise.functions.buckets import from_ms, local_date
from aislewise.functions.money import basis_points
from aislewise.functions.shared import dealt_by

THRESHOLD_BP = 50


def _day(zone: str) -> Column:
    return local_date(from_ms(F.col("t_ms")), zone).alias("day")


def day_books(lines: DataFrame, voids: DataFrame, payments: DataFrame, zone: str) -> tuple[DataFrame, DataFrame]:
    """(sales and bills per store and day, paid in and out per store, day and tender).

    Every event belongs to its own local day: the top revision of a bill and its void are looked up inside the day.
    """
    key = ["store_id", "day", "bill_ref"]
    own = lines.select("store_id", _day(zone), "bill_ref", "revision", "amount_minor", F.lit(False).alias("void"))
    voided = voids.where("kind = 'void'").select("store_id", _day(zone), "bill_ref", F.coalesce("revision", F.lit(0)).alias("revision"), F.lit(None).cast("long").alias("amount_minor"), F.lit(True).alias("void"))
    rows = dealt_by(own.unionByName(voided.dropna(subset=key)), *key)  # lines and voids of a bill's day in one task
    revisions = rows.groupBy(*key, "revision").agg(F.sum("amount_minor").alias("amount"), F.bool_or("void").alias("void"), (~F.bool_and("void")).alias("lines"))
    order = F.when(F.col("lines"), F.col("revision"))
    top = revisions.groupBy(*key).agg(F.max_by("amount", order).alias("amount"), F.max_by("void", order).alias("void"), F.bool_or("lines").alias("lines"))
    sales = top.where(F.col("lines") & ~F.coalesce("void", F.lit(False))).groupBy("store_id", "day").agg(F.sum("amount").alias("sales"), F.count("*").alias("bills"))
    paid = payments.groupBy("store_id", _day(zone), "tender").agg(
        F.coalesce(F.sum(F.when(F.col("direction") == "in", F.col("amount_minor"))), F.lit(0)).alias("paid_in"),
        F.coalesce(F.sum(F.when(F.col("direction") != "in", F.col("amount_minor"))), F.lit(0)).alias("paid_out"),
    )
    return sales, paid


def checks(lines: DataFrame, voids: DataFrame, payments: DataFrame, day_totals: DataFrame, zone: str, threshold_bp: float = THRESHOLD_BP) -> DataFrame:
    """store_id, day, name, ours, theirs, diff, diff_bp, ok: one row per check of each day.

    lines_vs_payments and bills are exact; sales, refunds and tenders are within the threshold. Checks against day
    totals exist on days that report them.
    """
    sales, paid = day_books(lines, voids, payments, zone)
    per_day = paid.groupBy("store_id", "day").agg(F.sum("paid_out").alias("refunds"), F.sum(F.col("paid_in") - F.col("paid_out")).alias("net"))
    ours = sales.join(per_day, ["store_id", "day"], "full_outer").na.fill(0, ["sales", "bills", "refunds", "net"])
    totals = day_totals.groupBy("store_id", F.col("business_date").alias("day")).agg(*[F.max_by(c, "t_ms").alias(f"_{c}") for c in ("sales_minor", "refunds_minor", "bills", "payments_by_tender")])
    both = ours.join(totals, ["store_id", "day"], "full_outer").na.fill(0, ["sales", "bills", "refunds", "net"])
    one = lambda name, a, b, exact: F.struct(F.lit(name).alias("name"), a.cast("long").alias("ours"), b.cast("long").alias("theirs"), F.lit(exact).alias("exact"))
    known = F.col("_sales_minor").isNotNull()
    rows = both.select("store_id", "day", F.explode(F.array_compact(F.array(
        one("lines_vs_payments", F.col("sales") - F.col("refunds"), F.col("net"), True),
        F.when(known, one("sales", F.col("sales"), F.col("_sales_minor"), False)),
        F.when(known, one("refunds", F.col("refunds"), F.col("_refunds_minor"), False)),
        F.when(known, one("bills", F.col("bills"), F.col("_bills"), True)),
    ))).alias("c")).select("store_id", "day", "c.*")
    theirs = totals.select("store_id", "day", F.explode("_payments_by_tender").alias("tender", "theirs"))
    net = paid.select("store_id", "day", "tender", (F.col("paid_in") - F.col("paid_out")).alias("ours")).join(totals.select("store_id", "day"), ["store_id", "day"], "left_semi")
    tenders = net.join(theirs, ["store_id", "day", "tender"], "full_outer").select("store_id", "day", F.concat(F.lit("tender:"), "tender").alias("name"), F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("theirs", F.lit(0)).alias("theirs"), F.lit(False).alias("exact"))
    every = rows.unionByName(tenders).withColumn("diff", F.col("ours") - F.col("theirs"))
    bp = basis_points(F.col("diff"), F.col("ours"), F.col("theirs"))
    return every.withColumn("_bp", bp).select("store_id", "day", "name", "ours", "theirs", "diff", F.when(F.col("_bp") != float("inf"), F.bround("_bp", 1)).alias("diff_bp"), F.when(F.col("exact"), F.col("diff") == 0).otherwise(F.col("_bp") <= threshold_bp).alias("ok"))


def unexplained_stock(levels: DataFrame, movements: DataFrame, zone: str) -> DataFrame:
    """Pairs of consecutive levels of a day whose difference the movements between them don't explain.

    levels and movements: store_id, sku, t_ms, order (arrival), qty_milli; movements also direction. Movements before
    the day's first level are left out; ties at one instant go by arrival.
    """
    key = ["store_id", "sku", "day"]
    signed = F.when(F.col("direction") == "in", F.col("qty_milli")).otherwise(-F.col("qty_milli"))
    rows = levels.select("store_id", "sku", _day(zone), "t_ms", "order", F.lit(1).alias("is_level"), "qty_milli").union(movements.select("store_id", "sku", _day(zone), "t_ms", "order", F.lit(0), signed))
    w = W.partitionBy(*key).orderBy("t_ms", "order")
    runs = rows.withColumn("_level", F.sum("is_level").over(w))
    per = runs.groupBy(*key, "_level").agg(
        F.max(F.when(F.col("is_level") == 1, F.col("qty_milli"))).alias("qty"), F.max(F.when(F.col("is_level") == 1, F.col("t_ms"))).alias("at"),
        F.coalesce(F.sum(F.when(F.col("is_level") == 0, F.col("qty_milli"))), F.lit(0)).alias("moved_after"),
    )
    v = W.partitionBy(*key).orderBy("_level")
    steps = per.where("_level > 0").withColumns({"from_milli": F.lag("qty").over(v), "moved": F.lag("moved_after").over(v), "from_ms": F.lag("at").over(v)})
    return steps.where("from_milli is not null and qty - from_milli <> moved").select(*key, "from_milli", F.col("qty").alias("to_milli"), "moved", (F.col("qty") - F.col("from_milli") - F.col("moved")).alias("unexplained_milli"), "from_ms", F.col("at").alias("to_ms"))


def alerts(check_rows: DataFrame, stock_rows: DataFrame) -> DataFrame:
    """Names of failed checks and skus per store and day, with ok for days without any."""
    failed = check_rows.select("store_id", "day", F.when(~F.col("ok"), F.col("name")).alias("name")).union(stock_rows.select("store_id", "day", F.concat(F.lit("stock:"), "sku")))
    return failed.groupBy("store_id", "day").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("alerts")).withColumn("ok", F.col("alerts") == "")
