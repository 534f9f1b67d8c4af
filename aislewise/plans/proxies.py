"""The stored tables of schemas.py, read from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.functions.buckets import to_ms
from aislewise.functions.shared import scratch  # noqa: F401

ZONE = "Asia/Kolkata"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over tasks by a key that each has for itself, for costly work on a table that may be a single row group."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def minor(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def null_run() -> Column:
    return F.lit(None).cast("string").alias("run_id")


def sale_lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.lit("s1").alias("store_id"), null_run(), to_ms(F.col("l_shipdate")).alias("t_ms"), F.concat(F.lit("till-"), F.col("l_suppkey") % 4).alias("till_id"), F.col("l_orderkey").cast("string").alias("bill_ref"),
        F.col("l_linenumber").alias("revision"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").cast("string").alias("sku"), F.round(F.col("l_quantity") * 1000).cast("long").alias("qty_milli"), F.lit("pcs").alias("unit"),
        minor("l_extendedprice").alias("amount_minor"), F.round(F.col("l_extendedprice") * F.col("l_tax") * 100).cast("long").alias("tax_minor"), F.col("l_returnflag").alias("currency"),
    )


def till_events(spark: SparkSession, d: str) -> DataFrame:
    """Voids of the bills of status P, each of one revision."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return o.select(F.lit("s1").alias("store_id"), null_run(), to_ms(F.col("o_orderdate")).alias("t_ms"), F.lit("till-0").alias("till_id"), F.lit("void").alias("kind"), F.col("o_orderkey").cast("string").alias("bill_ref"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("revision"))


def payment_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.lit("s1").alias("store_id"), null_run(), to_ms(F.col("o_orderdate")).alias("t_ms"), F.concat(F.lit("till-"), F.col("o_custkey") % 4).alias("till_id"), F.col("o_orderkey").cast("string").alias("bill_ref"),
        F.col("o_orderpriority").alias("tender"), F.when(F.col("o_orderstatus") == "F", "out").otherwise("in").alias("direction"), minor("o_totalprice").alias("amount_minor"), F.lit("INR").alias("currency"),
    )


def movements(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.lit("s1").alias("store_id"), null_run(), to_ms(F.col("l_shipdate")).alias("t_ms"), F.concat(F.lit("sku-"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("sku"),
        F.when(F.col("l_linestatus") == "F", "in").otherwise("out").alias("direction"), F.col("l_returnflag").alias("reason"), F.round(F.col("l_quantity") * 1000).cast("long").alias("qty_milli"), F.lit("pcs").alias("unit"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order"),
    )


def levels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_linenumber = 1")
    return li.select(
        F.lit("s1").alias("store_id"), null_run(), to_ms(F.col("l_shipdate")).alias("t_ms"), (F.col("l_orderkey") * 1000 + F.round(F.col("l_quantity")).cast("long")).alias("seq"),
        F.concat(F.lit("sku-"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("sku"), F.round(F.col("l_quantity") * 1000).cast("long").alias("qty_milli"), F.lit("pcs").alias("unit"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumns({"t_ms": to_ms(F.col("ts")), "k": F.get_json_object("props", "$.k").cast("long")})


def rule_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of four stores, live and of a run: views enter and clicks leave a zone, purchases carry a queue length, signups open a register, errors tick.

    Arrival is event order put back by a delay that depends on the id, so some events come late.
    """
    e = events(spark, d)
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "zone.entered", "click", "zone.exited", "purchase", "queue.length", "signup", "register.opened", "error", "clock.tick")]), F.col("event_type"))
    delay = F.when(F.col("event_id") % 11 == 0, (F.col("event_id") * 7919 % 40) * 60_000).otherwise(0)
    return e.select(
        F.concat(F.lit("s"), F.col("user_id") % 4).alias("store_id"), F.when(F.col("user_id") % 5 == 0, "run-1").alias("run_id"), ((F.col("t_ms") + delay) * 100_000 + F.col("event_id")).alias("arrival"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("com.retail.store."), kind).alias("type"), "t_ms",
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sequence"), F.concat(F.lit("z"), F.col("user_id") % 3).alias("zone_id"), F.concat(F.lit("trk-"), F.col("user_id")).alias("track_id"), F.lit(None).cast("string").alias("how"),
        F.concat(F.lit("q"), F.col("user_id") % 16).alias("queue_id"), F.floor(F.col("value") / 10).cast("int").alias("length"),
    )
