"""Connected components of a link table by repeated minimum labels (large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a key from which it may count as hot; in larger tables the bound is a thousandth of all rows.
HOT = 1000


def join_counted(rows: DataFrame, totals: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """rows joined with totals: one row a key, whose column count says how many rows have that key.

    Keys with over HOT and over a thousandth of all rows, fewer than a thousand, are broadcast; all others are shuffled.
    So no key's rows are gathered in one task.
    """
    all_rows = totals.agg(F.sum(count)).first()[0] or 0
    least = max(HOT, all_rows // 1000)
    keys = [key] if isinstance(key, str) else key
    hot = F.broadcast(totals.where(F.col(count) > least))
    rest = rows.join(hot.select(*keys), key, "left_anti").join(totals.where(F.col(count) <= least), key)
    return rows.join(hot, key).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that a link names; root is the smallest node reachable.

    links: columns a and b, both of one orderable type. Nulls, self links and repeated links are allowed; links with a
    null end are dropped. An empty table gives an empty table. Each round replaces the links (a, b) of a node by links
    of its neighbours to the node's smallest neighbour, so the number of links never grows beyond its first count.
    Rounds end when every node has one link, to a node that has none, which is when all components are stars.
    """
    spark = links.sparkSession
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = common.stored(edges, "links")
    while not _stars(edges):
        turned, before = common.stored(_large_star(edges), "links")
        new, new_path = common.stored(_small_star(turned), "links")
        common.remove(spark, path)
        common.remove(spark, before)
        edges, path = new, new_path
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v"), F.col("v")).distinct())


def _stars(edges: DataFrame) -> bool:
    one = F.lit(1).cast("long")
    ends = edges.select(F.col("u").alias("x"), one.alias("out"), F.lit(0).cast("long").alias("in")).union(edges.select("v", F.lit(0).cast("long"), one))
    return not ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("out > 1 or (out > 0 and in > 0)").limit(1).count()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node among the node and its neighbours."""
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.union(larger).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
    out = join_counted(larger, least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_counted(edges, least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.union(kept).where("u <> v").distinct()
