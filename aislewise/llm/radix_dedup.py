"""Exact duplicates by distributed most-significant-byte-first radix partitioning.

Round k groups the documents that are still together by the next run of bytes of their normalised text. A group of one
document is finished; a document whose bytes ended in this round is finished too, with all documents of its group,
because they have had equal bytes from the first on and ended together. The rest goes on with the group's number and
its remaining bytes. No digest decides equality.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes that a round takes: the first is small, as most documents leave in it; later ones grow, for few rounds.
FIRST_BYTES = 64
GROWTH = 16


def _row_id(docs: DataFrame) -> Column:
    """What tells rows of equal id and text apart, the same in every job that reads docs again.

    Rows of Parquet files have their file and place. Other tables are numbered in the order in which they are evaluated,
    so they must give their rows in the same partitions each time.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        docs.select(place)
    except AnalysisException:  # not a scan of files that number their rows
        return F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    return place


def dedup_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Texts are equal when identical after each run of ASCII white space became one space.
    keep_id is the smallest doc_id of the equal texts (null only if all are null); exactly one row of each group has
    kept, also where rows repeat a doc_id. An empty table gives an empty table. Other columns are not read.
    """
    norm = F.regexp_replace(common.or_empty(text), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col(doc_id).alias("doc_id"), _row_id(docs).alias("rid"), norm.alias("norm"))
    rows = rows.select("doc_id", "rid", F.sha2("norm", 256).alias("sha"), F.encode("norm", "utf-8").alias("rest"))
    done = [c.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")) for c in _rounds(rows)]
    return reduce(DataFrame.union, done)


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that dedup_exact keeps, with all their columns.

    The same rounds run with the row itself as payload, so rows that share a doc_id stay apart.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    norm = F.regexp_replace(common.or_empty(text), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col(doc_id).alias("doc_id"), _row_id(docs).alias("rid"), row.alias("row"), F.encode(norm, "utf-8").alias("rest"))
    done = [c.where("kept").select("row.*") for c in _rounds(rows)]
    return reduce(DataFrame.union, done)


def _rounds(rows: DataFrame) -> list[DataFrame]:
    """The finished rows of every round: what rows has but for rest, with keep_id, group_size and kept."""
    spark, finished, n, gid = rows.sparkSession, [], FIRST_BYTES, None
    carried = [c for c in rows.columns if c not in ("rest", "gid")]
    while True:
        key = [F.substring("rest", 1, n).alias("chunk"), (F.length("rest") <= n).alias("ended")] + ([] if gid is None else [F.col("gid")])
        names = ["chunk", "ended"] + ([] if gid is None else ["gid"])
        groups = (
            rows.select("doc_id", "rid", *key)
            .groupBy(*names)
            .agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("rid", "doc_id"), F.min("rid")).alias("keep_rid"), F.min("rid").alias("next_gid"))
            .where("group_size > 1")
        )
        groups, path = common.stored(groups, "radix-groups")
        if groups.limit(1).count() == 0:
            alone = rows.select(*carried, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
            return [*finished, alone]
        joined = rows.select(*carried, *key, F.substring(F.col("rest"), n + 1, 2**31 - 1).alias("left")).join(groups.hint("merge"), names, "left")
        go_on = F.col("group_size").isNotNull() & ~F.col("ended")
        out = joined.where(~go_on).select(
            *carried,
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (F.col("group_size").isNull() | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        )
        finished.append(out)
        open_groups = groups.where("not ended").limit(1).count()
        if not open_groups:
            return finished
        rows, _ = common.stored(joined.where(go_on).select(*carried, F.col("next_gid").alias("gid"), F.col("left").alias("rest")), "radix-rows")
        gid, n = "gid", n * GROWTH
        rows = rows.select(*carried, "gid", "rest")


def query(spark, sf_dir: str) -> DataFrame:
    """Keep and drop of every document; null texts are empty ones, of repeated rows one stays, an empty table gives none."""
    return dedup_exact(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
QUERIES: dict[str, Callable] = {"op10_exact_dedup": query}
