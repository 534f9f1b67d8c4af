"""Polled SQL and REST sources and XML vouchers."""

from __future__ import annotations

import json
import re
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .http import Pages
from .polled_stream import RestStreamReader

#: Words that a read-only statement doesn't hold.
FORBIDDEN = ("insert", "update", "delete", "merge", "drop", "alter", "create", "truncate", "grant", "revoke", "call", "exec", "execute", "into", "copy", "set", "lock", "vacuum")


def checked_select(sql: str) -> str:
    """The statement, if it is one SELECT (or WITH ... SELECT) that writes nothing; else ValueError."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").strip()
    if ";" in bare:
        raise ValueError("more than one statement")
    if not re.match(r"(?i)(select|with)\b", bare):
        raise ValueError("not a SELECT")
    found = set(re.findall(r"[a-z_]+", bare.lower())) & set(FORBIDDEN)
    if found:
        raise ValueError(f"not read-only: {', '.join(sorted(found))}")
    return sql.strip().rstrip(";")


def cursor_page(rows: DataFrame, cursor: str, after, limit: int, look_back=None) -> DataFrame:
    """The next rows by cursor: about `limit` of them, never dividing rows of one cursor value.

    With look_back (what is taken from `after`) rows that came late behind the cursor are read again; latest_per() or
    the sink's keys drop what is known. Filter, order and limit reach a JDBC source.
    """
    if after is None:
        later = fresh = rows
        end = F.col("_last")
    else:
        later = rows.where(F.col(cursor) > F.lit(after if look_back is None else after - look_back))
        fresh = rows.where(F.col(cursor) > F.lit(after))
        end = F.coalesce("_last", F.lit(after))
    last = fresh.select(cursor).orderBy(cursor).limit(limit).agg(F.max(cursor).alias("_last"))
    return later.join(F.broadcast(last), F.col(cursor) <= end).drop("_last")


def poll_sql(spark: SparkSession, jdbc: dict[str, str], sql: str, cursor: str, after, limit: int, sink: Callable[[DataFrame], None], look_back=None):
    """One page of a JDBC query to the sink; the new cursor, to be kept only now that the sink has succeeded."""
    page = cursor_page(spark.read.format("jdbc").options(**jdbc, query=checked_select(sql)).load(), cursor, after, limit, look_back).persist()
    try:
        sink(page)
        last = page.agg(F.max(cursor)).first()[0]
        return after if last is None or (after is not None and last < after) else last
    finally:
        page.unpersist()


@dataclass
class Page(InputPartition):
    url: str

    def __init__(self, url: str):
        self.url = url


class RestReader(DataSourceReader):
    """Pages of a REST resource: none, page, offset, cursor, link or nextUrl. Numbered pages are partitions of their own."""

    def __init__(self, options: dict[str, str]):
        self.o = options

    def _since(self) -> dict[str, str]:
        """The parameter for changes only: option since (ISO time), less lookback seconds, under the name sinceparam."""
        if not self.o.get("since"):
            return {}
        at = datetime.fromisoformat(self.o["since"]) - timedelta(seconds=float(self.o.get("lookback", 0)))
        return {self.o.get("sinceparam", "since"): at.isoformat()}

    def _with(self, **params) -> str:
        parts = urllib.parse.urlsplit(self.o["path"])
        query = dict(urllib.parse.parse_qsl(parts.query)) | self._since() | {k: str(v) for k, v in params.items()}
        return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))

    def partitions(self) -> list[Page]:
        """One partition a page where the number of pages is given; else one that follows the pages to an empty one."""
        style, size, pages = self.o.get("paging", "none"), int(self.o.get("pagesize", 100)), self.o.get("pages")
        if style in ("page", "offset"):
            return [Page(self._numbered(style, n, size)) for n in range(int(pages or 1))]
        return [Page(self._with())]

    def _numbered(self, style: str, n: int, size: int) -> str:
        return self._with(page=n + 1, per_page=size) if style == "page" else self._with(offset=n * size, limit=size)

    def read(self, partition: Page) -> Iterator[tuple]:
        style, limit = self.o.get("paging", "none").lower(), int(self.o.get("maxpages", 10_000))
        known = style in ("page", "offset") and self.o.get("pages")
        pages = Pages(self.o if not known else self.o | {"paging": "none"}, partition.url if known or style not in ("page", "offset") else self._with())
        for found in islice(pages.follow(), limit):
            for row in found:
                yield (json.dumps(row, ensure_ascii=False),)


class RestDataSource(DataSource):
    """spark.read.format("rest_pages").option("paging", ...).load(url), or readStream: one column, the record as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> RestReader:
        return RestReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> RestStreamReader:
        return RestStreamReader({k.lower(): v for k, v in self.options.items()})


#: Voucher types and what each becomes.
VOUCHERS = {"Sales": "bill", "Credit Note": "refund", "Receipt": "payment_in", "Payment": "payment_out", "Stock Journal": "movement"}


def read_vouchers(spark: SparkSession, path: str) -> DataFrame:
    """Vouchers of an XML day book with their kind, ledger and inventory entries."""
    schema = (
        "VOUCHERTYPENAME string, VOUCHERNUMBER string, DATE string, "
        "`ALLLEDGERENTRIES.LIST` array<struct<LEDGERNAME: string, AMOUNT: string>>, `ALLINVENTORYENTRIES.LIST` array<struct<STOCKITEMNAME: string, ACTUALQTY: string, AMOUNT: string>>"
    )
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in VOUCHERS.items() for x in pair]), F.col("VOUCHERTYPENAME"))
    rows = spark.read.schema(schema).option("rowTag", "VOUCHER").xml(path)
    return rows.select(F.col("VOUCHERTYPENAME").alias("type"), kind.alias("kind"), F.col("VOUCHERNUMBER").alias("number"), F.try_to_date("DATE", "yyyyMMdd").alias("date"), F.col("`ALLLEDGERENTRIES.LIST`").alias("ledger"), F.col("`ALLINVENTORYENTRIES.LIST`").alias("items"))


def voucher_lines(vouchers: DataFrame) -> DataFrame:
    """Item lines of bills, numbered (S8): quantities and amounts as exact thousandths and minor units."""
    lines = vouchers.where(F.col("kind").isin("bill", "refund")).select("number", "date", "kind", F.posexplode("items").alias("i", "item"))
    number = lambda c: F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"-?\d+(\.\d+)?", 0).try_cast("decimal(20,6)")
    return lines.select("number", "date", "kind", (F.col("i") + 1).alias("line_no"), F.col("item.STOCKITEMNAME").alias("sku"), F.bround(F.abs(number(F.col("item.ACTUALQTY"))) * 1000, 0).cast("long").alias("qty_milli"), F.bround(F.abs(number(F.col("item.AMOUNT"))) * 100, 0).cast("long").alias("amount_minor"))


def latest_per(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key of a page that overlaps the one before (the look-back of S6 and S7)."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
