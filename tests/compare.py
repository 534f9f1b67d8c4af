"""Rows of a DataFrame and of DuckDB SQL in one comparable form."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TESTDATA = Path("/root/testdata")
SMALLEST, SMALL = str(TESTDATA / "sf0.001"), str(TESTDATA / "sf0.01")


def _plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") if v else 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return str(v)


def _sorted(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return _sorted(df.columns, df.collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for file in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
        found = con.execute(sql)
        return _sorted([c[0] for c in found.description], found.fetchall())


def difference(df: DataFrame, sql: str, sf_dir: str) -> str | None:
    """None where both give the same rows, else what differs first."""
    (names, rows), (duck_names, duck) = spark_rows(df), duck_rows(sql, sf_dir)
    if names != duck_names:
        return f"columns {names} and {duck_names}"
    if rows == duck:
        return None
    return f"{len(rows)} and {len(duck)} rows; " + next((f"{a} and {b}" for a, b in zip(rows, duck) if a != b), "one has more rows")
