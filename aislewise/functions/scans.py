"""Running values along an order, for keys of any size: two passes over cells of equal depth.

Rows are dealt by ranges of (key, order), whose borders Spark takes from a sample of the rows, so cells hold about as many
rows each, whatever the values are and however many rows a key has. A running value is associative: inside each cell it
is a window; a cell's total is one row; totals before a cell are a window over these few rows; both together are the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from aislewise.functions.shared import stored

CELL = "_cell"
_FROM, _PLACE = W.unboundedPreceding, "_place"


@dataclass(frozen=True)
class Running:
    """A running value of a column: sum, min, max or last (its last value that is not null).

    exclusive leaves the row itself out; backward runs from the end. Nulls count as nothing. Windows that run from the end
    are windows from the start in falling order: Spark adds to these row by row, but counts frames that end with the
    partition anew for each row.
    """

    value: str
    kind: str = "sum"
    exclusive: bool = False
    backward: bool = False

    def inside(self, rising: WindowSpec, falling: WindowSpec) -> dict[str, Column]:
        frame = (falling if self.backward else rising).rowsBetween(_FROM, -1 if self.exclusive else 0)
        return {"in": self._of(self.value, frame)}

    def total(self, at: dict[str, Column], place: Column) -> dict[str, Column]:
        if self.kind == "last":
            own = F.when(F.col(self.value).isNotNull(), place)
            return {"all": (F.min_by if self.backward else F.max_by)(self.value, own)}
        return {"all": {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.value)}

    def before(self, at: dict[str, Column], rising: WindowSpec, falling: WindowSpec) -> dict[str, Column]:
        return {"pre": self._of(at["all"], (falling if self.backward else rising).rowsBetween(_FROM, -1))}

    def result(self, at: dict[str, Column]) -> Column:
        a, b = at["in"], at["pre"]
        if self.kind == "sum":
            return F.coalesce(a + b, a, b)
        return F.coalesce(a, b) if self.kind == "last" else (F.least if self.kind == "min" else F.greatest)(a, b)

    def _of(self, value, frame: WindowSpec) -> Column:
        if self.kind == "last":
            return F.last(value, True).over(frame)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](value).over(frame)


@dataclass(frozen=True)
class Clamped:
    """The running sum of steps that never goes under 0: what falls below is forgotten.

    The summary of a stretch is (sum, least prefix sum); the value after it is the sum less the least prefix under 0.
    """

    value: str

    def inside(self, rising: WindowSpec, falling: WindowSpec) -> dict[str, Column]:
        return {"run": F.sum(self.value).over(rising.rowsBetween(_FROM, 0))}

    def second(self, at: dict[str, Column], w: WindowSpec) -> dict[str, Column]:
        return {"low": F.min(at["run"]).over(w.rowsBetween(_FROM, 0))}

    def total(self, at: dict[str, Column], place: Column) -> dict[str, Column]:
        return {"sum": F.sum(self.value), "least": F.min(at["run"])}

    def before(self, at: dict[str, Column], rising: WindowSpec, falling: WindowSpec) -> dict[str, Column]:
        return {"base": F.coalesce(F.sum(at["sum"]).over(rising.rowsBetween(_FROM, -1)), F.lit(0))}

    def lowest(self, at: dict[str, Column], w: WindowSpec) -> dict[str, Column]:
        return {"floor": F.min(at["base"] + at["least"]).over(w.rowsBetween(_FROM, -1))}

    def result(self, at: dict[str, Column]) -> Column:
        return at["base"] + at["run"] - F.least(F.lit(0), at["base"] + at["low"], at["floor"])


def in_cells(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int | None = None, label: str = "cells") -> DataFrame:
    """df with _cell, stored: n ranges (default: the session's shuffle partitions) of key and order with about as many rows each."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    dealt = df.repartitionByRange(n, *keys) if keys else df.repartition(n)
    return stored(dealt.withColumn(CELL, F.spark_partition_id()), label)


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: dict[str, Running | Clamped], n: int | None = None) -> DataFrame:
    """df with one column for each of values. order: columns whose end makes it total; rows equal in all are in any order."""
    return scan_cells(in_cells(df, by, order, n), by, order, values).drop(CELL)


def scan_cells(celled: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: dict[str, Running | Clamped]) -> DataFrame:
    """scan() over rows that in_cells() has dealt by the same key and order; _cell stays."""
    own = W.partitionBy(CELL, *by)
    rising, falling = own.orderBy(*order), own.orderBy(F.desc(_PLACE))
    rows, parts = celled, {}
    if any(isinstance(v, Running) and (v.kind == "last" or v.backward) for v in values.values()):
        rows = rows.withColumn(_PLACE, F.row_number().over(rising))
    for name, value in values.items():
        inside = value.inside(rising, falling)
        at = {k: f"_{name}_{k}" for k in inside}
        rows = rows.withColumns({at[k]: c for k, c in inside.items()})
        if isinstance(value, Clamped):
            rows = rows.withColumns({f"_{name}_{k}": c for k, c in value.second({k: F.col(c) for k, c in at.items()}, rising).items()})
        parts[name] = at
    totals = rows.groupBy(CELL, *by).agg(*[c.alias(f"_{name}_{k}") for name, v in values.items() for k, c in v.total({k: F.col(c) for k, c in parts[name].items()}, F.col(_PLACE)).items()])
    along, back = W.partitionBy(*by).orderBy(CELL), W.partitionBy(*by).orderBy(F.desc(CELL))  # a row a cell of the key
    for name, v in values.items():
        col = lambda k, name=name: F.col(f"_{name}_{k}")
        seen = {k: col(k) for k in v.total({k: F.lit(None) for k in parts[name]}, F.lit(None))}
        new = v.before(seen, along, back)
        totals = totals.withColumns({f"_{name}_{k}": c for k, c in new.items()})
        if isinstance(v, Clamped):
            totals = totals.withColumns({f"_{name}_{k}": c for k, c in v.lowest({**seen, "base": col("base")}, along).items()})
    carried = {"_c": F.col(CELL)} | {f"_k{i}": F.col(k) for i, k in enumerate(by)}
    carry = [f"_{name}_{k}" for name, v in values.items() for k in (("base", "floor") if isinstance(v, Clamped) else ("pre",))]
    totals = totals.select(*[c.alias(k) for k, c in carried.items()], *carry)
    on = F.col(CELL) == F.col("_c")
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(totals, on)
    results = []
    for name, v in values.items():
        names = ("run", "low", "base", "floor") if isinstance(v, Clamped) else ("in", "pre")
        results.append(v.result({k: F.col(f"_{name}_{k}") for k in names}).alias(name))
    return joined.select(*celled.columns, *results)
