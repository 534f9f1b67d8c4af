"""Checks of parameters on the driver and as columns."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aislewise.functions import settings
from aislewise.operators import importer
from aislewise.operators import tracking as T

DURATIONS = {"P1DT2H": 93_600_000, "PT0.5S": 500, "PT1H30M": 5_400_000, "PT1.0005S": 1000, "P7D": 604_800_000, "day": None, "P": None, "PT": None, "1H": None, "PT1H2": None, "PTXH": None, "": None}
VERSIONS = {"1.20.3": (1, 20, 3), "0.0.0": (0, 0, 0), "1.2": None, "v1.0.0": None, "1.2.3.4": None, "1.2.x": None, "": None}


def tried(check, *given):
    try:
        return check(*given)
    except ValueError:
        return None


def test_durations_and_versions_as_values_and_as_columns(spark):
    assert {t: tried(settings.duration_ms, t) for t in DURATIONS} == DURATIONS
    assert {t: tried(settings.version, t) for t in VERSIONS} == VERSIONS
    rows = spark.createDataFrame([(t,) for t in {**DURATIONS, **VERSIONS}] + [(None,)], "t string")
    out = {r.t: r for r in rows.select("t", settings.duration_ms_of(F.col("t")).alias("d"), settings.version_of(F.col("t")).alias("v")).collect()}
    assert {t: out[t].d for t in DURATIONS} == DURATIONS and out[None].d is None and out[None].v is None
    assert {t: out[t].v and tuple(out[t].v) for t in VERSIONS} == VERSIONS


def test_version_columns_order_as_versions(spark):
    rows = spark.createDataFrame([(t,) for t in ("1.0.10", "1.0.9", "1.9.9", "2.0.0", "1.10.0")], "t string")
    assert [r.t for r in rows.orderBy(settings.version_of(F.col("t"))).collect()] == ["1.0.9", "1.0.10", "1.9.9", "1.10.0", "2.0.0"]


@pytest.mark.parametrize("given", [("s1", 1, 9, "hour"), ("", 1, 2, "day"), ("bad id", 1, 2, "day"), ("s1", 2, 2, "day"), ("s1", 1, 2, "week"), ("s1", 1, 5, "15m")])
def test_windows_that_are_refused(given):
    store, a, b, bucket = given
    with pytest.raises(ValueError):
        settings.checked_window(store, datetime(2024, 1, a), datetime(2024, 1, b), "Asia/Kolkata", bucket)
    settings.checked_window("s1", datetime(2024, 1, 1), datetime(2024, 1, 3), "Asia/Kolkata")


def test_limits(spark):
    assert [settings.checked_limit(n) for n in (-5, 0, 7, 5000)] == [1, 1, 7, 1000]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in (-5, 0, 7, 5000)], "n int").select(settings.limit_of(F.col("n"))).collect()] == [1, 1, 7, 1000]


def test_old_rules_documents():
    old = {"R-1": {"version": "1.2.0", "limit": 5}, "R-2": {"version": "1.0.0"}}
    assert settings.replaced_rules(old, old) == []
    assert settings.replaced_rules(old, {"R-1": {"version": "1.2.0", "limit": 6}}) == ["R-2: removed", "R-1: parameters change without a new version"]
    assert settings.replaced_rules(old, {**old, "R-2": {"version": "0.9.0"}}) == ["R-2: version goes back from 1.0.0 to 0.9.0"]


def test_profiles_schemas_and_regions():
    assert importer.guessed_profile(["Bill No", "Item Code", "QTY", "Total", "Remarks"]) == {"bill_no": "Bill No", "sku": "Item Code", "qty": "QTY", "amount": "Total"}
    was, now = StructType.fromDDL("a int not null, b string, c struct<x: int, y: int>"), StructType.fromDDL("a bigint not null, b string not null, c struct<x: int>, d int not null")
    assert importer.breaking_changes(was, now) == ["a: int becomes bigint", "b: now required", "c.y: removed", "d: new and required"]
    assert len(T.tiles(70, 50, 32)) == 6 and T.regions_of_zones({"z": [(10, 10), (20, 10), (20, 20)]}, 100, 100)["z"] == (9, 9, 21, 21)
