"""The queries that the driver runs, by name, and their SQL."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from aislewise.plans import billing_queries, event_queries, import_queries, live_queries, report_queries, source_queries, vision_queries

_MODULES = (billing_queries, event_queries, vision_queries, import_queries, source_queries, report_queries, live_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.SQL.items()}

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def on_workers(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, with this package sent to Python workers first unless PYTHONPATH has it there already."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def ship(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # instants are UTC timestamps without zone
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="aislewise-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/aislewise", "zip", _ROOT, "aislewise"))
    sys.path[:] = [p for p in sys.path if not p.startswith(folder)]  # the driver has the package itself
    _shipped.add(spark.sparkContext.applicationId)
