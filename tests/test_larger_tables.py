"""Queries against their SQL over tables whose keys and values go beyond those of the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from aislewise.functions.shared import dealt_by
from aislewise.operators import billing, ingest, reconcile
from aislewise.plans import billing_queries, import_queries, registry
from aislewise.plans import proxies as P
from aislewise.sources import xlsx
from tests.compare import SMALL, SMALLEST, difference


def tables(folder: Path, **changed: str) -> str:
    """A folder of the smallest tables in which those named are the results of SQL over them."""
    with duckdb.connect() as con:
        for file in Path(SMALLEST).glob("*.parquet"):
            con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
            if file.stem not in changed:
                (folder / file.name).symlink_to(file)
        for name, sql in changed.items():
            con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def same(spark, name: str, folder: str) -> bool:
    found = difference(registry.QUERIES[name](spark, folder), registry.SQL[name], folder)
    assert found is None, found
    return True


def test_moments_of_types_with_a_zero_or_a_value_under_it(spark, tmp_path):
    d = tables(tmp_path, events="SELECT * REPLACE (CASE WHEN event_id % 50 = 7 AND event_type <> 'view' THEN 0.0 WHEN event_id % 50 = 8 AND event_type = 'view' THEN -value ELSE value END AS value) FROM events")
    assert same(spark, "moments", d)


def test_vouchers_of_suppliers_of_four_digits(spark, tmp_path):
    d = tables(tmp_path, supplier="SELECT * REPLACE (s_suppkey + c * 997 AS s_suppkey) FROM supplier, range(0, 40, 13) r(c)")
    assert same(spark, "voucher_scan", d)


def _written(rows, path, sheet, **options):
    rows.sparkSession.dataSource.register(xlsx.XlsxDataSource)
    rows.write.format("xlsx").options(sheet=sheet, **options).mode("append").save(path)


def test_workbooks_of_more_rows_than_a_sheet_has(spark, monkeypatch):
    monkeypatch.setattr(xlsx, "write_xlsx", lambda rows, path, sheet: _written(rows, path, sheet, sheetrows=100))
    assert same(spark, "xlsx_scan", SMALL)


def test_rows_of_a_task_beyond_what_may_be_unpacked_are_further_workbooks(spark, tmp_path):
    _written(spark.range(3000).selectExpr("id as n", "repeat('x', 100) as text").coalesce(1), str(tmp_path), "S", maxunpacked=200_000)
    assert len(list(tmp_path.glob("book-*.xlsx"))) > 3
    rows = spark.read.format("xlsx").options(sheet="*", maxunpacked=200_000).load(str(tmp_path)).selectExpr("cast(cells['n'] as long) as n")
    assert sorted(r.n for r in rows.collect()) == list(range(3000))


def test_timelines_of_dense_events(spark, tmp_path):
    """Incidents with more markers than stay, of registers and tills together, and with equal times."""
    dense = f"SELECT * REPLACE (TIMESTAMP '2024-01-02 03:00:00' + to_milliseconds((event_id * 7919 % 9000) * 1000) AS ts, CASE WHEN event_id % 9 = 0 THEN 'error' WHEN event_id % 5 < 3 THEN event_type ELSE 'click' END AS event_type) FROM read_parquet('{SMALL}/events.parquet') WHERE event_id % 9 > 0 OR event_id % 45 = 0"
    assert same(spark, "incident_timeline", tables(tmp_path, events=dense))


def test_lines_of_bills_are_shuffled_once(spark):
    counted = import_queries._lines(spark, SMALLEST).groupBy("bill_ref").count()
    plans = [counted, import_queries.bill_line_rows(spark, SMALLEST)]
    assert [p._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for p in plans] == [1, 1]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dead_letters_hash_envelopes_once_and_over_all_tasks(spark):
    plan = _plan(registry.QUERIES["dead_letters"](spark, SMALLEST))
    assert "PythonUDF" not in plan and "EvalPython" not in plan  # the stored rows have the hashes
    assert "RepartitionByExpression [event_id" in _plan(registry.QUERIES["validate_collect_errors"](spark, SMALLEST))


def test_rule_projection_reads_data_once_for_all_checks(spark):
    plan = _plan(registry.QUERIES["rule_projection"](spark, SMALLEST))
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("json" in line for line in filters) and plan.count("from_json(") == 1


def test_data_fields_are_those_of_get_json_object(spark):
    """Odd objects: doubled and null fields, nested values, numbers of other forms, cut and wrong JSON."""
    odd = [
        '{"a":1e2,"b":-1e2,"c":1.50,"d":-0}', '{"a":{"x": 1, "y" : [1, 2]},"b":[1, "z" ],"c":true,"d":null}', "{'a':'x'}", '{"a":"t\tab"}', '{"a":"1"} more', '{"a":"1","b":}', '{"a":"1"', "", "null", '[{"a":1}]',
        '{"a":"1","a":"2"}', '{"a":null,"a":"2"}', '{"a":"\\u00e9\\n"}', '{"a":012}', '{"a":NaN}', "{a:1}", '{"a":123456789012345678901234567890}', None,
    ]
    rows = spark.createDataFrame([(t,) for t in odd], "data string").withColumn("f", ingest._data_fields(F.col("data")))
    for r in rows.select("data", *[F.struct(F.get_json_object("data", f"$.{c}"), F.col("f")[c]).alias(c) for c in "abcd"]).collect():
        assert all(r[c][0] == r[c][1] for c in "abcd"), r


def test_bills_of_a_day_meet_their_voids_in_one_shuffle_over_as_many_tasks_as_rows_ask_for(spark):
    sales, _ = reconcile.day_books(P.sale_lines(spark, SMALLEST), P.till_events(spark, SMALLEST), P.payment_rows(spark, SMALLEST), P.ZONE)
    assert "Join" not in _plan(sales) and _plan(sales).count("RepartitionByExpression [store_id") == 1
    assert dealt_by(spark.range(3000), "id", rows=100).rdd.getNumPartitions() == 30 and dealt_by(spark.range(30), "id").rdd.getNumPartitions() == 8


def test_days_of_bills_without_revision_or_reference(spark):
    """A void without revision fits revision 0, one of another day or without a reference fits nothing."""
    day = 86_400_000
    lines = [("s", 0, "a", 0, 5), ("s", 0, "b", 1, 7), ("s", 0, "b", 2, 9), ("s", 0, "c", None, 11), ("s", 0, None, 0, 13), ("s", day, "a", 0, 17), ("s", day, "d", 3, 19), ("s", day, "d", 2, 23)]
    voids = [("s", 0, "a", None, "void"), ("s", 0, "b", 1, "void"), ("s", 0, None, 0, "void"), ("s", day, "d", 3, "void"), ("s", day, "a", 0, "open"), ("s", day, "e", 0, "void")]
    sales, _ = reconcile.day_books(
        spark.createDataFrame(lines, "store_id string, t_ms long, bill_ref string, revision int, amount_minor long"), spark.createDataFrame(voids, "store_id string, t_ms long, bill_ref string, revision int, kind string"),
        spark.createDataFrame([], "store_id string, t_ms long, tender string, direction string, amount_minor long"), "UTC",
    )
    assert sorted((r.day.day, r.sales, r.bills) for r in sales.collect()) == [(1, 9 + 13, 3), (2, 17, 1)]


def test_latest_bills_take_one_shuffle_and_no_join(spark):
    bills = billing.latest_bills(P.sale_lines(spark, SMALLEST), P.till_events(spark, SMALLEST), billing_queries.FROM, billing_queries.TO)
    plan = bills._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_zone_events_find_stays_once(spark):
    plan = _plan(registry.QUERIES["zone_events"](spark, SMALLEST))
    assert plan.count("Window [") <= 2  # those that cut a zone's stays into runs; the windows over tracks are in stored facts
