"""Validation, deduplication, typed tables and the billing import on hand-made rows."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from aislewise.operators import importer, ingest
from aislewise.schemas import ENVELOPE, PREFIX
from aislewise.streaming import ingest_stream, rules_stream

NOW = 1_704_110_400_000  # 2024-01-01T12:00:00Z
NAMES = [c.split()[0] for c in ENVELOPE.split(", ")]


def envelope(**changes):
    base = {
        "specversion": "1.0", "id": "1", "source": "urn:x:edge:s1:a", "type": f"{PREFIX}store.queue.length", "time": "2024-01-01T11:59:00Z", "subject": "queue:q1", "dataschema": "https://x/store.queue.length-1.0.0.json",
        "datacontenttype": "application/json", "storeid": "s1", "partitionkey": "s1", "data": json.dumps({"queueId": "q1", "length": 3, "openRegisters": 1}),
    }
    return base | changes


def errors(spark, *rows):
    df = spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], ENVELOPE)
    return [r.errors for r in ingest.validate(df, F.lit(NOW).cast("long")).collect()]


def test_all_errors_are_collected(spark):
    good, faulty, unknown, sim, old, nothing = errors(
        spark, envelope(), envelope(subject="zone:z", partitionkey="s2", data=json.dumps({"queueId": "?", "length": -1})), envelope(type=f"{PREFIX}store.other"), envelope(source=ingest.SIMULATOR + ":x", time="2020-01-01T00:00:00Z"),
        envelope(time="2023-12-30T00:00:00Z", dataschema="none"), {},
    )
    assert good == []
    assert faulty == ["subject does not fit the type", "data.queueId has the wrong form", "data.length is under 0", "data.openRegisters is missing", "partitionkey is not the store"]
    assert unknown == [f"unknown type {PREFIX}store.other"]
    assert sim == ["simulated event without simrunid"]
    assert old == ["dataschema has no version", "time is too old"]
    assert len(nothing) == 10


def test_first_payload_wins(spark):
    rows = spark.createDataFrame([("a", "1", 5, "h"), ("a", "1", 2, "g"), ("a", "1", 9, "g"), ("b", "1", 1, "h"), ("a", "2", 3, None)], "source string, id string, arrival long, payload_hash string")
    assert {r.arrival: r.result for r in ingest.dedup(rows).collect()} == {2: "ACCEPTED", 5: "CONFLICT", 9: "DUPLICATE", 1: "ACCEPTED", 3: "ACCEPTED"}


def test_source_policy(spark):
    row = spark.range(1).select(
        ingest.may_publish(F.lit("c"), F.lit("urn:x:edge:s1:a"), {"c": ("urn:x:edge:s1",)}).alias("own"), ingest.may_publish(F.lit("d"), F.lit("urn:x:edge:s1:a"), {"c": ("urn:x",)}).alias("other"),
        ingest.may_publish(F.lit("c"), F.lit("urn"), {}).alias("none"), ingest.edge_names_store(F.lit("urn:x:edge:s1:a"), F.lit("s2")).alias("wrong"), ingest.edge_names_store(F.lit("urn:x:pos"), F.lit("s2")).alias("no_edge"),
    ).first()
    assert (row.own, row.other, row.none, row.wrong, row.no_edge) == (True, False, False, False, True)


def test_stream_dedup_and_typed_tables(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rules_stream.ROCKS)
    sale = {"storeId": "s1", "tillId": "t1", "billRef": "bill-" + "0" * 32, "revision": 0, "lineNo": 1, "sku": "x", "qtyMilli": 1000, "unit": "pcs", "amountMinor": 500, "currency": "INR"}
    line = envelope(type=f"{PREFIX}pos.sale.line", subject="till:t1", data=json.dumps(sale))
    rows = [line, line, line | {"data": json.dumps(sale | {"amountMinor": 1})}, envelope(id="2"), envelope(id="3", data="{}")]
    df = spark.createDataFrame([(*[r.get(n) for n in NAMES], i) for i, r in enumerate(rows)], ENVELOPE + ", arrival long")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = ingest.hashed(ingest.validate(spark.readStream.schema(df.schema).json(str(tmp_path / "in")), F.lit(NOW).cast("long")))
    query = ingest_stream.dedup_stream(stream, None).writeStream.outputMode("append").foreachBatch(ingest_stream.write_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    assert [(r.sku, r.amount_minor) for r in spark.read.parquet(str(tmp_path / "out/sale_lines")).collect()] == [("x", 500)]
    assert sorted((r.id, r.reason) for r in spark.read.parquet(str(tmp_path / "out/dead_letters")).collect()) == [("1", "CONFLICT"), ("3", "INVALID")]


# ---- billing import -----------------------------------------------------------------------------------------------

CANONICAL = "bill_no string, date string, time string, till string, line_no string, sku string, qty string, unit string, amount string, tax string, _order long"
PROFILE = importer.Profile({}, {"unit": {"pcs": "pcs", "each one": "pcs"}}, zone="UTC")


def lines_of(spark, rows):
    return importer.bill_lines(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], CANONICAL), PROFILE, b"secret")


def test_bills_are_new_then_unchanged_then_revised(spark):
    first = [("B1", "2024-01-01", "10:00:00", "T 1", None, "a b", "2", "PCS", "10.00", None), ("B1", "2024-01-01", "10:00:00", "T 1", None, "c", "1", " Each  One ", "5.50", "0.50"), ("B2", "2024-01-01", None, None, "1", "d", "x", "pcs", "1", None), ("B3", "2024-01-01", None, None, "1", "d", "1", "pcs", "1", None), ("B3", "2024-01-01", None, None, "1", "e", "1", "pcs", "1", None)]
    lines = lines_of(spark, first)
    none = spark.createDataFrame([], "bill_ref string, revision int, content string, total long, till_id string")
    bills, held = importer.imported_bills(lines, none)
    (bill,) = bills.collect()
    assert (bill.action, bill.revision, bill.total, bill.till_id) == ("new", 0, 1550, "t-1")
    assert sorted(r.reason for r in held.collect()) == ["a line is bad", "repeated line numbers"]
    known = bills.select("bill_ref", "revision", "content", "total", "till_id")
    again, _ = importer.imported_bills(lines, known)
    assert again.first().action == "unchanged"
    changed = [first[0][:6] + ("3",) + first[0][7:]]
    lines2 = lines_of(spark, changed)
    revised, _ = importer.imported_bills(lines2, known)
    r = revised.first()
    assert (r.action, r.revision, r.void_revision, r.void_amount) == ("revised", 1, 0, 1550)
    before = lines.where("error = ''").select("bill_ref", "sku", "unit", "qty_milli")
    deltas = {(d.sku, d.direction, d.reason, d.qty_milli) for d in importer.stock_deltas(lines2, revised, before).collect()}
    assert deltas == {("a-b", "out", "sale", 1000), ("c", "in", "adjustment", 1000)}


def test_times_of_sources(spark):
    def at(profile, date, time=None):
        return spark.range(1).select(importer.event_time(profile, F.lit(date), None if time is None else F.lit(time)).alias("t")).first().t

    ms = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)
    kolkata = importer.Profile({})
    assert at(kolkata, "2024-01-01", "05:30:00") == ms(2024, 1, 1)
    assert at(kolkata, "2024-01-01T00:00:00Z") == ms(2024, 1, 1)
    assert at(kolkata, "2024-01-01") == ms(2024, 1, 1, 18, 29, 59)
    assert at(importer.Profile({}, time_format="epoch_ms"), "17") == 17
    assert at(importer.Profile({}, time_format="epoch_s"), "17.5") == 17_500
    assert at(importer.Profile({}, zone="UTC", time_format="%d/%m/%Y %H:%M"), "02/01/2024 03:04") == ms(2024, 1, 2, 3, 4)
    assert at(kolkata, "never") is None


def test_profiles_are_guessed_and_schemas_compared(spark):
    assert importer.guessed_profile(["Bill No.", "Bill Date", "Item Code", "Total", "Qty"]) == {"bill_no": "Bill No.", "date": "Bill Date", "sku": "Item Code", "qty": "Qty", "amount": "Total"}
    old, new = spark.createDataFrame([], "a int, b struct<c: string, d: int>, e long").schema, spark.createDataFrame([], "a long, b struct<c: string>, f int").schema
    assert importer.breaking_changes(old, new) == ["a: int becomes bigint", "b.d: removed", "e: removed"]


def test_extract_expands_lists_with_outer_references(spark):
    rows = spark.createDataFrame([(json.dumps({"no": "7", "items": [{"code": "x", "n": {"q": 2}}, {"code": " ", "n": {"q": 3}}]}),)], "record string")
    out = importer.extract(rows, importer.Profile({"bill_no": "$.no", "sku": "code", "qty": "n.q"}, each="items")).collect()
    assert [(r.bill_no, r.sku, r.qty) for r in out] == [("7", "x", "2"), ("7", None, "3")]
