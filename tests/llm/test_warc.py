from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from aislewise.llm import common, warc
from tests.compare import SMALLEST, difference


def test_equals_sql(spark):
    assert difference(warc.query(spark, SMALLEST), warc.SQL, SMALLEST) is None


def round_trip(spark, rows, schema="page_id long, url string, html string"):
    path = common.new_path(spark, "warc-test")
    warc.write_pages(spark.createDataFrame(rows, schema), path)
    return path, {r.page_id: r for r in warc.read_pages(spark, path).collect()}


def test_revisits_refer_to_the_smallest_page(spark):
    long, short = "ü" * 50, "x" * 99  # 100 and 99 bytes
    path, out = round_trip(spark, [(5, "http://a/", long), (3, "http://b/\r\nX: 1", long), (9, None, long), (1, "u", short), (2, "u", short), (4, None, None), (6, "", "")])
    assert {k: (r.record_type, r.refers_to) for k, r in out.items()} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("revisit", 3), 6: ("response", None), 9: ("revisit", 3)}
    assert out[5].payload_bytes == 100 and out[5].payload_digest == hashlib.sha256(long.encode()).hexdigest()
    assert out[4].payload_bytes == 0
    stored = {r.record_id: r for r in spark.read.format("warc").load(path).collect()}
    assert stored["<urn:page:5>"].payload is None and bytes(stored["<urn:page:3>"].payload) == long.encode()


def test_null_page_ids_repeated_rows_and_binary_looking_text(spark):
    text = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 10 + "\x00\x1f\x8b"
    _, out = round_trip(spark, [(None, "u", text), (7, "u", text), (7, "u", text)])
    assert out[7].record_type == "response" and out[None].record_type == "response"
    assert out[7].payload_digest == hashlib.sha256(text.encode()).hexdigest()


def test_predicates_reach_the_source(spark):
    path, _ = round_trip(spark, [(i, f"http://h{i % 3}/p", "y" * 200 if i % 2 else f"z{i}") for i in range(20)])
    df = spark.read.format("warc").load(path)
    assert df.where("warc_type = 'revisit'").count() == 9
    assert df.where("target_uri like 'http://h1/%'").count() == 7
    assert df.where("record_id in ('<urn:page:2>', '<urn:page:4>') and warc_type = 'response'").count() == 2
    assert df.where("refers_to is not null").count() == 9
    assert df.where("refers_to is null").count() == 11
    without = spark.read.format("warc").option("payload", "false").load(path)
    assert without.where("payload is not null").count() == 0 and without.count() == 20


def test_pushed_filters_are_only_those_of_headers():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader({"path": "/x"})
    left = list(reader.pushFilters([EqualTo(("warc_type",), "response"), GreaterThan(("http_length",), 3), EqualTo(("payload",), b"")]))
    assert reader.tests == [("warc_type", "in", ("response",))] and len(left) == 2


def records(data: bytes, wanted=lambda v: True, with_payload=True):
    return list(warc.read_records(io.BytesIO(data), wanted, with_payload))


def test_unwanted_payloads_are_skipped_in_plain_and_zipped_files():
    one = warc.record_bytes({"record_id": "<a>", "warc_type": "response", "target_uri": "u"}, b"p" * 1_000_000, None)
    two = warc.record_bytes({"record_id": "<b>", "warc_type": "resource"}, b"q", None)
    for data in (one + two, gzip.decompress(one) + gzip.decompress(two)):
        assert [r[0] for r in records(data)] == ["<a>", "<b>"]
        assert records(data, lambda v: v["warc_type"] == "resource")[0][-1] == b"q"
        assert records(data, with_payload=False)[0][-2:] == (1_000_000, None)


def test_damaged_archives_are_reported():
    one = warc.record_bytes({"record_id": "<a>", "warc_type": "response"}, b"payload", None)
    with pytest.raises(ValueError):
        records(gzip.decompress(one)[:-10])
    with pytest.raises(ValueError):
        records(b"no archive\n")


def test_empty_table_and_missing_folder(spark):
    path, out = round_trip(spark, [])
    assert out == {}
    with pytest.raises(Exception, match="missing"):
        spark.read.format("warc").load(path + "/missing").count()


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, data):
        import io

        self.file, self.bytes = io.BytesIO(data), 0

    def read(self, n):
        out = self.file.read(n)
        self.bytes += len(out)
        return out

    def seek(self, *to):
        return self.file.seek(*to)


def test_unwanted_payloads_are_not_read():
    import gzip
    import random

    rng = random.Random(4)
    kinds = ["response" if i % 5 else "revisit" for i in range(50)]
    payloads = [rng.randbytes(300_000) if k == "response" else None for k in kinds]
    members = [warc.record_bytes({"record_id": f"<r{i}>", "warc_type": k}, p, 300_000) for i, (k, p) in enumerate(zip(kinds, payloads))]
    data = b"".join(members)
    assert gzip.decompress(data).count(b"WARC/1.1") == 50  # the extra field does not trouble other readers
    wanted = lambda kind: lambda values: values["warc_type"] == kind
    file = Counted(data)
    found = list(warc.read_records(file, wanted("revisit"), False))
    assert [r[0] for r in found] == [f"<r{i}>" for i in range(0, 50, 5)] and file.bytes < 0.5 * len(data)
    found = list(warc.read_records(Counted(data), wanted("response"), True))
    assert [r[-1] for r in found] == [p for p in payloads if p]
    plain = gzip.compress(gzip.decompress(data))  # all records in one member, without skip lengths
    assert [r[-1] for r in warc.read_records(Counted(plain), wanted("response"), True)] == [p for p in payloads if p]
    assert len(list(warc.read_records(Counted(gzip.decompress(data)), wanted("revisit"), False))) == 10
