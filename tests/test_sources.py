"""File, SQL, REST and XML sources."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from aislewise.sources import files, polling


def test_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("bill;qty\n B1 ;2\nB2;\n", encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), ["bill"], sep=";").orderBy("_row").collect()
    assert [(r.bill, r.qty, r._row) for r in rows] == [("B1", "2", 2), ("B2", None, 3)]
    with pytest.raises(ValueError, match="total"):
        files.read_csv(spark, str(tmp_path / "a.csv"), ["bill", "total"], sep=";")


def test_json_documents_and_lines(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"answer": {"rows": [{"a": 1}, {"a": 2}]}}, indent=1))
    assert [r.a for r in files.read_json_document(spark, str(tmp_path / "d.json"), "a int", "answer.rows").collect()] == [1, 2]
    (tmp_path / "l.json").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted((r.a is None, r.a, r._error) for r in files.read_ndjson(spark, str(tmp_path / "l.json"), "a int").collect() if r.a) == [(False, 1, None), (False, 2, None)]
    assert [r._error for r in files.read_ndjson(spark, str(tmp_path / "l.json"), "a int").collect() if r.a is None] == ["broken"]


def test_events_keep_their_data_as_text(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"id": "1", "data": {"b": 1}}\n\n{"id": "2"}\n')
    out = files.read_events(spark, str(tmp_path / "e.jsonl")).orderBy("arrival").collect()
    assert [(r.id, r.data) for r in out] == [("1", '{"b":1}'), ("2", None)]


def test_truth_files(spark, tmp_path):
    folder = tmp_path / "seq-1" / "gt"
    folder.mkdir(parents=True)
    (folder / "gt.txt").write_text("1,5,10,20,30,40,1,1,1.0\n1,6,0,0,5,5,0,1,1.0\n1,7,0,0,5,5,1,7,1.0\n2,5,0,0,1,1,1,3,1.0\n")
    people, ignored = files.read_mot_truth(spark, str(folder / "gt.txt"))
    assert [(r.sequence, r.track_id, r.x2, r.y2) for r in people.collect()] == [("seq-1", 5, 40.0, 60.0)]
    assert sorted(r.track_id for r in ignored.collect()) == [6, 7]


def test_watched_folder_moves_files_when_done(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": 1}\n')
    (tmp_path / "in" / "b.tmp").write_text('{"a": 2}\n')
    stream = files.watch_folder(spark, str(tmp_path / "in"), "a int", "*.json", str(tmp_path / "done"))
    query = stream.writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.a for r in spark.table("watched").collect()] == [1]


def test_log_is_partitioned_and_expires(spark, tmp_path):
    day = 86_400_000
    rows = spark.createDataFrame([("s", "t", i, i * day) for i in range(40)], "store_id string, type string, t_ms long, received_ms long")
    files.write_log(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 40 and files.expired_days(log, F.date_add(F.to_date(F.lit("1970-01-01")), 39)).count() == 9


def test_outbox(spark):
    box = spark.createDataFrame([("a", i, "sent" if i < 4 else "pending", 10) for i in range(6)], "source string, sequence long, state string, bytes long")
    assert {(r.state, r.rows, r.bytes) for r in files.outbox_stats(box).collect()} == {("sent", 4, 40), ("pending", 2, 20)}
    assert [r.sequence for r in files.outbox_evictions(box, 35).orderBy("sequence").collect()] == [0, 1, 2]


def test_rows_of_csv_files_are_numbered_over_blocks(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 3)):
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "".join(f"{i},{'v' * 50}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        rows = files.read_csv(spark, str(tmp_path), ["x"])
        assert rows.rdd.getNumPartitions() > 2
        got = sorted((r._file, r._row, int(r.x)) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("a.csv", i + 2, i) for i in range(4000)] + [("b.csv", i + 2, i) for i in range(3)]


def test_files_settle_before_they_are_taken_and_bad_ones_are_set_aside(spark, tmp_path):
    import os
    import time

    (tmp_path / "in").mkdir()
    for name, age in (("a.json", 60), ("b.json", 60), ("new.json", 0), ("c.txt", 60)):
        (tmp_path / "in" / name).write_text('{"x": 1}\n')
        os.utime(tmp_path / "in" / name, (time.time() - age,) * 2)
    folder = lambda n: f"file://{tmp_path}/{n}"
    taken = files.take_settled(spark, folder("in"), "*.json", folder("work"), min_age_s=30)
    assert [t.rsplit("/", 1)[1] for t in taken] == ["a.json", "b.json"] and sorted(os.listdir(tmp_path / "in")) == ["c.txt", "new.json"]
    good, failed = files.finish_files(spark, taken, spark.createDataFrame([("b.json",)], "_file string"), folder("done"), folder("failed"))
    assert len(good) == len(failed) == 1 and os.listdir(tmp_path / "done") == ["a.json"] and os.listdir(tmp_path / "failed") == ["b.json"]


def test_batches_are_posted_in_order_and_paced(spark):
    import time

    seen = []

    class Sink(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(202)
            self.end_headers()

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Sink)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([(i * 100, f"e{i}") for i in range(10)], "t_ms long, id string").coalesce(1)
    began = time.time()
    answers = files.post_batches(rows, f"http://127.0.0.1:{http.server_port}", "t_ms", speed=2.0, batch=4).collect()
    http.shutdown()
    assert [(a.rows, a.status) for a in answers] == [(4, 202), (4, 202), (2, 202)] and time.time() - began >= 0.25
    assert [e["id"] for batch in seen for e in batch] == [f"e{i}" for i in range(10)]


def test_look_back_reads_late_rows_again_and_never_stands_still(spark):
    rows = spark.createDataFrame([(c,) for c in (1, 5, 6, 7, 8, 9)], "c int")
    page = lambda after, limit: sorted(r.c for r in polling.cursor_page(rows, "c", after, limit, 3).collect())
    assert page(7, 1) == [5, 6, 7, 8] and page(9, 1) == [7, 8, 9] and page(20, 5) == []


def test_rest_changes_since_and_unknown_page_counts():
    reader = polling.RestReader({"path": "http://h/x?a=1", "since": "2024-01-02T00:00:00", "lookback": "3600", "sinceparam": "after", "paging": "page", "pagesize": "2", "pages": "2"})
    assert [p.url for p in reader.partitions()][1] == "http://h/x?a=1&after=2024-01-01T23%3A00%3A00&page=2&per_page=2"


@pytest.mark.parametrize("sql", ["SELECT 1; DROP TABLE x", "DELETE FROM x", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "SELECT * INTO y FROM x", ""])
def test_statements_that_write_are_refused(sql):
    with pytest.raises(ValueError):
        polling.checked_select(sql)


def test_select_may_name_forbidden_words_in_texts():
    assert polling.checked_select("SELECT 'drop; it' AS a -- delete\nFROM t;").startswith("SELECT 'drop")


def test_pages_never_divide_a_cursor_value(spark):
    rows = spark.createDataFrame([(c,) for c in (1, 2, 2, 2, 3, 4)], "c int")
    assert sorted(r.c for r in polling.cursor_page(rows, "c", None, 2).collect()) == [1, 2, 2, 2]
    assert sorted(r.c for r in polling.cursor_page(rows, "c", 2, 1).collect()) == [3]
    assert polling.cursor_page(rows, "c", 4, 5).count() == 0


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        url = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        host = f"http://{self.headers['Host']}"
        rows, body, link = [{"n": i} for i in range(5)], None, None
        if url.path == "/page":
            at = (int(q["page"]) - 1) * int(q["per_page"])
            body = {"data": {"rows": rows[at : at + int(q["per_page"])]}}
        elif url.path == "/offset":
            body = rows[int(q["offset"]) : int(q["offset"]) + int(q["limit"])]
        else:
            at = int(q.get("cursor", 0))
            more = at + 2 < 5
            if url.path == "/cursor":
                body = {"rows": rows[at : at + 2], "next": at + 2 if more else None}
            elif url.path == "/next":
                body = {"rows": rows[at : at + 2], "nextUrl": f"{host}/next?cursor={at + 2}" if more else None}
            else:
                body = rows[at : at + 2] if url.path == "/link" else rows
                link = f'<{host}/link?cursor={at + 2}>; rel="next"' if url.path == "/link" and more else None
        self.send_response(200)
        if link:
            self.send_header("Link", link)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    http = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


@pytest.mark.parametrize("paging,path,options", [("none", "/all", {}), ("page", "/page", {"at": "data.rows", "pagesize": 2, "pages": 3}), ("offset", "/offset", {"pagesize": 2, "pages": 3}), ("page", "/page", {"at": "data.rows", "pagesize": 2}), ("offset", "/offset", {"pagesize": 2}), ("cursor", "/cursor", {"at": "rows"}), ("nexturl", "/next", {"at": "rows"}), ("link", "/link", {})])
def test_rest_pages(spark, server, paging, path, options):
    spark.dataSource.register(polling.RestDataSource)
    rows = spark.read.format("rest_pages").option("paging", paging).options(**options).load(server + path)
    assert sorted(json.loads(r.record)["n"] for r in rows.collect()) == [0, 1, 2, 3, 4]


def test_vouchers(spark, tmp_path):
    item = "<ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>Tea</STOCKITEMNAME><ACTUALQTY> 1,002.5 kg</ACTUALQTY><AMOUNT>-20.10</AMOUNT></ALLINVENTORYENTRIES.LIST>"
    (tmp_path / "v.xml").write_text(f"<E><VOUCHER><VOUCHERTYPENAME>Sales</VOUCHERTYPENAME><VOUCHERNUMBER>7</VOUCHERNUMBER><DATE>20240102</DATE>{item}{item}</VOUCHER><VOUCHER><VOUCHERTYPENAME>Memo</VOUCHERTYPENAME><VOUCHERNUMBER>8</VOUCHERNUMBER></VOUCHER></E>")
    vouchers = polling.read_vouchers(spark, str(tmp_path / "v.xml"))
    assert sorted((r.number, r.kind) for r in vouchers.collect()) == [("7", "bill"), ("8", None)]
    assert [(r.line_no, r.sku, r.qty_milli, r.amount_minor) for r in polling.voucher_lines(vouchers).orderBy("line_no").collect()] == [(1, "Tea", 1_002_500, 2010), (2, "Tea", 1_002_500, 2010)]
