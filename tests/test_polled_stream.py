"""REST and SQL sources as streams: every record once in the sink, also where a query dies and starts again."""

from __future__ import annotations

import json
import sqlite3
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from aislewise.sources import http as H
from aislewise.sources import polled_stream as S
from aislewise.sources import polling


class Resource(BaseHTTPRequestHandler):
    """Records with rising change times, in pages of any style; the first answers of /busy are refusals."""

    records: list[dict] = []
    refusals = 0
    asked: list[str] = []

    def do_GET(self):
        url = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        Resource.asked.append(self.path)
        if url.path == "/busy" and Resource.refusals:
            Resource.refusals -= 1
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        if url.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "http://127.0.0.1:1/")
            self.end_headers()
            return
        rows = [r for r in Resource.records if "since" not in q or r.get("updated") is None or r["updated"] >= q["since"]]
        host, size = f"http://{self.headers['Host']}", 4
        start = (int(q["page"]) - 1) * size if "page" in q else int(q.get("offset", q.get("cursor", 0)))
        page, more = rows[start : start + size], start + size < len(rows)
        self.send_response(200)
        if url.path == "/link" and more:
            self.send_header("Link", f'<{host}/link?cursor={start + size}&since={q.get("since", "")}>; rel="next"')
        self.end_headers()
        foreign = "http://elsewhere:1/x" if url.path == "/foreign" else f"{host}/next?cursor={start + size}&since={q.get('since', '')}"
        self.wfile.write(json.dumps({"rows": page, "next": start + size if more else None, "nextUrl": foreign if more else None}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    http = HTTPServer(("127.0.0.1", 0), Resource)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    Resource.records, Resource.asked, Resource.refusals = [record(i) for i in range(10)], [], 0
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def record(i, minute=None):
    return {"id": i, "updated": f"2024-01-01T00:{(i if minute is None else minute):02d}:00+00:00"}


STYLES = [("cursor", "/cursor", {}), ("nexturl", "/next", {}), ("link", "/link", {}), ("page", "/page", {"pagesize": 4}), ("page", "/page", {"pagesize": 4, "readers": 3}), ("offset", "/offset", {"pagesize": 4})]


def rest(spark, url, paging, **options):
    spark.dataSource.register(polling.RestDataSource)
    return spark.readStream.format("rest_pages").option("paging", paging).option("at", "rows").options(**options).load(url)


def finished(query):
    query.awaitTermination(120)
    return query.exception()


def ids(spark, path):
    return sorted(json.loads(r.record)["id"] for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("paging,path,options", STYLES)
def test_every_style_of_pages_gives_what_is_new(server, paging, path, options):
    reader = S.RestStreamReader({"path": server + path, "paging": paging, "at": "rows", **options})
    low, high = reader.initialOffset(), reader.latestOffset()
    read = lambda a, b: sorted(json.loads(t)["id"] for p in reader.partitions(a, b) for (t,) in reader.read(p))
    assert read(low, high) == list(range(10)) and reader.latestOffset() == high and read(high, high) == []
    Resource.records += [record(i) for i in range(10, 13)] + [{"id": 99}]
    assert read(high, reader.latestOffset()) == [10, 11, 12] and read(low, high) == list(range(10))  # ranges can be read again


def test_each_poll_takes_what_is_new(spark, server, tmp_path):
    paging, path, options = STYLES[4]
    run = lambda: finished(S.keep_records(rest(spark, server + path, paging, progress=str(tmp_path / "progress"), **options), str(tmp_path / "out"), str(tmp_path / "check")))
    assert run() is None and ids(spark, str(tmp_path / "out")) == list(range(10))
    assert run() is None and ids(spark, str(tmp_path / "out")) == list(range(10))  # nothing is new
    Resource.records += [record(i) for i in range(10, 13)] + [{"id": 99}]
    assert run() is None and ids(spark, str(tmp_path / "out")) == list(range(13))
    kept = json.loads((tmp_path / "progress" / "progress.json").read_text())
    assert kept == {"cursor": record(9)["updated"]}  # Spark tells the source of a batch when it plans the next


@pytest.mark.parametrize("keeps_progress", [True, False])
def test_a_query_that_dies_after_its_sink_wrote_repeats_the_same_range(spark, server, tmp_path, keeps_progress):
    """The second batch's sink writes and then fails; before the restart the source gets more. No record is there twice, none is missing."""
    out, more = str(tmp_path / "out"), {"progress": str(tmp_path / "progress")} if keeps_progress else {}
    assert finished(S.keep_records(rest(spark, server + "/cursor", "cursor", **more), out, str(tmp_path / "check"))) is None
    Resource.records += [record(i) for i in range(10, 15)]

    def dying(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        raise RuntimeError("the power is gone")

    stream = rest(spark, server + "/cursor", "cursor", **more)
    with pytest.raises(Exception, match="the power is gone"):
        stream.writeStream.foreachBatch(dying).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    if keeps_progress:  # nothing of the batch that failed
        assert json.loads((tmp_path / "progress" / "progress.json").read_text()) == {"cursor": record(9)["updated"]}
    Resource.records += [record(i) for i in range(15, 20)]
    assert finished(S.keep_records(rest(spark, server + "/cursor", "cursor", **more), out, str(tmp_path / "check"))) is None
    assert finished(S.keep_records(rest(spark, server + "/cursor", "cursor", **more), out, str(tmp_path / "check"))) is None
    assert ids(spark, out) == list(range(20))
    by_batch = {r.batch: r.n for r in spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert by_batch[1] == 5  # the range it had, though more had come


def test_look_back_reads_again_and_late_records_come(spark, server, tmp_path):
    options = {"lookback": "PT3M", "progress": str(tmp_path / "progress")}
    run = lambda: finished(S.keep_records(rest(spark, server + "/cursor", "cursor", **options), str(tmp_path / "out"), str(tmp_path / "check")))
    assert run() is None
    Resource.records += [record(50, minute=8), record(10)]  # 50 came late, behind the cursor
    assert run() is None
    found = Counter(ids(spark, str(tmp_path / "out")))
    assert found.keys() == {*range(11), 50} and found[50] == 1 and {i for i, n in found.items() if n == 2} == {7, 8, 9}
    rows = spark.read.parquet(str(tmp_path / "out")).select(F.get_json_object("record", "$.id").alias("id"), "batch")
    assert polling.latest_per(rows, ["id"], "batch").count() == 12


def test_pages_of_a_micro_batch_never_divide_a_cursor_value(spark, server, tmp_path):
    """Ordered pages of four: a value that goes on over a page's end waits for the batch that has all of it."""
    Resource.records = [record(i, minute=m) for i, m in enumerate([0, 1, 2, 3, 3, 3, 3, 3, 3, 4, 5])]
    reader = S.RestStreamReader({"path": server + "/cursor", "paging": "cursor", "at": "rows", "ordered": "true", "maxpages": "1"})
    low, seen = reader.initialOffset(), []
    for _ in range(9):
        high = reader.latestOffset()
        seen.append([json.loads(t)["id"] for p in reader.partitions(low, high) for (t,) in reader.read(p)])
        low = high
    assert [i for batch in seen for i in batch] == list(range(11)) and [3, 4, 5, 6, 7, 8] in [s[-6:] for s in seen]
    assert seen[0] == [0, 1, 2] and seen[-1] == []


def test_busy_servers_are_asked_again_and_others_are_failures(server):
    Resource.refusals = 2
    pauses = []
    assert H.get(server + "/busy", sleep=pauses.append)[0]["rows"] and pauses == [0.0, 0.0]
    Resource.refusals = 9
    with pytest.raises(H.SourceFailure, match="503 after 3"):
        H.get(server + "/busy", repeats=2, sleep=pauses.append)
    with pytest.raises(H.SourceFailure, match="HTTP 302"):
        H.get(server + "/moved", sleep=pauses.append)
    with pytest.raises(H.SourceFailure, match="after 2 attempts"):
        H.get("http://127.0.0.1:1/", repeats=1, sleep=pauses.append)
    with pytest.raises(H.SourceFailure, match="another host"):
        list(H.Pages({"paging": "nextUrl", "at": "rows"}, server + "/foreign").follow())
    with pytest.raises(H.SourceFailure, match="no list"):
        list(H.Pages({"at": "rows.x"}, server + "/cursor").follow())


@pytest.mark.parametrize("kind,value,back,then", [("epoch_ms", "5000", "PT2S", 3000), ("epoch_s", 90, "PT1M", 30), ("number", "7", "2", "5"), ("iso8601", "2024-01-01T00:00:10", "PT10S", "2024-01-01T00:00:00"), ("%d.%m.%Y", "02.01.2024", "P1D", "01.01.2024"), ("text", "b", None, "b")])
def test_cursor_formats(kind, value, back, then):
    cursor = S.Cursor(kind)
    assert cursor.before(value, back) == then
    assert cursor.within(value, then if back else None, value) and not cursor.within(value, value, value)


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "pos.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE bills (id INTEGER, rev INTEGER, note TEXT)")
        db.executemany("INSERT INTO bills VALUES (?, ?, ?)", [(i, i // 3, f"n{i}") for i in range(30)] + [(98, None, "no revision")])
    return path


def sql(spark, database, **options):
    spark.dataSource.register(S.SqlDataSource)
    return spark.readStream.format("sql_poll").options(module="sqlite3", connect=json.dumps({"database": database}), query="SELECT id, rev, note FROM bills WHERE note <> 'drop'", cursor="rev", **options).load()


@pytest.mark.parametrize("options", [{"pagerows": 10}, {"pagerows": 12, "readers": 3}])
def test_a_table_is_polled_by_its_cursor(spark, database, tmp_path, options):
    run = lambda: finished(S.keep_records(sql(spark, database, progress=f"file://{tmp_path}/progress", **options), str(tmp_path / "out"), str(tmp_path / "check")))
    for _ in range(4):
        assert run() is None
    assert ids(spark, str(tmp_path / "out")) == list(range(30))
    whole = spark.read.parquet(str(tmp_path / "out")).select("batch", F.get_json_object("record", "$.rev").alias("rev")).distinct()
    assert whole.count() == 10  # no revision is in two batches
    with sqlite3.connect(database) as db:
        db.executemany("INSERT INTO bills VALUES (?, ?, ?)", [(30, 10, "x"), (31, 11, "drop")])
    assert run() is None and ids(spark, str(tmp_path / "out")) == list(range(31))


def test_odd_statements_and_columns_are_refused(database):
    base = {"module": "sqlite3", "connect": json.dumps({"database": database})}
    for query, cursor in (("DELETE FROM bills", "rev"), ("SELECT 1; SELECT 2", "rev"), ("SELECT * FROM bills", "rev; DROP")):
        with pytest.raises(ValueError):
            S.SqlStreamReader(base | {"query": query, "cursor": cursor})
