"""REST resources and SQL tables as streams: cursors as offsets, ranges that can be read again, progress kept at commit.

A micro-batch is a half-open range of cursor values, so a batch that failed is read again by the same range, whatever has
come to the source since. Spark tells a source of a finished batch only when the sink has it, as it plans the next one
(D10); that is when a reader keeps its progress, from which a restarted query looks for news.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from aislewise.functions.settings import duration_ms

from .http import Pages, at


class Cursor:
    """Cursor values of one format: epoch_ms, epoch_s, number, text, iso8601 or a pattern of strptime.

    Offsets hold them as they came; they are compared, and looked back from, as what they mean.
    """

    def __init__(self, kind: str = "iso8601"):
        self.kind = kind

    def meaning(self, value):
        if value is None or isinstance(value, datetime):
            return value
        if self.kind in ("epoch_ms", "epoch_s"):
            return int(Decimal(str(value)))
        if self.kind == "number":
            return Decimal(str(value))
        if self.kind == "text":
            return str(value)
        if self.kind == "iso8601":
            return datetime.fromisoformat(str(value))
        return datetime.strptime(str(value), self.kind)

    def before(self, value, look_back: str | None):
        """value less an ISO 8601 duration (a plain number for the kind number), in the same format."""
        if value is None or not look_back:
            return value
        own = self.meaning(value)
        if self.kind == "text":
            raise ValueError("a text cursor has nothing to look back by")
        if self.kind == "number":
            return str(own - Decimal(look_back))
        back = duration_ms(look_back)
        if self.kind in ("epoch_ms", "epoch_s"):
            return own - (back if self.kind == "epoch_ms" else back // 1000)
        then = own - timedelta(milliseconds=back)
        return then.isoformat() if self.kind == "iso8601" else then.strftime(self.kind)

    def within(self, value, low, high) -> bool:
        """low < value <= high; a missing low is no bound."""
        own = self.meaning(value)
        return (low is None or own > self.meaning(low)) and own <= self.meaning(high)


class Progress:
    """The last committed cursor in a file of a folder that driver hosts share (any address that Arrow opens); optional."""

    def __init__(self, folder: str | None):
        self.folder = folder

    def _file(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        return system, path.rstrip("/")

    def load(self) -> dict | None:
        if not self.folder:
            return None
        system, path = self._file()
        try:
            with system.open_input_stream(f"{path}/progress.json") as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def keep(self, offset: dict) -> None:
        if not self.folder:
            return
        system, path = self._file()
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/progress.tmp") as file:
            file.write(json.dumps(offset).encode())
        system.move(f"{path}/progress.tmp", f"{path}/progress.json")


@dataclass
class Range(InputPartition):
    """What one task reads: cursors over low up to high; of numbered pages every step-th from first on."""

    low: object
    high: object
    first: int = 0
    step: int = 1

    def __init__(self, low, high, first: int = 0, step: int = 1):
        self.low, self.high, self.first, self.step = low, high, first, step


class PolledReader(DataSourceStreamReader):
    """What both sources share: offsets {"cursor": value}, and that they never go back.

    Options: cursorformat, start (first cursor, not included), lookback, progress (folder).
    """

    def __init__(self, options: dict[str, str]):
        self.o = options
        self.cursor = Cursor(options.get("cursorformat", "iso8601"))
        self.progress = Progress(options.get("progress"))
        self.known = None  # the furthest cursor that this query is known to have planned

    def initialOffset(self) -> dict:
        return {"cursor": self.o.get("start")}

    def latestOffset(self) -> dict:
        if self.known is None:
            self.known = (self.progress.load() or self.initialOffset())["cursor"]
        newest = self.newest(self.known)
        self._reach(newest)
        return {"cursor": self.known}

    def _reach(self, cursor) -> None:
        if cursor is not None and (self.known is None or self.cursor.meaning(cursor) > self.cursor.meaning(self.known)):
            self.known = cursor

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = start["cursor"], end["cursor"]
        self._reach(high)
        if high is None or (low is not None and self.cursor.meaning(high) <= self.cursor.meaning(low)):
            return []
        return self.ranges(self.cursor.before(low, self.o.get("lookback")), high)

    def commit(self, end: dict) -> None:
        self.progress.keep(end)


class RestStreamReader(PolledReader):
    """A REST resource whose records have a cursor field, such as the time of their last change.

    Further options: cursor (dotted path in a record), sinceparam, ordered ("true": records come by rising cursor),
    maxpages (pages of a micro-batch, where ordered), readers (tasks of numbered pages), and those of Pages. Records
    without a cursor are no part of any range and are left out.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.field, self.ordered = options.get("cursor", "updated"), options.get("ordered", "false").lower() == "true"

    def _pages(self, since, first: int = 0, step: int = 1) -> Iterator[list]:
        params = {} if since is None else {self.o.get("sinceparam", "since"): since}
        return Pages(self.o, self.o["path"]).follow(first, step, **params)

    def newest(self, known):
        """The greatest cursor there is; with ordered pages that of the last value that maxpages pages hold whole."""
        most, best, whole = int(self.o.get("maxpages", 0)), known, None
        for n, page in enumerate(self._pages(known), 1):
            for value in (at(r, self.field) for r in page):
                if value is not None and (best is None or self.cursor.meaning(value) > self.cursor.meaning(best)):
                    best, whole = value, best
            if self.ordered and most and n >= most and whole is not None and (known is None or self.cursor.meaning(whole) > self.cursor.meaning(known)):
                return whole  # the next page may have more of the last value
        return best

    def ranges(self, low, high) -> list[Range]:
        tasks = int(self.o.get("readers", 1)) if self.o.get("paging", "none").lower() in ("page", "offset") else 1
        return [Range(low, high, k, tasks) for k in range(tasks)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for page in self._pages(partition.low, partition.first, partition.step):
            for record in page:
                value = at(record, self.field)
                if value is None:
                    continue
                if self.cursor.within(value, partition.low, partition.high):
                    yield (json.dumps(record, ensure_ascii=False),)
                elif self.ordered and self.cursor.meaning(value) > self.cursor.meaning(partition.high):
                    return


class SqlStreamReader(PolledReader):
    """A SELECT over a database with a Python driver (DB-API), polled by a cursor column.

    Further options: module (the driver's), connect (JSON of connect()'s arguments), query (one read-only SELECT),
    cursor (a column of it), pagerows (about how many rows a micro-batch has; rows of one cursor value stay together),
    readers (tasks of a micro-batch), placeholder. cursorformat is number, text or a time's format as the database gives it.
    """

    def __init__(self, options: dict[str, str]):
        from .polling import checked_select

        super().__init__({"cursorformat": "number"} | options)
        self.sql, self.column = checked_select(options["query"]), options["cursor"]
        if not self.column.replace("_", "a").isalnum():
            raise ValueError(f"not a column: {self.column!r}")

    def _rows(self, columns: str, low, high=None, order: bool = False) -> Iterator[tuple[list[str], tuple]]:
        mark = self.o.get("placeholder", "?")
        bounds = [(f"{self.column} > {mark}", low)] * (low is not None) + [(f"{self.column} <= {mark}", high)] * (high is not None)
        where = " AND ".join([f"{self.column} IS NOT NULL", *(b for b, _ in bounds)])
        sql = f"SELECT {columns} FROM ({self.sql}) polled WHERE {where}" + f" ORDER BY {self.column}" * order
        connection = importlib.import_module(self.o["module"]).connect(**json.loads(self.o.get("connect", "{}")))
        try:
            cursor = connection.cursor()
            cursor.execute(sql, tuple(self._bound(v) for _, v in bounds))
            names = [d[0] for d in cursor.description]
            while rows := cursor.fetchmany(1000):
                yield from ((names, r) for r in rows)
        finally:
            connection.close()

    def _bound(self, value):
        if self.cursor.kind == "number":
            number = Decimal(str(value))
            return int(number) if number == int(number) else float(number)
        return value

    @staticmethod
    def _plain(value):
        return value.isoformat() if isinstance(value, datetime) else str(value) if isinstance(value, Decimal) else value

    def newest(self, known):
        """The cursor of the pagerows-th row after known, or of the last; only so many cursor values come to the driver."""
        last, rows = None, self._rows(self.column, known, order=True)
        for n, (_, row) in enumerate(rows, 1):
            last = row[0]
            if n >= int(self.o.get("pagerows", 100_000)):
                rows.close()
                break
        return known if last is None else self._plain(last)

    def ranges(self, low, high) -> list[Range]:
        tasks = int(self.o.get("readers", 1))
        if tasks < 2:
            return [Range(low, high)]
        values = [self._plain(r[0]) for _, r in self._rows(self.column, low, high, order=True)]
        borders = sorted({values[len(values) * k // tasks] for k in range(1, tasks)} - {high}, key=self.cursor.meaning) if values else []
        return [Range(a, b) for a, b in zip([low, *borders], [*borders, high])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for names, row in self._rows("*", partition.low, partition.high):
            yield (json.dumps(dict(zip(names, row)), default=str, ensure_ascii=False),)


class SqlDataSource(DataSource):
    """spark.readStream.format("sql_poll").options(...).load(): one column, the row as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "sql_poll"

    def schema(self) -> str:
        return "record string"

    def streamReader(self, schema) -> SqlStreamReader:
        return SqlStreamReader({k.lower(): v for k, v in self.options.items()})


def keep_records(stream, path: str, checkpoint: str):
    """Starts a query that appends a polled stream's records to a table of batches; a repeated batch replaces its own."""

    def write(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
