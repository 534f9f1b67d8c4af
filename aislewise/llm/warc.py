"""A Spark data source for WARC archives, and pages written to and read from it.

Reading plans one partition for each bundle of files. Record-type and header predicates are pushed to it: a record's
header is parsed first, and the payload of a record that is not asked for is skipped, neither kept nor decoded: each
record is a gzip member that states its own length in a skip-lengths field ("sl"), and reading goes on behind it. In
archives without that field payloads are inflated to find their end. Files are reached through pyarrow's file systems, so a path may be in any store that these open.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from . import common

#: Bytes of a file after which a writing task starts the next, and bytes of files that a reading partition takes.
FILE_BYTES, PARTITION_BYTES = 256 << 20, 128 << 20
LEVEL = 3
#: Columns and the WARC header that each stands for.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "warc_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", http_length long, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this length are stored again rather than referred to.
LEAST_REVISIT = 100
_CHUNK = 1 << 16
#: The two line ends after a record.
_AFTER = b"\r\n\r\n"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """file:///x, file:/x and plain paths are local; other schemes are pyarrow's."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


# ---- records ------------------------------------------------------------------------------------------------------


def _header_value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(values: dict, payload: bytes | None, http_length: int | None) -> bytes:
    """One gzip member: WARC header, HTTP header with the full payload's length, then the payload unless it is None."""
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % (http_length if http_length is not None else len(payload or b"")) + (payload or b"")
    lines = ["WARC/1.1", *(f"{h}: {_header_value(values[c])}" for c, h in HEADERS.items() if values.get(c) is not None)]
    head = "\r\n".join([*lines, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""])
    return gzip_member(head.encode() + block + _AFTER)


def gzip_member(data: bytes) -> bytes:
    """data as a gzip member whose extra field gives the member's length and that of its data."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    size = 24 + len(packed) + 8
    extra = struct.pack("<2sHII", b"sl", 8, size, len(data)) if max(size, len(data)) < 1 << 32 else b""
    flags = b"\x04" if extra else b"\x00"
    head = b"\x1f\x8b\x08" + flags + b"\0\0\0\0\0\xff" + (struct.pack("<H", len(extra)) + extra if extra else b"")
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Stream:
    """Bytes of a file of gzip members, or of a plain file: read(n), line(), skip(n), and skip_record(n) by skip lengths."""

    def __init__(self, file):
        self.file, self.buffer, self.at, self.raw = file, b"", 0, file.read(_CHUNK)
        self.zipped, self.unzip = self.raw[:2] == b"\x1f\x8b", None

    def _begin(self) -> None:
        """At a member's first byte: its skip lengths, where it has them (member_left, member_size), and a decoder."""
        while len(self.raw) < 24 and (more := self.file.read(_CHUNK)):
            self.raw += more
        self.unzip, self.member_left, self.member_size, self.made = zlib.decompressobj(31), None, None, 0
        if len(self.raw) >= 24 and self.raw[3] & 4:
            name, size, *lengths = struct.unpack_from("<2sHII", self.raw, 12)
            if name == b"sl" and size == 8:
                self.member_left, self.member_size = lengths

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.file.read(_CHUNK)
                if not self.raw:
                    return False
            if not self.zipped:
                new, self.raw = self.raw, b""
            else:
                if self.unzip is None:
                    self._begin()
                before = len(self.raw)
                new = self.unzip.decompress(self.raw, _CHUNK)
                self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
                self.made += len(new)
                if self.member_left is not None:
                    self.member_left -= before - len(self.raw)
                if self.unzip.eof:
                    self.unzip = None
            if new:
                self.buffer, self.at = self.buffer[self.at :] + new, 0
                return True

    def skip_record(self, n: int) -> None:
        """Skips the n bytes that are left of a record; without decoding them if the record is the rest of its member."""
        held = len(self.buffer) - self.at
        if self.unzip is None or self.member_size is None or self.made - held + n + len(_AFTER) != self.member_size:
            self.skip(n)
            return
        self.buffer, self.at, self.unzip = b"", 0, None
        if self.member_left > len(self.raw):
            self.file.seek(self.member_left - len(self.raw), 1)
        self.raw = self.raw[self.member_left :]

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                return None
        found, self.at = self.buffer[self.at : end], end + 1
        return found.rstrip(b"\r")

    def read(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            part = self.buffer[self.at : self.at + left]
            parts.append(part)
            self.at += len(part)
            left -= len(part)
            if left and not self._more():
                raise ValueError("a record ends before its Content-Length")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            here = min(n, len(self.buffer) - self.at)
            self.at += here
            n -= here
            if n and not self._more():
                raise ValueError("a record ends before its Content-Length")


def read_records(file, wanted, with_payload: bool) -> Iterator[tuple]:
    """Rows in the order of SCHEMA of the records whose header values (a dict by column) are wanted."""
    stream = _Stream(file)
    while True:
        line = stream.line()
        while line == b"":  # the two line ends after a record
            line = stream.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        length = int(head.get("content-length", 0))
        values = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        if not wanted(values):
            stream.skip_record(length)
            continue
        http_length = None
        if head.get("content-type", "").startswith("application/http"):
            while length and (line := stream.line()) is not None:
                length -= len(line) + 2
                if not line:
                    break
                if line.lower().startswith(b"content-length:"):
                    http_length = int(line.partition(b":")[2])
        payload = None
        if with_payload and values["warc_type"] != "revisit":
            payload = stream.read(length)
        else:
            stream.skip_record(length)
        yield (*values.values(), http_length, payload)


# ---- the data source ----------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.with_payload, self.tests = options["path"], options.get("payload", "true").lower() != "false", []
        self.least_partitions = max(1, int(options.get("minpartitions", 1)))

    def pushFilters(self, filters):
        """Equality, membership, prefix and not-null tests of header columns are decided from headers alone."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "known", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Bundles of files of PARTITION_BYTES at most, smaller ones to have minpartitions of them; a file is never divided."""
        system, path = _file_system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in files if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz"))]
        bundles, size = [[]], 0
        most = min(PARTITION_BYTES, sum(f.size for f in files) // self.least_partitions + 1)
        for f in sorted(files, key=lambda f: f.path):
            if bundles[-1] and size + f.size > most:
                bundles.append([])
                size = 0
            bundles[-1].append(f.path)
            size += f.size
        return [Files(b) for b in bundles]

    def _wanted(self, values: dict) -> bool:
        for column, test, given in self.tests:
            v = values[column]
            if not (v in given if test == "in" else v is not None and (test == "known" or v.startswith(given))):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        names = [*HEADERS, "http_length", "payload"]
        types = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for path in partition.paths:
            rows, size = [], 0
            with system.open_input_file(path) as file:
                for row in read_records(file, self._wanted, self.with_payload):
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceWriter):
    """Tasks write under names of their own attempt; commit moves the files of the attempts that count into place."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"], columns

    def write(self, rows: Iterator[Row]) -> Written:
        system, path = _file_system(self.path)
        system.create_dir(f"{path}/_temporary", recursive=True)
        names, file, size = [], None, 0
        try:
            for row in rows:
                if file is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    file, size = system.open_output_stream(f"{path}/_temporary/{names[-1]}", compression=None), 0
                values = row.asDict()
                payload = values.get("payload")
                data = record_bytes(values, bytes(payload) if payload is not None else None, values.get("http_length"))
                file.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    file.close()
                    file = None
        finally:
            if file is not None:
                file.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _file_system(self.path)
        system.create_dir(path, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{path}/_temporary/{name}", f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, path = _file_system(self.path)
        if system.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary")


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").mode("append").save(path).

    Option payload=false leaves payloads null without reading them; minpartitions asks for that many reading tasks. Rows to write need columns named as in SCHEMA; all
    but record_id and warc_type may be missing or null. The WARC header lines of a null value are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---- pages --------------------------------------------------------------------------------------------------------


def write_pages(pages: DataFrame, path: str) -> None:
    """A record per row of pages (page_id, url, html): response, or revisit of the response with an equal payload.

    The payload is html in UTF-8 (null: empty). Of equal payloads of LEAST_REVISIT bytes or more, the rows with the
    smallest page_id are responses and the others revisit them; rows without a page_id are responses. Digests are
    counted before the join that finds a row's response, so a payload of a third of all pages is one row there.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("long")})
    light = pages.select("page_id", payload.alias("payload")).where((F.length("payload") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    repeated = light.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    repeated, _ = common.stored(repeated, "warc-repeated")
    joined = rows.join(common.broadcast_if_small(repeated, repeated.count(), 120), "digest", "left")
    revisit = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    joined.select(
        F.coalesce(name("page_id"), F.lit("<urn:page:>")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisit, name("first")).alias("refers_to"),
        F.when(revisit, REVISIT_PROFILE).alias("profile"),
        F.col("size").alias("http_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives under path.

    Responses are measured on their payload. Revisits are read by a second scan that asks for that record type alone
    and for no payload: their length and digest are those that their headers state for the full payload.
    """
    register(spark)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    tasks = str(2 * spark.sparkContext.defaultParallelism)
    full = spark.read.format("warc").option("minpartitions", tasks).load(path).where("warc_type = 'response'")
    full = full.select(page("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = spark.read.format("warc").option("minpartitions", tasks).option("payload", "false").load(path).where("warc_type = 'revisit'")
    again = again.select(page("record_id"), "http_length", F.substring_index("payload_digest", ":", -1), "warc_type", page("refers_to"))
    return full.union(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back; null html is an empty payload, equal small payloads are no revisits."""
    path = common.new_path(spark, "warc")
    write_pages(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_pages(spark, path)


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> f THEN f END AS refers_to
FROM r
"""
QUERIES = {"op4_warc_revisits": query}
