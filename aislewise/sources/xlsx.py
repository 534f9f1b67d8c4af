"""XLSX workbooks as a Python data source, to read and to write.

A workbook is a zip of XML parts. Each sheet is a partition, planned from the zip's directory alone; a task streams the
shared texts and the rows, so a sheet needs memory for its texts and one row.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal, InvalidOperation
from itertools import islice
from xml.etree import ElementTree as X
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: The size cap of a workbook's parts together, and the rows that a sheet may have.
MAX_UNPACKED, MAX_ROWS = 512 << 20, 1_048_576
#: Name spaces of the format, and number formats that are dates or times by their number alone.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


class WorkbookError(ValueError):
    """Why a file is no readable workbook."""


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)


# ---- reading ------------------------------------------------------------------------------------------------------


class Workbook:
    """An open workbook: sheets by name in their order, shared texts and styles on demand."""

    def __init__(self, file, most: int = MAX_UNPACKED):
        try:
            self.zip = zipfile.ZipFile(file)
        except zipfile.BadZipFile:
            raise WorkbookError("not a workbook: no zip file") from None
        size = sum(i.file_size for i in self.zip.infolist())  # as the directory says; no part is unpacked beyond it
        if size > most:
            raise WorkbookError(f"the workbook unpacks to {size} bytes, over {most}")
        try:
            targets = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels").iter(f"{_PACKAGE}Relationship")}
            book = self._tree("xl/workbook.xml")
            self.sheets = {s.get("name"): self._part(targets[s.get(_RELATION)]) for s in book.iter(f"{_MAIN}sheet")}
        except (KeyError, X.ParseError) as e:
            raise WorkbookError(f"not a workbook: {e}") from None
        own = book.find(f"{_MAIN}workbookPr")
        self.first_day = date(1904, 1, 1) if own is not None and own.get("date1904") in ("1", "true") else date(1899, 12, 30)

    def _tree(self, part: str):
        with self.zip.open(part) as file:
            return X.parse(_Guarded(file)).getroot()

    @staticmethod
    def _part(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _rows_of(self, part: str, tag: str) -> Iterator[X.Element]:
        """Elements of a part as they end, each forgotten after its turn."""
        with self.zip.open(part) as file:
            stream = X.iterparse(_Guarded(file), events=("start", "end"))
            _, root = next(stream)
            parents = [root]
            for event, element in stream:
                if event == "start":
                    parents.append(element)
                    continue
                parents.pop()
                if element.tag == tag:
                    yield element
                    parents[-1].remove(element)

    def texts(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        return ["".join(_text(e)) for e in self._rows_of("xl/sharedStrings.xml", f"{_MAIN}si")]

    def date_styles(self) -> set[int]:
        """Numbers of the cell styles that show a date or time."""
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = self._tree("xl/styles.xml")
        own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if _shows_date(f.get("formatCode") or "")}
        styles = root.find(f"{_MAIN}cellXfs")
        return {i for i, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId") or 0) in own | DATE_FORMATS}

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
        """(row number, texts of its cells by column) of a sheet's rows, as far as they are in the file."""
        texts, dates, last = self.texts(), self.date_styles(), 0
        for row in self._rows_of(self.sheets[sheet], f"{_MAIN}row"):
            last = int(row.get("r") or last + 1)
            cells: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = self._value(c, texts, dates)
            yield last, cells

    def _value(self, cell: X.Element, texts: list[str], dates: set[int]) -> str | None:
        kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(_text(cell))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return texts[int(v.text)]
        if kind == "b":
            return "true" if v.text.strip() == "1" else "false"
        if kind != "n":  # results of formulas, errors, ISO dates
            return v.text
        try:
            number = Decimal(v.text.strip())
        except InvalidOperation:
            return v.text
        return self._date(number) if int(cell.get("s") or 0) in dates else plain_number(number)

    def _date(self, days: Decimal) -> str:
        """ISO text of a serial number of days: a time alone under one day, a date alone at midnight."""
        seconds = round(days % 1 * 86_400)
        then = datetime.combine(self.first_day, datetime.min.time()) + timedelta(days=int(days), seconds=seconds)
        return then.time().isoformat() if 0 <= days < 1 else then.date().isoformat() if not seconds else then.isoformat()


class _Guarded:
    """A part without a document type: entities are what XML bombs are made of."""

    def __init__(self, file):
        self.file, self.head = file, b""

    def read(self, n: int = -1) -> bytes:
        data = self.file.read(n)
        window = self.head + data
        if b"<!DOCTYPE" in window or b"<!ENTITY" in window:
            raise WorkbookError("a part declares a document type")
        self.head = window[-9:]
        return data

    def close(self) -> None:
        self.file.close()


def _text(element: X.Element) -> Iterator[str]:
    """The text runs of a cell, without phonetic ones."""
    for child in element:
        if child.tag == f"{_MAIN}t":
            yield child.text or ""
        elif child.tag != f"{_MAIN}rPh":
            yield from _text(child)


def _shows_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code, flags=re.I)
    return bool(re.search(r"[dmyhs]", bare, re.I)) and bare.lower() != "general"


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def plain_number(number: Decimal) -> str:
    """A double's shortest text without exponent: 3, 2.5, 0.001."""
    short = Decimal(repr(float(number)))
    return format(short.quantize(Decimal(1)) if short == short.to_integral_value() else short.normalize(), "f")


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str

    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet


class XlsxReader(DataSourceReader):
    """One partition a sheet. Rows: _file, _sheet, _row (its number in the sheet), cells (header to text)."""

    def __init__(self, options: dict[str, str]):
        self.o, self.most = options, int(options.get("maxunpacked", MAX_UNPACKED))

    def _files(self) -> list[str]:
        from pyarrow import fs

        system, path = _system(self.o["path"])
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [self.o["path"]]
        if info.type != fs.FileType.Directory:
            raise FileNotFoundError(self.o["path"])
        found = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.extension == "xlsx" and not i.base_name.startswith(("_", ".")))
        return [f"{self.o['path'].rstrip('/')}/{name}" for name in found]

    def partitions(self) -> list[Sheet]:
        out = []
        for path in self._files():
            with self._open(path) as file:
                names = list(Workbook(file, self.most).sheets)
            wanted = self.o.get("sheet")
            if wanted == "*":
                out += [Sheet(path, name) for name in names]
            elif wanted is not None and wanted not in names:
                raise WorkbookError(f"{path}: no sheet {wanted!r}, there are {', '.join(map(repr, names))}")
            elif names:
                out.append(Sheet(path, wanted if wanted is not None else names[0]))
        return out

    @staticmethod
    def _open(path: str):
        system, at = _system(path)
        return system.open_input_file(at)

    def read(self, partition: Sheet) -> Iterator[tuple]:
        name = partition.path.rsplit("/", 1)[-1]
        with self._open(partition.path) as file:
            rows = Workbook(file, self.most).rows(partition.sheet)
            header = next(rows, None)
            if header is None:
                raise WorkbookError(f"{partition.path}: the sheet {partition.sheet!r} is empty")
            names = [(h or "").strip() for h in header[1]]
            needed = [n for n in filter(None, self.o.get("needed", "").split("\x1f")) if n not in names]
            if needed:
                raise WorkbookError(f"{partition.path}: columns missing: {', '.join(needed)}")
            for number, cells in rows:
                if any(c is not None and c.strip() for c in cells):
                    yield name, partition.sheet, number, {n: c for n, c in zip(names, cells) if n}


# ---- writing ------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class XlsxWriter(DataSourceWriter):
    """Each task writes a workbook, of as many sheets as its rows need; it gets its name when the job is committed.

    Another workbook begins where one comes to half of what may be unpacked, so that all can be read again.
    """

    def __init__(self, options: dict[str, str], schema, overwrite: bool):
        self.o, self.names, self.overwrite = options, schema.names, overwrite
        self.rows = min(int(options.get("sheetrows", MAX_ROWS)), MAX_ROWS) - 1
        self.most = int(options.get("maxunpacked", MAX_UNPACKED)) // 2

    def write(self, iterator) -> Written:
        system, folder = _system(self.o["path"])
        system.create_dir(folder, recursive=True)
        rows, paths = iter(iterator), []
        row = next(rows, None)
        while row is not None or not paths:
            paths.append(f"{folder.rstrip('/')}/_{uuid.uuid4().hex}.xlsx")
            with system.open_output_stream(paths[-1]) as file, zipfile.ZipFile(_Counted(file), "w", zipfile.ZIP_DEFLATED) as book:
                row = self._book(book, row, rows)
        return Written(paths)

    def _book(self, book: zipfile.ZipFile, row, rows: Iterator):
        """Writes row and rows as far as the workbook goes; the first row that is left."""
        n = size = 0
        while n == 0 or (row is not None and size < self.most):
            n += 1
            with book.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                sheet.write(_row_xml(1, self.names))
                for i in range(self.rows):
                    if row is None or size >= self.most:
                        break
                    size += sheet.write(_row_xml(i + 2, row))
                    row = next(rows, None)
                sheet.write(b"</sheetData></worksheet>")
        for part, text in _frame(n, self.o.get("sheet", "Sheet")).items():
            book.writestr(part, text)
        return row

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, folder = _system(self.o["path"])
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.is_file and info.extension == "xlsx" and not info.base_name.startswith("_"):
                    system.delete_file(info.path)
        for path in (p for m in filter(None, messages) for p in m.paths):
            head, name = path.rsplit("/", 1)
            system.move(path, f"{head}/book-{name[1:]}")

    def abort(self, messages) -> None:
        for path in (p for m in filter(None, messages) for p in m.paths):
            _system(self.o["path"])[0].delete_file(path)


class _Counted:
    """A stream that can tell its place but not go back, as zip files may be written."""

    def __init__(self, file):
        self.file, self.at = file, 0

    def write(self, data) -> int:
        self.file.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        self.file.flush()


def _row_xml(number: int, values) -> bytes:
    cells = []
    for i, v in enumerate(values):
        at = f'r="{_letters(i)}{number}"'
        if v is None:
            continue
        if isinstance(v, bool):
            cells.append(f'<c {at} t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, (int, float, Decimal)) and v == v and abs(v) != float("inf"):
            cells.append(f"<c {at}><v>{v}</v></c>")
        elif isinstance(v, (datetime, date)):
            days = (v.replace(tzinfo=None) if isinstance(v, datetime) else datetime.combine(v, datetime.min.time())) - datetime(1899, 12, 30)
            style = 2 if isinstance(v, datetime) else 1
            cells.append(f'<c {at} s="{style}"><v>{Decimal(days.days) + Decimal(days.seconds) / 86_400}</v></c>')
        else:
            text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "�", str(v))  # characters that XML has no form for
            cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'.encode()


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _frame(sheets: int, title: str) -> dict[str, str]:
    """The parts of a workbook beside its sheets. Names and types that the format asks for."""
    head, office = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    names = [title if n == 1 else f"{title} {n}" for n in range(1, sheets + 1)]
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in range(1, sheets + 1)) + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{_PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(t)} sheetId="{n}" r:id="rId{n}"/>' for n, t in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{_PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="rId{n}" Type="{office}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, sheets + 1))
        + f'<Relationship Id="rId{sheets + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }


# ---- Spark --------------------------------------------------------------------------------------------------------


class XlsxDataSource(DataSource):
    """Format "xlsx". Options to read: sheet (a name; first by default; "*" for all), maxunpacked; to write: sheet, sheetrows, maxunpacked."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "_file string, _sheet string, _row long, cells map<string,string>"

    def reader(self, schema) -> XlsxReader:
        return XlsxReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> XlsxWriter:
        return XlsxWriter({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def read_xlsx(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None, needed: list[str] | None = None) -> DataFrame:
    """The columns of workbooks as text, with _file and _row (S2): blank rows are skipped, dates are ISO text.

    path: a workbook or a folder of them, on any file system that Arrow opens. An error where a needed column (default:
    any of columns) or the sheet is missing, where a file is no workbook, or where it unpacks to more than MAX_UNPACKED.
    """
    spark.dataSource.register(XlsxDataSource)
    reader = spark.read.format("xlsx").option("needed", "\x1f".join(columns if needed is None else needed))
    rows = (reader if sheet is None else reader.option("sheet", sheet)).load(path)
    return rows.select(*[F.col("cells")[c].alias(c) for c in columns], "_file", "_row")


def write_xlsx(rows: DataFrame, path: str, sheet: str = "Sheet", mode: str = "append") -> None:
    """A workbook a task in a folder: numbers, booleans, dates and times as such, everything else as text."""
    rows.sparkSession.dataSource.register(XlsxDataSource)
    rows.write.format("xlsx").option("sheet", sheet).mode(mode).save(path)


def all_rows(book: Workbook, sheet: str, most: int | None = None) -> list[list[str | None]]:
    return [cells for _, cells in islice(book.rows(sheet), most)]
