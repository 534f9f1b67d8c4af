"""XLSX workbooks: what is written is read again, and workbooks as other programs write them."""

from __future__ import annotations

import io
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest

from aislewise.sources import xlsx

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(path, sheets, shared=(), styles=None, **parts):
    """sheets: {name: XML of its rows}; shared: XML of shared texts."""
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{office}">{parts.pop("properties", "")}<sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'{HEAD}<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f'{HEAD}<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
        for name, text in parts.items():
            z.writestr(name, text)
    return str(path)


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy hh:mm"/><numFmt numFmtId="165" formatCode="#,##0.00 &quot;days&quot;"/><numFmt numFmtId="166" formatCode="[Red]0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="20"/></cellXfs>'
SHARED = ["<t>Bill</t>", "<r><t>Am</t></r><r><rPr/><t>ount</t></r><rPh><t>x</t></rPh>", '<t xml:space="preserve"> tea </t>', "<t></t>"]
FIRST = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t> When </t></is></c><c r="E1" t="str"><f>1</f><v>Ok</v></c></row>'
    '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>9</v></c><c r="C2"><v>12</v></c><c r="D2" s="1"><v>45292</v></c><c r="E2" t="b"><v>1</v></c></row>'
    '<row r="3"><c r="A3" t="s"><v>3</v></c><c r="C3"/></row>'
    '<row r="7"><c r="C7" s="3"><v>0.1</v></c><c r="D7" s="2"><v>45292.75</v></c><c r="E7" t="e"><v>#N/A</v></c></row>'
    '<row><c><v>1E3</v></c><c/><c s="4"><v>2.50</v></c><c s="5"><v>0.5</v></c></row>'
)


def test_a_workbook_of_another_program(spark, tmp_path):
    path = workbook(tmp_path / "b.xlsx", {"First": FIRST, "Other": '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>5</v></c></row>'}, SHARED, STYLES)
    rows = xlsx.read_xlsx(spark, path, ["Bill", "Amount", "When", "Ok"]).collect()
    assert [tuple(r) for r in rows] == [
        (" tea ", "12", "2024-01-01", "true", "b.xlsx", 2), (None, "0.1", "2024-01-01T18:00:00", "#N/A", "b.xlsx", 7), ("1000", "2.5", "12:00:00", None, "b.xlsx", 8),
    ]
    assert [tuple(r) for r in xlsx.read_xlsx(spark, f"file://{path}", ["Bill"], "Other").collect()] == [("5", "b.xlsx", 2)]
    spark.dataSource.register(xlsx.XlsxDataSource)
    every = spark.read.format("xlsx").option("sheet", "*").load(str(tmp_path))
    assert every.rdd.getNumPartitions() == 2 and sorted((r._sheet, r._row) for r in every.collect()) == [("First", 2), ("First", 7), ("First", 8), ("Other", 2)]


def test_days_from_1904(tmp_path):
    path = workbook(tmp_path / "b.xlsx", {"S": '<row r="1"><c r="A1" s="1"><v>1</v></c></row>'}, (), STYLES, properties='<workbookPr date1904="1"/>')
    assert xlsx.all_rows(xlsx.Workbook(path), "S") == [["1904-01-02"]]


def test_what_is_refused(spark, tmp_path):
    good = workbook(tmp_path / "good.xlsx", {"S": FIRST}, SHARED)
    for match, call in (
        ("no sheet 'X', there are 'S'", lambda: xlsx.read_xlsx(spark, good, ["Bill"], "X")), ("columns missing: Total", lambda: xlsx.read_xlsx(spark, good, ["Bill", "Total"])),
        ("no zip file", lambda: xlsx.read_xlsx(spark, _file(tmp_path / "text.xlsx", b"a,b\n1,2\n"), ["a"])), ("not a workbook", lambda: xlsx.read_xlsx(spark, _zip(tmp_path / "zip.xlsx", {"a.txt": "x"}), ["a"])),
        ("is empty", lambda: xlsx.read_xlsx(spark, workbook(tmp_path / "none.xlsx", {"S": ""}), ["a"])),
        ("over 536870912", lambda: xlsx.read_xlsx(spark, _zip(tmp_path / "bomb.xlsx", {"xl/worksheets/s0.xml": b"\0" * (600 << 20)}), ["a"])),
        ("document type", lambda: xlsx.read_xlsx(spark, workbook(tmp_path / "lol.xlsx", {"S": ""}, **{"xl/sharedStrings.xml": f'{HEAD}<!DOCTYPE x [<!ENTITY a "aaaa">]><sst xmlns="{MAIN}"><si><t>&a;</t></si></sst>'}), ["a"])),
    ):
        with pytest.raises(Exception, match=match):
            call().collect()


def _file(path, data):
    path.write_bytes(data)
    return str(path)


def _zip(path, parts):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return str(path)


def test_what_is_written_is_read_again(spark, tmp_path):
    texts = ["plain", " <&> \"'", "é\U0001f600", "a\nb\r\nc", "\x01", None, "5"]
    rows = [(i, texts[i % 7], i / 8, Decimal(i) / 4, i % 2 == 0, date(2024, 1, 1 + i % 28), datetime(2024, 1, 1, 6, 30, i % 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, x double, d decimal(10,2), flag boolean, day date, at timestamp").repartition(3)
    xlsx.write_xlsx(df, str(tmp_path / "out"), "Bills")
    xlsx.write_xlsx(df.where("id < 0"), str(tmp_path / "out"), "Bills")  # workbooks of a header alone
    found = xlsx.read_xlsx(spark, str(tmp_path / "out"), df.columns, "Bills").orderBy(xlsx.F.col("id").cast("int")).collect()
    number = lambda v: xlsx.plain_number(Decimal(str(v)))
    assert [tuple(r)[:7] for r in found] == [(str(i), "�" if t == "\x01" else t, number(x), number(d), str(f).lower(), day.isoformat(), at.isoformat()) for i, t, x, d, f, day, at in rows]
    xlsx.write_xlsx(df.limit(2), str(tmp_path / "out"), "Bills", mode="overwrite")
    assert xlsx.read_xlsx(spark, str(tmp_path / "out"), ["id"], "Bills").count() == 2


def test_long_results_go_over_sheets(spark, tmp_path):
    spark.dataSource.register(xlsx.XlsxDataSource)
    spark.range(25).coalesce(1).write.format("xlsx").option("sheetrows", 11).mode("append").save(str(tmp_path / "out"))
    every = spark.read.format("xlsx").option("sheet", "*").load(str(tmp_path / "out"))
    assert every.rdd.getNumPartitions() == 3 and sorted(int(r.cells["id"]) for r in every.collect()) == list(range(25))


def test_columns_have_letters():
    assert [xlsx._letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(xlsx._column(f"{xlsx._letters(i)}7") == i for i in range(3000))


def test_rows_stream(tmp_path):
    """The rows of a large sheet are read without keeping them."""
    import tracemalloc

    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 60_001))
    path = workbook(tmp_path / "long.xlsx", {"S": rows})
    data = io.BytesIO(open(path, "rb").read())
    tracemalloc.start()
    n = sum(1 for _ in xlsx.Workbook(data).rows("S"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 3 << 20
