"""Workbooks written here by hand, and read back."""

import io
import zipfile

import pytest

from tallyframe.operators import pages
from tallyframe.sources import sheets

STYLES = '<styleSheet xmlns="x"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="#,##0.00&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="9"/><xf numFmtId="165"/></cellXfs></styleSheet>'


def workbook(parts, strings=(), styles=STYLES, states=(), flag=""):
    """parts: XML of the rows of each sheet."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        sheet = "".join(f'<sheet name="S{i}" sheetId="{i + 1}" r:id="r{i}" {"state=\'hidden\'" if i in states else ""}/>' for i in range(len(parts)))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="m" xmlns:r="rel"><workbookPr {flag}/><sheets>{sheet}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(parts))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", styles)
        for i, p in enumerate(parts):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="m"><sheetData>{p}</sheetData></worksheet>')
    return out.getvalue()


FIRST = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>in line</t></is></c><c r="AA2" s="1"><v>45000</v></c></row><row><c s="2"><v>45000.5</v></c><c s="3"><v>0.05</v></c><c s="4"><v>1234.5</v></c><c t="b"><v>1</v></c><c/><c><v>0.1</v></c><c t="str"><v>made</v></c></row>'
STRINGS = ["<t>plain</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>sound</t></rPh>"]


def test_cells(spark):
    book = workbook([FIRST, '<row><c t="s"><v>1</v></c></row>', "<row><c><v>9</v></c></row>"], STRINGS, states=(2,))
    files = spark.createDataFrame([("a", bytearray(book)), ("b", bytearray(b"no zip")), ("c", None), ("d", bytearray(workbook(["<row><c s='1'><v>0</v></c></row>"], flag='date1904="1"')))], "path string, content binary")
    rows = sheets.cells(files).collect()
    assert [(r.sheet, r.row, r.column, r.text, r.kind) for r in rows if r.path == "a"] == [
        ("S0", 2, 2, "plain", "text"), ("S0", 2, 3, "in line", "text"), ("S0", 2, 27, "2023-03-15", "date"),
        ("S0", 3, 1, "2023-03-15 12:00:00", "date"), ("S0", 3, 2, "5%", "percent"), ("S0", 3, 3, "1234.5", "number"), ("S0", 3, 4, "TRUE", "flag"), ("S0", 3, 6, "0.1", "number"), ("S0", 3, 7, "made", "text"), ("S1", 1, 1, "two runs", "text"),
    ]
    assert [r.error.split(":")[0] for r in rows if r.path == "b"] == ["BadZipFile"] and [r.text for r in rows if r.path == "d"] == ["1904-01-01"]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.xlsx").write_bytes(workbook([FIRST], STRINGS))
    (tmp_path / "two.csv").write_text("a")
    assert sheets.read(spark, str(tmp_path)).count() == 9


def inline(*rows):
    return "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{t}</t></is></c>' for t in row) + "</row>" for row in rows)


def test_tables_and_fields(spark):
    book = workbook([inline(["Account 1"], ["", "Booking Date", "Amount", "other"], ["x", "2026-01-01", "5.00", "y"], ["", "2026-01-02"]), inline(["Amount"], ["7"])])
    cells = sheets.cells(spark.createDataFrame([("a", bytearray(book))], "path string, content binary"))
    out = sheets.table(cells, {"date": ["Booking date"], "amount": ["Amount"]}, needs=("date", "amount")).orderBy("row").collect()
    assert [(r.row, r.date, r.amount) for r in out] == [(3, "2026-01-01", "5.00"), (4, "2026-01-02", None)]
    book = workbook([inline(["Invoice No", "INV-7"], ["Subtotal", "USD 10.00"], ["Total Due", "USD 10.50"])])
    cells = sheets.cells(spark.createDataFrame([("a", bytearray(book))], "path string, content binary"))
    assert {r.field: r.raw for r in pages.fields(sheets.words(cells)).collect()} == {"invoice_no": "INV-7", "subtotal": "10.00", "total_due": "10.50"}


@pytest.mark.parametrize(("code", "date"), [("yyyy-mm-dd", True), ("d mmm", True), ("h:mm", True), ("0.00", False), ('#,##0 "days"', False), ("[Red]0", False), ("General", False), ("@", False)])
def test_date_formats(code, date):
    assert sheets._is_date("" if code == "General" else code) == date


def test_what_is_written_is_read(spark):
    rows = [("a", "S0", 1, 1, "plain & <odd> \"text\"", "text"), ("a", "S0", 1, 28, "2026-02-28", "date"), ("a", "S0", 7, 2, "-12.5", "number"), ("a", "S0", 7, 3, "007", "text"), ("a", "S1", 1, 1, "7.25%", "percent"), ("a", "S1", 2, 1, "TRUE", "flag"), ("b", "Only", 3, 3, " blanks ", "text"), ("b", "Only", 4, 3, "漢字 😀", "text")]
    cells = spark.createDataFrame(rows, "path string, sheet string, row int, column int, text string, kind string")
    back = sheets.cells(sheets.workbooks(cells)).select(*cells.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
