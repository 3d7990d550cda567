"""Workbooks: the cells of xlsx files, as tables and as words on a page.

Files come as rows (path, content), as Spark's binaryFile reader gives them from any store, so executors open no paths of their own.  A workbook is a zip of XML parts; a part is read
row by row and forgotten as it goes, so a sheet of any length costs its strings and one row.  The standard library is enough."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import norm_key
from tallyframe.operators.transposed import by_wording

#: Width of a column and height of a row, when cells are laid out as words.
WIDTH, HEIGHT = 90.0, 16.0
_BATCH = 10_000
# fixed values: number formats of the file format that are dates or times
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _is_date(code: str) -> bool:
    """Whether a format of the workbook's own shows a date: it has d, m, y or h outside of quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.split(";")[0])
    return bool(re.search(r"[dmyh]", bare, re.IGNORECASE)) and not re.search(r"[0#?]", bare)


class Workbook:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        self.strings = [self._text(e) for e in self._parts("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        self.formats = self._formats() if "xl/styles.xml" in names else []
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.since_1904 = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels")).iter() if e.get("Id")}
        self.sheets = []
        for e in book.iter():
            if _local(e.tag) == "sheet":
                target = targets.get(next((v for k, v in e.attrib.items() if _local(k) == "id"), None), "")
                path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if path in names and e.get("state", "visible") == "visible":
                    self.sheets.append((e.get("name"), path))

    def _parts(self, path: str, tag: str) -> Iterator[ElementTree.Element]:
        """The elements of a name, one at a time."""
        with self.zip.open(path) as file:
            for _, e in ElementTree.iterparse(file, events=("end",)):
                if _local(e.tag) == tag:
                    yield e
                    e.clear()

    @staticmethod
    def _text(e: ElementTree.Element) -> str:
        """The runs of a string, without its phonetic ones."""
        out = []
        for child in e:
            if _local(child.tag) == "t":
                out.append(child.text or "")
            elif _local(child.tag) == "r":
                out += [t.text or "" for t in child if _local(t.tag) == "t"]
        return "".join(out)

    def _formats(self) -> list[str]:
        """What each style shows: date, percent, or a plain number with so many decimals at least."""
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if _local(e.tag) == "numFmt"}
        cells = next((e for e in styles if _local(e.tag) == "cellXfs"), [])
        out = []
        for e in cells:
            n = int(e.get("numFmtId", 0))
            code = own.get(n, "")
            out.append("date" if n in _DATE_FORMATS or _is_date(code) else "percent" if n in (9, 10) or "%" in code else "number")
        return out

    def _shown(self, value: str, style: int) -> tuple[str, str]:
        kind = self.formats[style] if style < len(self.formats) else "number"
        try:
            number = float(value)
        except ValueError:
            return value, "text"
        if kind == "date":
            start = datetime.datetime(1904, 1, 1) if self.since_1904 else datetime.datetime(1899, 12, 30)
            at = start + datetime.timedelta(days=number)
            at = (at + datetime.timedelta(microseconds=500)).replace(microsecond=0)
            return (at.date().isoformat() if number == int(number) else at.isoformat(sep=" ")), "date"
        if kind == "percent":
            return f"{round(number * 100, 10):g}%", "percent"
        # what is written is the shortest text of a binary fraction: 0.1 may stand as 0.10000000000000001
        return (str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)), "number"

    def cells(self, path: str) -> Iterator[tuple[int, int, str, str]]:
        """(row, column, text, kind) of the cells that show something, from 1 on."""
        at = 0
        for row in self._parts(path, "row"):
            at = int(row.get("r") or at + 1)
            column = 0
            for c in row:
                if _local(c.tag) != "c":
                    continue
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                if letters:
                    column = 0
                    for x in letters[0]:
                        column = column * 26 + ord(x) - 64
                else:
                    column += 1
                kind, style = c.get("t", "n"), int(c.get("s") or 0)
                value = next((v.text for v in c if _local(v.tag) == "v"), None)
                if kind == "inlineStr":
                    shown = "".join(self._text(v) for v in c if _local(v.tag) == "is"), "text"
                elif value is None:
                    continue
                elif kind == "s":
                    shown = self.strings[int(value)], "text"
                elif kind == "b":
                    shown = ("TRUE" if value == "1" else "FALSE"), "flag"
                elif kind in ("str", "e", "d"):
                    shown = value, "date" if kind == "d" else "text"
                else:
                    shown = self._shown(value, style)
                if shown[0].strip():
                    yield at, column, *shown


SCHEMA = "path string, sheet string, sheet_no int, row int, column int, text string, kind string, error string"


def cells(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, sheet, sheet_no, row, column, text, kind, error) of the visible sheets; a file that is no workbook gives one row that says so, null content none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sheet", "sheet_no", "row", "column", "text", "kind", "error"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            out: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not content.is_valid:
                    continue
                try:
                    book = Workbook(content.as_buffer().to_pybytes())
                    for no, (sheet, part) in enumerate(book.sheets):
                        for row, column, text, kind in book.cells(part):
                            out.append((path, sheet, no, row, column, text, kind, None))
                            if len(out) >= _BATCH:
                                yield batch(out)
                                out = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as why:
                    out.append((path, None, None, None, None, None, None, f"{type(why).__name__}: {why}"))
            if out:
                yield batch(out)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the xlsx files under a path of any store that Spark reads."""
    return cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def words(cells_: DataFrame) -> DataFrame:
    """Cells as words on pages, a page for each sheet: what reads invoices from pages reads them from sheets."""
    left, top = (F.col("column") - 1) * WIDTH, F.col("row") * HEIGHT
    return cells_.where("text IS NOT NULL").select(F.col("path").alias("doc_id"), F.col("sheet_no").alias("page"), left.alias("x0"), top.cast("double").alias("y0"), (left + F.least(F.length("text") * 5.0, F.lit(WIDTH - 30.0))).alias("x1"), (top + 9.0).alias("y1"), "text")


def table(cells_: DataFrame, names: dict[str, list[str]], *, needs: tuple[str, ...]) -> DataFrame:
    """(path, sheet_no, row, and a column for each name): the rows below the first row of a sheet that has all the heads needed.

    A column belongs to the name that its head says, whatever stands above; a sheet without such a row gives nothing."""
    named = cells_.where("text IS NOT NULL").withColumn("_name", F.try_element_at(by_wording(names), norm_key(F.col("text"))))
    heads = named.groupBy("path", "sheet_no", "row").agg(F.collect_set("_name").alias("held")).where(F.size(F.array_except(F.array(*map(F.lit, needs)), "held")) == 0)
    first = heads.groupBy("path", "sheet_no").agg(F.min("row").alias("_head"))
    rows = named.join(first, ["path", "sheet_no"]).where("row >= _head")
    own = F.first(F.when(F.col("row") == F.col("_head"), F.col("_name")), ignorenulls=True).over(Window.partitionBy("path", "sheet_no", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_of", own).where("row > _head AND _of IS NOT NULL")
    value = lambda n: F.min_by(F.when(F.col("_of") == n, F.col("text")), F.when(F.col("_of") == n, F.col("column"))).alias(n)
    return rows.groupBy("path", "sheet_no", "row").agg(*[value(n) for n in names])


_STYLES = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="10" applyNumberFormat="1"/></cellXfs></styleSheet>'
_MAIN, _REL, _PACKAGE = (f"http://schemas.openxmlformats.org/{x}" for x in ("spreadsheetml/2006/main", "officeDocument/2006/relationships", "package/2006/relationships"))


def _letters(column: int) -> str:
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(row: int, column: int, text: str, kind: str) -> str:
    at = f'r="{_letters(column)}{row}"'
    if kind == "number" and re.fullmatch(r"-?\d+(\.\d+)?", text):
        return f"<c {at}><v>{text}</v></c>"
    if kind == "date" and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return f'<c {at} s="1"><v>{(datetime.date.fromisoformat(text) - datetime.date(1899, 12, 30)).days}</v></c>'
    if kind == "percent" and re.fullmatch(r"-?\d+(\.\d+)?%", text):
        return f'<c {at} s="2"><v>{float(text[:-1]) / 100!r}</v></c>'
    if kind == "flag" and text in ("TRUE", "FALSE"):
        return f'<c {at} t="b"><v>{int(text == "TRUE")}</v></c>'
    # what XML cannot hold goes
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def workbook(rows: list[tuple[str, int, int, str, str]]) -> bytes:
    """An xlsx file of (sheet, row, column, text, kind), sheets in the order of their names."""
    sheets: dict[str, dict[int, list[tuple[int, str, str]]]] = {}
    for sheet, row, column, text, kind in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        sheets.setdefault(sheet, {}).setdefault(row, []).append((column, text, kind))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="styles" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        for i, own in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as file:
                file.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for row, line in own.items():
                    file.write(f'<row r="{row}">{"".join(_cell(row, *c) for c in line)}</row>'.encode())
                file.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks(cells_: DataFrame) -> DataFrame:
    """(path, sheet, row, column, text, kind) -> (path, content): a workbook for each path, which has to fit a task as any file of the format has to fit its reader."""

    def build(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("sheet", "row", "column", "text", "kind")), strict=True))
        return pa.Table.from_arrays([group.column("path").slice(0, 1), pa.array([workbook(rows)], pa.binary())], names=["path", "content"])

    return cells_.where("text IS NOT NULL").select("path", "sheet", "row", "column", "text", "kind").groupBy("path").applyInArrow(build, "path string, content binary")
