"""One reader for statements of every format: files of a folder become transactions, whatever they are written in.

The format of a file is told by its content, then by its name; each file goes to the reader of its format, and all give the same columns.  Nothing of a file passes the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.dates import parse_date
from tallyframe.functions.money import parse_amount
from tallyframe.session import checkpointed
from tallyframe.sources import sheets, statements
from tallyframe.sources.files import with_format

SEPARATORS = [",", ";", "\t", "|"]
#: Lines at a file's head among which heads of columns are looked for.
HEAD = 30
_FIXED = r"(?m)^\S+?\s*\d{4}-\d{2}-\d{2}\s*\d{4}-\d{2}-\d{2}\s*[A-Z]{3,5}\s*-?[\d,]+\.\d{2}"
COLUMNS = ["file", "format", "idx", "date", "amount", "balance", "description"]


def _heads() -> Column:
    return F.create_map(*[F.lit(x) for target, names in statements.HEADERS.items() for n in names for x in (n, target)])


def _head(c: Column) -> Column:
    return F.try_element_at(_heads(), F.regexp_replace(F.lower(c), r"[\s_./\-()（）]+", ""))


def _fields(line: Column, separator: str) -> Column:
    """The fields of a line; a separator inside quotes parts nothing, doubled quotes are one."""
    quoted = "\\" + separator if separator == "|" else separator
    parts = F.split(line, rf'{quoted}(?=(?:[^"]*"[^"]*")*[^"]*$)')
    unquoted = F.transform(parts, lambda p: F.replace(F.regexp_replace(F.trim(p), r'^"([\s\S]*)"$', "$1"), F.lit('""'), F.lit('"')))
    # most lines have no quotes, and looking ahead for them at every separator costs the square of a line
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(F.transform(F.split(line, quoted), lambda p: F.trim(p)))


def delimited(files: DataFrame) -> DataFrame:
    """(file, idx, cells) of text with separators: for each file the one by which most heads are known.

    Fields go over no line ends: a quoted line break parts a record, as statements have none."""
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != "")
    known = lambda s: F.array_max(F.transform(F.slice("_lines", 1, HEAD), lambda x: F.size(F.array_distinct(F.filter(F.transform(_fields(x, s), _head), lambda h: h.isNotNull())))))
    told = files.withColumn("_lines", lines).where("size(_lines) > 0")
    best = F.array_max(F.array(*[F.struct(known(s).alias("n"), F.lit(-i).alias("i")) for i, s in enumerate(SEPARATORS)]))
    told = told.withColumn("_best", best).where("_best.n > 0").select("file", F.col("_best.i").alias("_i"), F.posexplode("_lines").alias("idx", "_line"))
    cells = F.coalesce(*[F.when(F.col("_i") == -i, _fields(F.col("_line"), s)) for i, s in enumerate(SEPARATORS)])
    return told.select("file", "idx", cells.alias("cells"))


def json_records(files: DataFrame) -> DataFrame:
    """(file, idx, record) of a list of objects, of the members transactions or entries of an object, or of one object a line; names of columns as HEADERS has them."""
    rows = "array<map<string,string>>"
    whole = F.from_json("content", rows)
    members = F.from_json("content", "map<string,string>")
    inside = F.from_json(F.coalesce(F.try_element_at(members, F.lit("transactions")), F.try_element_at(members, F.lit("entries"))), rows)
    each = F.transform(F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, "map<string,string>"))
    found = F.when(F.ltrim("content").startswith("["), whole).otherwise(F.coalesce(inside, each))
    raw = files.select("file", F.posexplode(found).alias("idx", "r")).where("r IS NOT NULL")
    pairs = F.filter(F.transform(F.map_entries("r"), lambda e: F.struct(_head(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"].isNotNull())
    # of two columns of one name the first counts
    first = F.aggregate(pairs, F.array().cast("array<struct<key: string, value: string>>"), lambda out, e: F.when(F.exists(out, lambda x: x["key"] == e["key"]), out).otherwise(F.concat(out, F.array(e))))
    return raw.select("file", "idx", F.map_from_entries(first).alias("record"))


def from_records(records: DataFrame) -> DataFrame:
    """(file, idx, record) -> (file, idx, date, amount, balance, description); rows without a date go."""
    value = lambda k: parse_amount(F.try_element_at("record", F.lit(k)))["value"]
    zero = F.lit(0).cast("decimal(28,6)")
    signed = F.coalesce(value("signed"), F.when(value("credit").isNotNull() | value("debit").isNotNull(), F.coalesce(value("credit"), zero) - F.coalesce(value("debit"), zero)))
    out = records.withColumn("date", parse_date(F.try_element_at("record", F.lit("date")))["value"]).where("date IS NOT NULL")
    return out.select("file", "idx", "date", signed.cast("decimal(18,2)").alias("amount"), value("balance").cast("decimal(18,2)").alias("balance"), F.try_element_at("record", F.lit("desc")).alias("description"))


def transactions(files: DataFrame, workbooks: DataFrame | None = None) -> DataFrame:
    """files(file, content as text), workbooks(path, content as bytes) -> COLUMNS of all of them; files of no known format give nothing, and balance is null where a format or a file has none."""
    told = with_format(files.select("file", "content"), "file", "content")
    kind = F.when(F.col("format").eqNullSafe("delimited") & F.col("content").rlike(_FIXED), "fixed").otherwise(F.col("format"))
    told = checkpointed(told.withColumn("format", kind))  # read by the reader of each format
    of = lambda name: told.where(F.col("format") == name).select("file", "content")
    records = statements.table_records
    read = {
        "delimited": from_records(records(delimited(of("delimited")))), "json": from_records(json_records(of("json"))), "html": from_records(records(statements.html_table(of("html")))),
        "ofx": statements.ofx(of("ofx")), "qif": statements.qif(of("qif")), "mt940": statements.mt940(of("mt940")), "camt": statements.camt(of("camt")), "fixed": statements.fixed_width(of("fixed")),
    }
    if workbooks is not None:
        rows = sheets.cells(workbooks).where("text IS NOT NULL")
        line = F.transform(F.sequence(F.lit(1), F.array_max(F.transform("c", lambda x: x["column"]))), lambda k: F.coalesce(F.get(F.filter("c", lambda x: x["column"] == k), F.lit(0))["text"], F.lit("")))
        cells = rows.groupBy(F.concat_ws("#", "path", "sheet").alias("file"), F.col("row").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("column", "text"))).alias("c"))
        # rows are as long as the sheet's longest, as heads and rows must be of one length
        width = cells.groupBy("file").agg(F.max(F.array_max(F.transform("c", lambda x: x["column"]))).alias("w"))
        wide = cells.join(width, "file").withColumn("cells", line).withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("w") - F.size("cells"))))
        read["workbook"] = from_records(records(wide.select("file", "idx", "cells")))
    out = None
    for name, df in read.items():
        both = df.withColumn("balance", F.lit(None).cast("decimal(18,2)")) if "balance" not in df.columns else df
        described = "description" if "description" in df.columns else next((c for c in ("counterparty", "reference") if c in df.columns), None)
        part = both.select("file", F.lit(name).alias("format"), F.col("idx").cast("int").alias("idx"), "date", F.col("amount").cast("decimal(18,2)").alias("amount"), F.col("balance").cast("decimal(18,2)").alias("balance"), (F.col(described) if described else F.lit(None).cast("string")).alias("description"))
        out = part if out is None else out.unionByName(part)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """The transactions of all statements under a path: workbooks by their first bytes, everything else as text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    zipped = F.hex(F.substring("content", 1, 2)) == "504B"
    text = files.where(~zipped).select(F.col("path").alias("file"), statements.decoded("content").alias("content"))
    return transactions(text, files.where(zipped).select("path", "content"))
