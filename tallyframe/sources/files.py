"""Files of a folder by their content, and snapshots of documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def imported(spark: SparkSession, folder: str, known: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """(path, hash, stored_as, size): files of the folder that known(hash) does not hold.  Equal contents count once, under the least path; so a second import brings nothing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    found = files.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"))
    once = found.groupBy("hash").agg(F.min("path").alias("path"), F.min("size").alias("size"))
    fresh = once if known is None else once.join(known.select("hash").distinct(), "hash", "left_anti")
    return fresh.select("path", "hash", F.concat_ws("_", F.substring("hash", 1, 12), F.regexp_extract("path", r"([^/]+)$", 1)).alias("stored_as"), "size")


#: Where a snapshot that does not parse keeps its text.
CORRUPT = "_corrupt"


def snapshots(raw: DataFrame, schema: T.StructType | str, column: str = "snapshot") -> tuple[DataFrame, DataFrame]:
    """raw(key, snapshot as JSON text) -> the documents that parse, and apart from them the rows that do not, with their text; no row is fatal or lost."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*wanted.fields, T.StructField(CORRUPT, T.StringType())])
    read = raw.withColumn("_d", F.from_json(column, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    wrong = F.col("_d").isNull() | F.col(f"_d.{CORRUPT}").isNotNull()
    others = [c for c in raw.columns if c != column]
    return read.where(~wrong).select(*others, *[f"_d.{f.name}" for f in wanted.fields]), read.where(wrong).select(raw.columns)


# fixed values: endings that name their format
FORMATS = {".csv": "delimited", ".tsv": "delimited", ".txt": "delimited", ".json": "json", ".ndjson": "json", ".ofx": "ofx", ".qfx": "ofx", ".qif": "qif", ".sta": "mt940", ".mt940": "mt940", ".940": "mt940", ".xml": "camt", ".html": "html", ".htm": "html", ".xls": "html"}


def with_format(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """files with `format`: what the text shows, else what the ending says; null for neither."""
    head = F.substring(F.ltrim(F.coalesce(F.col(text), F.lit(""))), 1, 4000)
    shown = (
        F.when(head.rlike(r"(?i)^(?:OFXHEADER|<\?OFX|<OFX)") | head.rlike(r"(?i)<OFX>"), "ofx")
        .when(head.rlike(r"(?i)urn:iso:std:iso:20022:tech:xsd:camt|<BkToCstmrStmt"), "camt")
        .when(head.rlike(r"(?m)^:20:") & head.rlike(r"(?m)^:(?:60F|60M|61|25):"), "mt940")
        .when(head.rlike(r"(?i)^!Type:"), "qif")
        .when(head.rlike(r"(?i)^(?:<!doctype html|<html|<table)"), "html")
        .when(head.rlike(r"^[\[{]"), "json")
    )
    ending = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    told = F.lit(None).cast("string")
    for name, kind in FORMATS.items():
        told = F.when(ending == name, kind).otherwise(told)
    return files.withColumn("format", F.coalesce(shown, told))
