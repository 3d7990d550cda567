"""Words with places on a page: lines, cells and regions.  words: doc_id, page, x0, y0, x1, y1, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(words: DataFrame, *, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page, line, y, text): words whose height on the page differs by no more than the tolerance from the one before are one line, read from left to right."""
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "x0")
    starts = F.when(F.col("y0") - F.lag("y0").over(order) <= tolerance, 0).otherwise(1)
    numbered = words.withColumn("_s", starts).withColumn("line", F.sum("_s").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return numbered.groupBy("doc_id", "page", "line").agg(F.min("y0").alias("y"), joined.alias("text"))


def cells(words: DataFrame, *, gap: float = 26.0) -> DataFrame:
    """(doc_id, page, y0, cell, x0, text): neighbours on a line less than `gap` apart."""
    order = Window.partitionBy("doc_id", "page", "y0").orderBy("x0")
    starts = F.when(F.col("x0") - F.lag("x1").over(order) <= gap, 0).otherwise(1)
    numbered = words.withColumn("_s", starts).withColumn("cell", F.sum("_s").over(order))
    return numbered.groupBy("doc_id", "page", "y0", "cell").agg(F.min("x0").alias("x0"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"))


def region_text(words: DataFrame, regions: DataFrame) -> DataFrame:
    """regions(region_id, doc_id, page, rx0, ry0, rx1, ry1) -> the text of the words that overlap each, by height and then from the left."""
    met = words.join(regions, ["doc_id", "page"]).where("x0 < rx1 AND x1 > rx0 AND y0 < ry1 AND y1 > ry0")
    return met.groupBy("region_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda w: w["text"]), " ").alias("text"))


def nearest_column(words: DataFrame, headers: DataFrame) -> DataFrame:
    """headers(doc_id, page, column, hx) -> words with the column whose x is nearest; the left one of two."""
    met = words.join(headers, ["doc_id", "page"])
    return met.groupBy("doc_id", "page", "x0", "y0", "text").agg(F.min_by("column", F.struct(F.abs(F.col("x0") - F.col("hx")), "hx")).alias("column"))
