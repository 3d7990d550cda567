"""Streams: an audit feed, members processed once, the rate in force, and telling of a new rate once.

The reference has no streams; these are extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def audit_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Appended Parquet files of change events, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def once(members: DataFrame, key: str = "member_key", event_time: str = "ts", late: str = "7 days") -> DataFrame:
    """Each key once while its first event is no older than the watermark; state older than that goes."""
    return members.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def changes_per_window(events: DataFrame, event_time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes by field and window of time; late ones count until the watermark passes."""
    windows = events.withWatermark(event_time, late).groupBy(F.window(event_time, width), "field").agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), "field", "n")


def upsert_rates(table_path: str, tell: Callable[[list], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the last positive rate of each currency and day joins the table at table_path; `tell` hears of currencies whose effective day moved on.

    The table is written anew beside the old one under the batch's number, so a batch that is run again gives the same."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where((F.col("rate") > 0) & (F.col("currency") != "USD")).groupBy("currency", "rate_date").agg(F.max_by("rate", "version").alias("rate"), F.max("version").alias("version"))
        old = None
        for k in range(batch_id - 1, -1, -1):
            try:
                old = spark.read.parquet(f"{table_path}/{k}")
                break
            except Exception as e:  # no batch of that number
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        both = fresh if old is None else fresh.unionByName(old)
        merged = both.groupBy("currency", "rate_date").agg(F.max_by("rate", "version").alias("rate"), F.max("version").alias("version"))
        merged.write.mode("overwrite").parquet(f"{table_path}/{batch_id}")
        if tell is not None:
            now = spark.read.parquet(f"{table_path}/{batch_id}").groupBy("currency").agg(F.max("rate_date").alias("d"))
            before = None if old is None else old.groupBy("currency").agg(F.max("rate_date").alias("was"))
            moved = now if before is None else now.join(before, "currency", "left").where("was IS NULL OR d > was")
            tell([tuple(r) for r in moved.select("currency", "d").orderBy("currency").collect()])  # one row per currency

    return run
