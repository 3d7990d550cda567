import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.streaming import feeds


def drain(stream, tmp_path, name, spark):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_members_pass_once(spark, tmp_path):
    rows = [("a", dt.datetime(2026, 1, 1, 1)), ("b", dt.datetime(2026, 1, 1, 2)), ("a", dt.datetime(2026, 1, 1, 3))]
    df = spark.createDataFrame(rows, "member_key string, ts timestamp")
    df.write.parquet(str(tmp_path / "in/1"))
    df.write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert sorted(r.member_key for r in drain(feeds.once(stream), tmp_path, "members", spark).collect()) == ["a", "b"]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [("total", dt.datetime(2026, 1, 1, 1, m)) for m in (0, 10, 59)] + [("total", dt.datetime(2026, 1, 1, 9))]
    df = spark.createDataFrame(rows, "field string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    out = drain(feeds.changes_per_window(feeds.audit_feed(spark, str(tmp_path / "in"), "field string, ts timestamp")), tmp_path, "windows", spark)
    assert [(r.start.hour, r.n) for r in out.collect()] == [(1, 3)]


def test_rates_are_merged_and_told_once(spark, tmp_path):
    told = []
    run = feeds.upsert_rates(str(tmp_path / "rates"), told.append)
    batch = lambda *rows: spark.createDataFrame([(c, dt.date(2026, 6, d), Decimal(r), v) for c, d, r, v in rows], "currency string, rate_date date, rate decimal(18,12), version int")
    run(batch(("EUR", 1, "1.10", 1), ("USD", 1, "1", 1), ("GBP", 1, "-1", 1)), 0)
    run(batch(("EUR", 1, "1.11", 2)), 1)
    run(batch(("EUR", 2, "1.12", 3)), 2)
    run(batch(("EUR", 2, "1.12", 3)), 2)
    assert told == [[("EUR", dt.date(2026, 6, 1))], [], [("EUR", dt.date(2026, 6, 2))], [("EUR", dt.date(2026, 6, 2))]]
    got = {r.rate_date.day: r.rate for r in spark.read.parquet(str(tmp_path / "rates/2")).where(F.col("currency") == "EUR").collect()}
    assert got == {1: Decimal("1.11"), 2: Decimal("1.12")}
