"""Orders, odd rows and sources that the SQL comparison does not see."""

import decimal

from pyspark.sql import functions as F

from tallyframe.functions import cells
from tallyframe.operators import ledger, sinks, views
from tallyframe.sources import files


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_lists_come_in_their_order(spark):
    rules = spark.createDataFrame([(1, "active", 5), (2, "pending", 1), (3, "pending", 9), (4, "active", 7)], "id int, status string, confirmed_at int").repartition(3)
    assert ids(views.rules_in_order(rules)) == [3, 2, 4, 1]
    matches = spark.createDataFrame([(3, 80), (1, 80), (2, 90)], "id int, match_score int").repartition(3)
    assert ids(views.matches_in_order(matches)) == [2, 1, 3]
    parties = spark.createDataFrame([(1, "beta"), (2, "Alpha"), (3, "ALPHA b")], "id int, name string").repartition(3)
    assert ids(views.parties_in_order(parties)) == [2, 3, 1]
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "raw string, count int").repartition(3)
    assert ids(views.counted_parties_in_order(counts), "raw") == ["c", "a", "b"]
    lines = spark.createDataFrame([("2024-01-02", "a", 0), ("2024-01-01", "b", 1), ("2024-01-01", "a", 2)], "date string, stmt_hash string, index int").repartition(3)
    assert ids(views.statement_lines_in_order(lines), "index") == [2, 1, 0]
    statements = spark.createDataFrame([(1, "2024-01-01", None, "z"), (2, "2023-01-01", "2024-02-01", "a"), (3, "2023-01-01", "2024-01-01", "b")], "id int, period_start string, period_end string, bank_name string").repartition(3)
    assert ids(views.statements_in_order(statements)) == [3, 1, 2]
    entries = spark.createDataFrame([("2024-02", "b"), ("2024-01", "z"), ("2024-02", "a")], "period string, entry_no string").repartition(3)
    assert ids(views.entries_in_order(entries), "entry_no") == ["z", "a", "b"]


def test_vouchers_count_on_over_ranges(spark):
    rows = [(f"e{i:04d}", f"2024-0{1 + i % 3}-{1 + i % 28:02d}") for i in range(500)] + [("e9", None)]
    lines = spark.createDataFrame(rows, "entry_id string, d string").select("entry_id", F.col("d").cast("date").alias("entry_date"))
    got = {r.entry_id: r.voucher_no for r in ledger.voucher_numbers(lines.union(lines).repartition(7)).collect()}
    expected = {}
    for k in range(1, 4):
        month = sorted((d, e) for e, d in rows if d and d.startswith(f"2024-0{k}"))
        expected |= {e: f"20240{k}-{i:04d}" for i, (_, e) in enumerate(month, 1)}
    assert got == expected | {"e9": "000000-0001"}


def test_members_of_a_match_without_any(spark):
    members = spark.createDataFrame([(1, "invoice", "h", 0), (1, "txn", "s", 4)], "match_id int, kind string, hash string, index int")
    out = {r.id: r for r in views.match_members(spark.createDataFrame([(1,), (2,)], "id int"), members).collect()}
    assert out[1].invoices == ["h"] and [tuple(t) for t in out[1].txns] == [("s", 4)]
    assert out[2].invoices == [] and out[2].txns == []


def test_fx_accruals_without_a_rate_are_refused(spark):
    inv = spark.createDataFrame([("a", "p", "AR", "4000", "100.00", "90.00", "10.00", "EUR", "2024-01-05"), ("b", "p", "AR", "4000", "5.00", "5.00", "0.00", "XXX", "2024-01-05")], "hash string, party string, direction string, account string, total string, subtotal string, tax string, currency string, date string")
    inv = inv.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("total", "subtotal", "tax")} | {"date": F.col("date").cast("date"), "entry_day": F.lit("2024-01-08").cast("date")})
    rates = spark.createDataFrame([("EUR", "2024-01-05", "1.1")], "currency string, d string, r string").select("currency", F.col("d").cast("date").alias("rate_date"), F.col("r").cast("decimal(18,12)").alias("rate"))
    lines, refused = views.fx_accruals(inv, rates)
    assert {(r.account, r.debit, r.credit, r.stale_days) for r in lines.collect()} == {("1100", decimal.Decimal("110.00"), 0, 3), ("4000", 0, decimal.Decimal("99.00"), 3), ("2210", 0, decimal.Decimal("11.00"), 3)}
    assert ids(refused, "hash") == ["b"]


def test_files_are_imported_once(spark, tmp_path):
    for name, text in (("a.csv", "1"), ("b.csv", "1"), ("c.csv", "2")):
        (tmp_path / name).write_text(text)
    first = files.imported(spark, str(tmp_path), pattern="*.csv")
    rows = first.collect()
    assert sorted(r.stored_as[13:] for r in rows) == ["a.csv", "c.csv"] and all(r.stored_as[:12] == r.hash[:12] for r in rows)
    assert files.imported(spark, str(tmp_path), known=first, pattern="*.csv").count() == 0


def test_snapshots_keep_what_does_not_parse_apart(spark):
    raw = spark.createDataFrame([("a", '{"number": "1", "total": 5}'), ("b", "{oops"), ("c", None), ("d", '{"number": "2"}')], "key string, snapshot string")
    good, bad = files.snapshots(raw, "number string, total int")
    assert sorted((r["key"], r.number, r.total) for r in good.collect()) == [("a", "1", 5), ("d", "2", None)]
    assert sorted(r["key"] for r in bad.collect()) == ["b", "c"]


def test_formats_by_content_then_ending(spark):
    rows = [("x.txt", "OFXHEADER:100"), ("x.csv", "a,b"), ("x.bin", ":20:1\n:25:X\n:60F:C"), ("x.xml", "<Document xmlns='urn:iso:std:iso:20022:tech:xsd:camt.053.001.02'>"), ("x.QIF", None), ("x", "!Type:Bank"), ("x.xls", "<html><table>"), ("x.unknown", "?"), ("x.txt", ' [{"a": 1}]')]
    out = files.with_format(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, path string, text string")).orderBy("id")
    assert [r.format for r in out.collect()] == ["ofx", "delimited", "mt940", "camt", "qif", "qif", "html", None, "json"]


def test_journal_sink_writes_headers_and_lines(spark, tmp_path):
    lines = ledger.manual_entries(spark.createDataFrame([("1", "1002", "3000", "5.00", "opening")], "id string, debit_account string, credit_account string, a string, kind string").select("*", F.col("a").cast("decimal(18,2)").alias("amount"), F.lit(None).cast("string").alias("activity"), F.lit("2024-01-01").cast("date").alias("date")))
    path = str(tmp_path / "journal")
    assert sinks.post_journal(lines, path) == 1 and sinks.post_journal(lines, path) == 0  # an entry is posted once
    assert spark.read.parquet(f"{path}/entries").count() == 1 and spark.read.parquet(f"{path}/lines").count() == 2
    bad = lines.withColumns({"entry_id": F.lit("bad"), "credit": F.lit(0).cast("decimal(18,2)")})
    assert sinks.post_journal(bad, path) == 0


def test_grades_at_their_bounds(spark):
    df = spark.createDataFrame([("0.98",), ("0.9799",), ("0.95",), ("0.90",), ("0.89",)], "q string").select(cells.grade(F.col("q").cast("decimal(9,6)")).alias("g"))
    assert [r.g for r in df.collect()] == ["Excellent", "Good", "Good", "Warning", "HighRisk"]
