"""Tables that stand on end."""

from decimal import Decimal

from test_pages import column, words

from tallyframe.operators import transposed

NAMES = {"date": ["Date", "Booking date"], "amount": ["Amount"], "description": ["Description", "Details"], "balance": ["Balance"]}


def lines(spark, docs):
    return spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc_id string, line int, text string")


def test_records(spark):
    docs = {
        "plain": ["Account 1", "Date", "Amount", "Description", "Balance", "d1", "1", "x", "10", "", "d2", "2", "y", "12", "d3"],
        "again": ["Date", "Amount", "Details", "Balance", "d1", "1", "Balance", "x", "10", "d2", "Balance", "Booking date", "Amount", "Description", "7", "e1", "5", "z"],
        "few": ["Date", "Amount", "d1", "1"],
        "none": ["nothing", "here"],
    }
    out = transposed.as_columns(transposed.records(lines(spark, docs), NAMES), list(NAMES)).orderBy("doc_id", "block", "record").collect()
    assert [(r.doc_id, r.record, r.date, r.amount, r.description, r.balance) for r in out] == [
        ("again", 0, "d1", "1", "x", "10"), ("again", 0, "e1", "5", "z", "7"), ("plain", 0, "d1", "1", "x", "10"), ("plain", 1, "d2", "2", "y", "12"),
    ]


def test_a_block_needs_its_columns_and_ends(spark):
    docs = {"a": ["Amount", "Balance", "1", "2", "Date", "Amount", "d1", "1", "End", "d2", "2"]}
    from pyspark.sql import functions as F

    out = transposed.records(lines(spark, docs), NAMES, least=2, needs=("date",), end=F.col("text") == "End").collect()
    assert sorted((r.record, r.name, r.value) for r in out) == [(0, "amount", "1"), (0, "date", "d1")]


def test_upright_items(spark):
    docs = {
        "four": ["Line Items", "DESCRIPTION", "QTY", "UNIT PRICE", "AMOUNT", "Exception queue analysis", "5", "USD 132.00", "USD 660.00", "Monthly platform subscription", "3", "USD 240.00", "USD 720.00", "Subtotal: USD 980.00", "Total Due: USD 980.00"],
        "two": ["Description", "Amount", "Monthly subscription", "USD 950.00", "Guest user pack", "USD 150.00", "Net fees", "USD 1,100.00", "Invoice Total", "USD 1,100.00"],
        "none": ["Description", "Some prose", "Total", "5.00"],
    }
    got = {}
    for r in transposed.upright_items(words(spark, {d: column(ts, 260) for d, ts in docs.items()})).orderBy("doc_id", "item").collect():
        got.setdefault(r.doc_id, []).append((r.description, r.quantity, r.unit_price, r.amount))
    assert got == {
        "four": [("Exception queue analysis", "5", "132.00", "660.00"), ("Monthly platform subscription", "3", "240.00", "720.00")],
        "two": [("Monthly subscription", None, None, "950.00"), ("Guest user pack", None, None, "150.00")],
    }


def test_vat_invoices(spark):
    doc = [
        (210, 10, 300, 18, "增值税专用发票"), (40, 40, 220, 48, "货物或应税劳务、服务名称"), (430, 40, 470, 48, "金额"), (500, 40, 560, 48, "税率 税额"),
        (40, 60, 120, 68, "技术咨询服务"), (350, 60, 410, 68, "10000.00"), (430, 60, 490, 68, "10000.00"), (500, 60, 560, 68, "6% 600.00"),
        (40, 80, 120, 88, "系统集成"), (350, 80, 410, 88, "5000.00"), (430, 80, 490, 88, "5000.00"), (500, 80, 560, 88, "6% 300.00"), (40, 110, 360, 118, "价税合计（大写）（小写）¥15900.00"),
    ]
    page = words(spark, {"vat": doc, "other": [(40, 40, 90, 48, "金额"), (200, 40, 260, 48, "税额"), (40, 60, 90, 68, "5.00")]})
    assert [(r.doc_id, r.description, r.amount, r.tax) for r in transposed.vat_items(page).orderBy("row").collect()] == [("vat", "技术咨询服务", Decimal("10000.00"), Decimal("600.00")), ("vat", "系统集成", Decimal("5000.00"), Decimal("300.00"))]
    assert [tuple(r) for r in transposed.vat_sums(page).collect()] == [("vat", Decimal("15000.00"), Decimal("900.00"), Decimal("15900.00"))]


def test_vat_sums_deal_words_once(spark):
    """Items and the named total come from one reading of the rows: words are dealt by page, and rows by document."""
    words = spark.createDataFrame([("d", 1, 40.0, 10.0, 140.0, 18.0, "x")], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    plan = transposed.vat_sums(words)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 2, plan


def test_records_meet_no_heads(spark):
    """Names of columns come along the block: lines are read once and not joined with their heads."""
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(["Item", "Amount", "x", "1.00", "y", "2.00", "z"])], "doc_id string, line int, text string")
    found = transposed.records(lines, {"item": ["Item"], "amount": ["Amount"]}, least=2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.record, r.place, r.name, r.value) for r in found.collect()} == {(0, 0, "item", "x"), (0, 1, "amount", "1.00"), (1, 0, "item", "y"), (1, 1, "amount", "2.00")}
