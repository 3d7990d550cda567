"""Fields and line items from words on pages."""

import re
from decimal import Decimal



from pyspark.sql import functions as F

from tallyframe.operators import items, pages

SCHEMA = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"


def words(spark, docs):
    """docs: name -> list of (x0, y0, x1, y1, text), on page 1."""
    return spark.createDataFrame([(d, 1, float(a), float(b), float(c), float(e), t) for d, ws in docs.items() for a, b, c, e, t in ws], SCHEMA)


def column(texts, x1=240):
    return [(45, 10 + 20 * i, x1, 18 + 20 * i, t) for i, t in enumerate(texts)]


DOCS = {
    "grid": [(59, 10, 110, 18, "INVOICE"), (112, 10, 140, 18, "NO."), (221, 10, 250, 18, "ISSUE"), (252, 10, 300, 18, "DATE"), (59, 30, 140, 38, "HCG-2025-1002"), (221, 30, 245, 38, "28"), (247, 30, 300, 38, "December"), (302, 30, 330, 38, "2025")],
    "inline": [(43, 10, 80, 18, "Currency:"), (85, 10, 110, 18, "GBP")],
    "heads": [(486, 10, 520, 18, "TOTAL"), (490, 30, 540, 38, "19,000.00"), (343, 60, 375, 68, "TOTAL"), (377, 60, 410, 68, "DUE"), (490, 60, 540, 68, "92,000.00")],
    "service": [(43, 10, 61, 18, "Tax"), (63, 10, 110, 18, "Advisory"), (318, 10, 326, 18, "2"), (411, 10, 470, 18, "32,500.00")],
    "undated": [(43, 10, 60, 18, "No."), (62, 10, 140, 18, "GP-2025-1001"), (300, 10, 360, 18, "12"), (362, 10, 400, 18, "January"), (402, 10, 430, 18, "2025")],
    "own value": column(["Subtotal: USD 2,741.00", "Tax: USD 212.43", "Total Due: USD 2,953.43"], 260),
    "two taxes": column(["Subtotal", "4,000.00", "GST (5%)", "200.00", "PST (7%)", "280.00", "Total", "4,480.00"]),
    "sections": column(["Subtotal", "1,500.00", "Subtotal", "4,500.00", "Subtotal", "3,000.00", "Tax", "0.00", "Total Due", "4,500.00"]),
    "euros": column(["Subtotal", "€ 59.400,00", "VAT (8%)", "€ 4.752,00", "Total Due", "€ 64.152,00"]),
    "blanks": [(45, 10, 120, 18, "Subtotal"), (460, 10, 474, 18, "88"), (477, 10, 516, 18, "400,00"), (519, 10, 526, 18, "€"), (45, 30, 120, 38, "Total Due"), (460, 30, 481, 38, "106"), (484, 30, 523, 38, "080,00"), (526, 30, 533, 38, "€")],
    "whole": [w for i, (label, v) in enumerate([("Subtotal", "JPY 150000"), ("Tax (10%)", "JPY 15000"), ("Total Due", "JPY 165000")]) for w in ((40, 100 + 20 * i, 200, 112 + 20 * i, label), (500, 100 + 20 * i, 590, 112 + 20 * i, v))],
    "to date": [(40, 100, 200, 112, "Description"), (400, 100, 470, 112, "This Period"), (505, 100, 580, 112, "Year to Date"), (40, 120, 120, 132, "Electricity"), (400, 120, 450, 132, "$100.00"), (505, 120, 560, 132, "$600.00"), (40, 150, 160, 162, "Total This Period"), (400, 150, 450, 162, "$150.00"), (505, 150, 560, 162, "$900.00")],
    "next label": [(60, 10, 90, 18, "TERMS"), (221, 10, 280, 18, "PERIOD"), (383, 10, 440, 18, "CURRENCY"), (60, 30, 90, 38, "Net 15"), (221, 30, 360, 38, "30 November 2025 - 26 December 2025"), (383, 30, 410, 38, "EUR")],
    "heading": [(60, 10, 80, 18, "BILL"), (82, 10, 100, 18, "TO"), (60, 30, 110, 38, "CONTACT")],
    "suffix": column(["Subtotal", "1,900.00 USD", "Total Due", "1,900.00 USD"], 260),
    "credit": column(["Credit Note No: CN-1", "Total Credit", "(1,453.68)", "Tax", "-GBP 12.00"]),
    "crossed": [(60, 10, 120, 18, "Due Date"), (300, 10, 340, 18, "Client"), (300, 20, 380, 28, "other column"), (62, 40, 120, 48, "16 March 2025")],
}

WANT = {
    ("grid", "invoice_no"): "HCG-2025-1002", ("grid", "invoice_date"): "28 December 2025", ("inline", "currency"): "GBP", ("heads", "total_due"): "92,000.00",
    ("undated", "invoice_no"): "GP-2025-1001", ("undated", "invoice_date"): "12 January 2025", ("own value", "subtotal"): "2,741.00", ("own value", "sales_tax"): "212.43", ("own value", "total_due"): "2,953.43",
    ("two taxes", "subtotal"): "4,000.00", ("two taxes", "sales_tax"): "480.00", ("two taxes", "tax_rate"): "5%", ("two taxes", "total_due"): "4,480.00",
    ("sections", "subtotal"): "4,500.00", ("sections", "sales_tax"): "0.00", ("sections", "total_due"): "4,500.00",
    ("whole", "subtotal"): "150000", ("whole", "sales_tax"): "15000", ("whole", "tax_rate"): "10%", ("whole", "total_due"): "165000", ("to date", "total_due"): "$150.00",
    ("next label", "period"): "30 November 2025 - 26 December 2025 EUR", ("next label", "period_start"): "30 November 2025", ("next label", "period_end"): "26 December 2025", ("suffix", "subtotal"): "1,900.00", ("suffix", "total_due"): "1,900.00",
    ("credit", "invoice_no"): "CN-1", ("credit", "total_due"): "(1,453.68)", ("crossed", "payment_due_date"): "16 March 2025", ("crossed", "customer_name"): "other column",
}


def test_fields(spark):
    rows = pages.fields(words(spark, DOCS)).collect()
    got = {(r.doc_id, r.field): r.raw for r in rows}
    assert len(got) == len(rows)
    skip = ("euros", "blanks")
    for key, raw in WANT.items():
        assert got.get(key) == raw, key
    assert {k: v for k, v in got.items() if k[0] not in skip and k not in WANT} == {("credit", "sales_tax"): "-GBP 12.00"}
    values = {(r.doc_id, r.field): r.value for r in rows}
    assert [values["euros", f] for f in ("subtotal", "sales_tax", "total_due")] == [Decimal("59400"), Decimal("4752"), Decimal("64152")]
    assert [values["blanks", f] for f in ("subtotal", "total_due")] == [Decimal("88400"), Decimal("106080")]
    assert values["credit", "total_due"] == Decimal("-1453.68") and values["credit", "sales_tax"] == Decimal("-12") and values["grid", "invoice_no"] is None


LABELS = {
    "Total (incl. 10% GST)": "total_due", "Total incl. VAT": "total_due", "Total Due (HK$)": "total_due", "Grand Total (HKD)": "total_due", "Amount to Pay": "total_due", "Please Pay": "total_due", "Invoice Total": "total_due", "Total Credit": "total_due", "Total Amount Due (USD)": "total_due",
    "Goods Total": "subtotal", "Total excl. GST": "subtotal", "Amount before tax": "subtotal", "Subtotal:": "subtotal", "Sous-total (HT)": "subtotal", "Zwischensumme": "subtotal", "小计": "subtotal",
    "Sales Tax (8%):": "sales_tax", "Withholding Tax": "sales_tax", "QST (9.975%)": "sales_tax", "MwSt. (19%)": "sales_tax", "税额（6%）": "sales_tax", "CGST (9%)": "sales_tax",
    "Tax Invoice No: SG-2026-0012": "invoice_no", "Tax Invoice #": "invoice_no", "Our Ref:": "invoice_no", "发票号码": "invoice_no", "开票日期": "invoice_date", "Bill To": "customer_name", "Billed To:": "customer_name",
    "Tax Advisory": None, "Totally new": None, "12 Total": None, "From Dusk till Dawn Ltd": None, "": None,
}


def test_labels(spark):
    rows = spark.createDataFrame([(t,) for t in LABELS], "text string")
    assert {r.text: r.label.field if r.label else None for r in pages.labelled(rows).collect()} == LABELS


def test_no_pages(spark):
    assert pages.fields(words(spark, {"a": [(1, 1, 2, 2, None), (3, 3, 4, 4, " ")]})).count() == 0


# ---- line items


def table(head, rows, xs=(45, 318, 411, 513), y=30):
    out = [(x, 10, x + 60, 18, h) for x, h in zip(xs, head) if h]
    for i, row in enumerate(rows):
        out += [(x, y + 20 * i, x + 7 * len(t), y + 20 * i + 8, t) for x, t in zip(xs, row) if t]
    return out


ITEM_DOCS = {
    "continued": table(["DESCRIPTION", "QTY", "RATE", "TOTAL"], [["Data Migration Services", "1", "27,000.00", "27,000.00"], ["Full data lift-and-shift."], ["", "", "TOTAL DUE", "27,000.00"]]),
    "tax service": table(["SERVICE DESCRIPTION", "QTY", "UNIT PRICE", "AMOUNT"], [["Fund Administration", "3", "44,500.00", "133,500.00"], ["Tax Advisory", "2", "32,500.00", "65,000.00"], ["KYC/AML Review", "1", "18,500.00", "18,500.00"], ["", "Subtotal", "", "217,000.00"]]),
    "merged": [(60, 10, 160, 18, "DESCRIPTION"), (326, 10, 350, 18, "QTY"), (424, 10, 460, 18, "UNIT"), (509, 10, 540, 18, "TOTAL"), (60, 30, 134, 38, "Market Research Report"), (332, 30, 339, 38, "3"), (428, 30, 478, 38, "45,000.00"), (491, 30, 545, 38, "135,000.00"), (371, 60, 430, 68, "Subtotal"), (491, 60, 545, 68, "135,000.00")],
    "stamped": table(["Description", "", "", "Amount"], [["Consulting", "", "", "$1,000.00"], ["COPY COPY COPY"], ["Design work", "", "", "$500.00"]]),
    "title": [(31, 10, 200, 18, "STATEMENT OF FEES"), (31, 40, 120, 48, "Description"), (405, 40, 450, 48, "Amount"), (31, 60, 180, 68, "Payroll processing"), (390, 60, 450, 68, "USD 680.00"), (31, 80, 200, 88, "MPF report preparation"), (390, 80, 450, 88, "USD 220.00"), (308, 100, 360, 108, "Net fees"), (405, 100, 460, 108, "USD 900.00")],
    "hk": [w for i, (d, a) in enumerate([("Description", "Amount"), ("Advisory service", "HK$11,610.00"), ("Net fees", "HK$11,610.00"), ("Invoice Total", "HK$11,958.30")]) for w in ((40, 10 + 20 * i, 160, 18 + 20 * i, d), (320, 10 + 20 * i, 400, 18 + 20 * i, a))],
    "to date": [(40, 100, 200, 112, "Description"), (400, 100, 470, 112, "This Period"), (505, 100, 580, 112, "Year to Date"), (40, 120, 120, 132, "Electricity"), (400, 120, 450, 132, "$100.00"), (505, 120, 560, 132, "$600.00"), (40, 140, 120, 152, "Water"), (400, 140, 450, 152, "$50.00"), (505, 140, 560, 152, "$300.00")],
    "address": table(["Description", "Qty", "", "Amount"], [["Audit", "2.5", "", "950.00"], ["12 Harbour Road"], ["Hong Kong", "", "", "1.00"]]),
    "footer": [(40, 10, 700, 18, "There will be an administration fee for reactivation of services after suspension of the account")],
    "parts": table(["Description", "", "", "Amount"], [["Design; Develop at USD 200.00; Deploy", "", "", "900.00"]]),
}

ITEMS = {
    "continued": [("Data Migration Services Full data lift-and-shift.", "1", "27,000.00", "27,000.00")],
    "tax service": [("Fund Administration", "3", "44,500.00", "133,500.00"), ("Tax Advisory", "2", "32,500.00", "65,000.00"), ("KYC/AML Review", "1", "18,500.00", "18,500.00")],
    "merged": [("Market Research Report", "3", "45,000.00", "135,000.00")],
    "stamped": [("Consulting", None, None, "$1,000.00"), ("Design work", None, None, "$500.00")],
    "title": [("Payroll processing", None, None, "680.00"), ("MPF report preparation", None, None, "220.00")],
    "hk": [("Advisory service", None, None, "HK$11,610.00")],
    "to date": [("Electricity", None, None, "$100.00"), ("Water", None, None, "$50.00")],
    "address": [("Audit", "2.5", None, "950.00")],
    "parts": [("Design", None, "200.00", "900.00"), ("Develop", None, None, "USD 200.00"), ("Deploy", None, None, None)],
}


def test_line_items(spark):
    got = {}
    for r in items.line_items(words(spark, ITEM_DOCS)).orderBy("doc_id", "item").collect():
        got.setdefault(r.doc_id, []).append((r.description, r.quantity, r.unit_price, r.amount))
    assert got == ITEMS


def test_long_descriptions_end_in_time(spark):
    rows = spark.createDataFrame([("consulting " + "at USD " * 5000,), ("Consulting services at USD 1,200.00",), ("Data migration",)], "t string")
    out = [r.c for r in rows.select(items.clean_description(F.col("t")).alias("c")).collect()]
    assert len(out[0]) <= items.DESCRIPTION and out[1:] == ["Consulting services", "Data migration"]


def test_bands(spark):
    texts = spark.createDataFrame([("a", 100.0, 45.0, "Audit"), ("a", 108.0, 45.0, "of books"), ("a", 116.0, 45.0, "Tax"), ("a", 60.0, 45.0, "far above"), ("b", 5.0, 1.0, "no amounts")], "doc_id string, y double, x double, text string")
    amounts = spark.createDataFrame([("a", 100.0, "1.00"), ("a", 120.0, "2.00"), ("a", 300.0, "3.00")], "doc_id string, y double, amount string")
    out = {(r.doc_id, r.amount): r.description for r in items.banded_items(texts, amounts).collect()}
    assert out == {("a", "1.00"): "Audit of books", ("a", "2.00"): "Tax", ("a", None): "far above", ("a", "3.00"): None, ("b", None): "no amounts"}


def test_orphan_totals(spark):
    docs = {
        "tax known": column(["Subtotal", "100.00", "Tax", "5.00", "COPY", "99.00", "105.00"]), "tax lone": column(["Subtotal: 100.00", "7.00", "8.00", "108.01", "300.00"]), "untaxed": column(["Subtotal: 100.00", "50.00", "100.00"]),
        "above": column(["105.00", "Subtotal: 100.00", "7.00"]), "none": column(["Subtotal: 100.00", "note", "33.00"]),
    }
    sums = spark.createDataFrame([("tax known", Decimal(100), Decimal(5))] + [(d, Decimal(100), None) for d in ("tax lone", "untaxed", "above", "none")], "doc_id string, subtotal decimal(18,2), tax decimal(18,2)")
    out = {r.doc_id: (r.tax, r.total) for r in items.orphan_totals(words(spark, docs), sums).collect()}
    assert out == {"tax known": (None, Decimal("105.00")), "tax lone": (Decimal("8.00"), Decimal("108.01")), "untaxed": (None, Decimal("100.00"))}


def test_minus_signs_of_stamps(spark):
    rows = spark.createDataFrame([("a", "total_due", "($2,500.00)", Decimal(-2500)), ("a", "issuer_name", "-x", None), ("c", "total_due", "-5.00", Decimal(-5))], "doc_id string, field string, raw string, value decimal(28,6)")
    out = {(r.doc_id, r.field): (r.raw, r.value) for r in items.unsigned_sums(rows, F.col("doc_id") == "c").collect()}
    assert out == {("a", "total_due"): ("$2,500.00", Decimal(2500)), ("a", "issuer_name"): ("-x", None), ("c", "total_due"): ("-5.00", Decimal(-5))}


def test_pages_are_laid_out_behind_the_last_exchange(spark, small):
    """Orders meet items as rows of items; words are made from these and go through no union of head and body."""
    from tallyframe.plans.page_queries import invoice_words

    plan = invoice_words(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_fields_take_the_words_of_a_page_together_once(spark):
    """One exchange brings the words of a page together and one the labels of a document; neither rows nor neighbours below are joined."""
    plan = pages.fields(words(spark, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_items_are_carried_along_in_one_order(spark):
    """No window over a whole document or page, which would sort its rows again."""
    plan = items.line_items(words(spark, ITEM_DOCS))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(" in plan and not re.search(r"windowspecdefinition\(doc_id#\d+(?:, page#\d+)?, (?:unspecified|specifiedwindow)", plan)


def test_cells_of_uneven_rows(spark):
    """Words of one row at unlike heights stand from left to right, blanks around them go, and gaps part them."""
    got = pages.cells(words(spark, {"a": [(60, 11, 90, 19, "b"), (10, 12, 40, 20, " a "), (200, 10, 210, 18, "c"), (10, 40, 20, 48, "d")]})).collect()
    assert {(r.row, r.cell, r.x0, r.x1, r.y0, r.y1, r.text) for r in got} == {(1, 1, 10.0, 90.0, 11.0, 20.0, "a b"), (1, 2, 200.0, 210.0, 10.0, 18.0, "c"), (2, 1, 10.0, 20.0, 40.0, 48.0, "d")}


def test_orphans_are_read_once(spark):
    """Amounts that stand alone meet twice what a total must be; the words behind them are not read again."""
    sums = spark.createDataFrame([("a", Decimal(100), None)], "doc_id string, subtotal decimal(18,2), tax decimal(18,2)")
    found = items.orphan_totals(words(spark, {"a": column(["Subtotal: 100.00", "8.00", "108.00"])}), sums)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.tax, r.total) for r in found.collect()] == [(Decimal("8.00"), Decimal("108.00"))]
