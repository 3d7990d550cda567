"""Statements on pages: with heads, without, with signs, and with amounts lost."""

from decimal import Decimal

from test_pages import words

from tallyframe.operators import statement_pages as sp


def rows(*lines, xs=(40, 160, 400, 510), y=150):
    """Texts right-aligned from the third column on."""
    out = []
    for i, line in enumerate(lines):
        for x, t in zip(xs, line):
            if t:
                left = x if x < 300 else x + 60 - 6 * len(t)
                out.append((left, y + 18 * i, left + 6 * len(t), y + 18 * i + 9, t))
    return out


DOCS = {
    "signed": [(40, 90, 180, 99, "Opening Balance: 10,000.00")] + rows(("Date", "Transaction", "Amount", "Balance"), ("02-Mar-2026", "Salary", "5000.00", "15,000.00"), ("10-Mar-2026", "Rent", "-3000.00", "12,000.00")),
    "no heads": [(40, 50, 140, 59, "First National Bank")] + [(40, 110 + 18 * i, 40 + 5 * len(t), 119 + 18 * i, t) for i, t in enumerate(["2026-01-05   Salary deposit      +5,000.00     5,000.00", "2026-01-08   Grocery store       -320.50       4,679.50", "2026-01-15   Rent payment        -1,500.00     3,179.50"])],
    "lost": [(40, 90, 180, 99, "Opening Balance: 10,000.00")] + rows(("Date", "Description", "Debit", "Credit", "Balance"), ("02-Mar-2026", "Salary", "", "5000.00", "15,000.00"), ("10-Mar-2026", "Rent", "", "", "13,000.00"), xs=(40, 160, 330, 430, 530)),
    "columns": rows(("02-Mar-2026", "first", "", "5.00", "100.00"), ("03-Mar-2026", "out", "30.00", "", "70.00"), ("04-Mar-2026", "in", "", "20.00", "90.00"), ("05-Mar-2026", "unchecked", "8.00", "", ""), ("06-Mar-2026", "Total 1", "", "", ""), xs=(40, 160, 330, 430, 530)),
    "marks": [(40, 90, 300, 99, "Balance brought forward 50.00 Dr")] + rows(("2026-01-01", "paid", "7.00 Dr", ""), ("2026-01-02", "got", "9.00 CR", "")),
    "none": rows(("no date", "x", "1.00", "2.00")),
}


def test_transactions(spark):
    page = words(spark, DOCS)
    openings = sp.opening_balances(page)
    assert {r.doc_id: r.opening for r in openings.collect()} == {"signed": Decimal(10000), "lost": Decimal(10000), "marks": Decimal(-50)}
    got = {}
    found = sp.transactions(page, openings)
    for r in found.orderBy("doc_id", "page", "row").collect():
        num = lambda x: None if x is None else float(x)
        got.setdefault(r.doc_id, []).append((str(r.date), r.description, num(r.income), num(r.expense), num(r.balance), r.how))
    assert got == {
        "signed": [("2026-03-02", "Salary", 5000, None, 15000, "balance"), ("2026-03-10", "Rent", None, 3000, 12000, "sign")],
        "no heads": [("2026-01-05", "Salary deposit", 5000, None, 5000, "sign"), ("2026-01-08", "Grocery store", None, 320.5, 4679.5, "sign"), ("2026-01-15", "Rent payment", None, 1500, 3179.5, "sign")],
        "lost": [("2026-03-02", "Salary", 5000, None, 15000, "balance"), ("2026-03-10", "Rent", None, 2000, 13000, "recovered")],
        "columns": [("2026-03-02", "first", 5, None, 100, "column"), ("2026-03-03", "out", None, 30, 70, "balance"), ("2026-03-04", "in", 20, None, 90, "balance"), ("2026-03-05", "unchecked", None, 8, None, "column")],
        "marks": [("2026-01-01", "paid", None, 7, None, "sign"), ("2026-01-02", "got", 9, None, None, "sign")],
    }
    assert {r.doc_id: (r.rows, r.agree) for r in sp.running_check(found, openings).collect()} == {"signed": (2, 2), "no heads": (2, 2), "lost": (2, 2), "columns": (2, 2), "marks": (0, 0)}


def test_words_are_read_once_for_openings_and_transactions(spark):
    """A statement's words are told by a counter: both results come from one reading of them."""
    rows = [("d", 0, 40.0, 10.0, 140.0, 18.0, "Opening Balance: 100.00"), ("d", 0, 40.0, 40.0, 100.0, 48.0, "2024-01-02"), ("d", 0, 120.0, 40.0, 160.0, 48.0, "in"), ("d", 0, 300.0, 40.0, 340.0, 48.0, "5.00"), ("d", 0, 400.0, 40.0, 440.0, 48.0, "105.00")]
    schema = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    words = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    found, openings = sp.statements(words)
    assert [(r.rows, r.agree) for r in sp.running_check(found, openings).collect()] == [(1, 1)]
    assert [(float(r.income), float(r.balance)) for r in found.collect()] == [(5.0, 105.0)]
    assert seen.value == len(rows)


def test_statements_are_dealt_over_all_tasks(spark, small):
    """By their bytes they would be one task, but what is laid out and read behind the numbering is far more."""
    from tallyframe.plans.page_queries import statement_words

    assert statement_words(spark, small).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_what_words_say_is_told_without_lambdas(spark):
    """Words of several parts, marks with points, amounts in brackets; of the reading only the list of amounts goes through lambdas."""
    page = words(spark, {"d": [(40, 50, 240, 59, "3 Mar 2026  paid by wire"), (300, 51, 330, 60, "(5.00)"), (340, 50, 360, 59, "D.r."), (400, 50, 440, 59, "95.00"), (445, 52, 455, 61, "x")]})
    rows = sp._token_rows(page, 3.0)
    (row,) = sp.dated_rows(page).collect()
    assert (str(row.date), row.description, row.mark) == ("2026-03-03", "paid by wire", -1)
    assert [(m.x1, m.raw, float(m.value), m.sign) for m in row.monies] == [(330.0, "(5.00)", 5.0, -1), (440.0, "95.00", 95.0, None)]
    assert not [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "lambdafunction" in x and "Project" not in x]
