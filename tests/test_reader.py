"""Statements of every format through one reader."""

from test_sheets import inline
from test_sheets import workbook as zipped

from tallyframe.sources import reader

FILES = {
    "a.csv": 'My bank\nDate;Details;Amount;Balance\n2026-01-02;"Rent; flat";-1,500.00;8,500.00\n\n02-Mar-2026;"a ""b""";20.50;8,520.50\nTotal;;;\n',
    "b.tsv": "Transaction Date\tDescription\tDebit\tCredit\n2026-01-02\tx\t5.00\t\n2026-01-03\ty\t\t7.00\n",
    "c.json": '{"account": "1", "transactions": [{"Date": "2026-01-02", "Amount": "-5.00", "Description": "json"}, {"Date": "no", "Amount": "1"}]}',
    "d.ndjson": '{"date": "2026-01-02", "amount": 5}\n{"date": "2026-01-03", "amount": 6}\n',
    "e.html": "<html><table><tr><th>Date</th><th>Amount</th><th>Description</th></tr><tr><td>2026-01-02</td><td>1.00</td><td>t &amp; t</td></tr></table></html>",
    "f.txt": "!Type:Bank\nD01/02/2026\nT-3.00\nPqif\n^\n",
    "g.bin": "nothing at all",
}


def test_one_reader(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "h.xlsx").write_bytes(zipped([inline(["Account"], ["Date", "", "Amount", "Description"], ["2026-01-02", "z", "9.00", "sheet"], ["2026-01-03", "", "1.00"])]))
    got = {}
    for r in reader.read(spark, str(tmp_path)).orderBy("file", "idx").collect():
        num = lambda x: None if x is None else float(x)
        got.setdefault((r.file.split("/")[-1], r.format), []).append((str(r.date), num(r.amount), num(r.balance), r.description))
    assert got == {
        ("a.csv", "delimited"): [("2026-01-02", -1500, 8500, "Rent; flat"), ("2026-03-02", 20.5, 8520.5, 'a "b"')], ("b.tsv", "delimited"): [("2026-01-02", -5, None, "x"), ("2026-01-03", 7, None, "y")],
        ("c.json", "json"): [("2026-01-02", -5, None, "json")], ("d.ndjson", "json"): [("2026-01-02", 5, None, None), ("2026-01-03", 6, None, None)], ("e.html", "html"): [("2026-01-02", 1, None, "t & t")],
        ("f.txt", "qif"): [("2026-01-02", -3, None, "qif")], ("h.xlsx#S0", "workbook"): [("2026-01-02", 9, None, "sheet"), ("2026-01-03", 1, None, "")],
    }


def test_files_are_told_apart_once(spark):
    """Every format has its reader, and the files are not made again for each."""
    seen, schema = spark.sparkContext.accumulator(0), "file string, content string"

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([("a.csv", "Date;Description;Amount\n2024-01-02;rent;-5.00\n"), ("b.ndjson", '{"Date": "2024-01-03", "Amount": "7.00", "Description": "in"}')], schema).mapInArrow(counted, schema)
    assert sorted((r.file, str(r.date), float(r.amount)) for r in reader.transactions(files).collect()) == [("a.csv", "2024-01-02", -5.0), ("b.ndjson", "2024-01-03", 7.0)]
    assert seen.value == 2
