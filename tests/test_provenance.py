"""Fields by source, learned values, and rules applied again."""

from pyspark.sql import functions as F

from tallyframe.operators import provenance as p

SCHEMA = "doc_id int, field string, source string, raw string, value string, confidence double"


def test_a_later_source_fills_only_what_is_empty_or_unreadable(spark):
    rows = [
        (1, "total", "template", "5", "5", 0.98), (1, "total", "generic", "7", "7", 0.9), (1, "date", "template", "rubbish", None, 0.98), (1, "date", "generic", "1 May 2026", "2026-05-01", 0.9),
        (1, "issuer_name", "template", "INVOICE", "INVOICE", 0.98), (1, "issuer_name", "generic", "Acme Ltd", "Acme Ltd", 0.9), (1, "issuer_address", "template", "Date: 5 May", "Date: 5 May", 0.98), (1, "issuer_address", "generic", "1 High St", "1 High St", 0.9),
        (2, "total", "generic", "7", "7", 0.9), (2, "total", "generic", "6", "6", 0.95), (2, "total", "manual", "1", "1", 1.0), (2, "date", "template", "rubbish", None, 0.9), (2, "note", "elsewhere", "x", "x", 0.1), (2, "empty", "generic", " ", None, 0.1), (2, "empty", "template", None, None, 0.1),
    ]
    got = {(r.doc_id, r.field): (r.value, r.source, r.overruled) for r in p.filled(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        (1, "total"): ("5", "template", ["generic"]), (1, "date"): ("2026-05-01", "generic", []), (1, "issuer_name"): ("Acme Ltd", "generic", []), (1, "issuer_address"): ("1 High St", "generic", []),
        (2, "total"): ("1", "manual", ["generic"]), (2, "date"): (None, "template", []), (2, "note"): ("x", "elsewhere", []),
    }


def test_labels_and_values(spark):
    rows = [("Our ref: AB-1\nAmount (net)  5.00\nDue\n 1 May 2026", "our  REF", "AB-1"), ("Our ref: AB-1", "net", None), ("Amount (net)  5.00", "Amount (net)", "5.00"), ("x\nDue\n 1 May 2026", "due", "1 May 2026"), ("Residue 5", "due", None), (None, "due", None), ("", "due", None)]
    out = spark.createDataFrame(rows, "text string, label string, want string").select(p.value_by_label(F.col("text"), F.col("label")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]
    rows = [("Total: 5\nOur ref: AB-1", "AB-1", "Our ref"), ("Total due 5.00", "5.00", "Total due"), ("5.00", "5.00", None), ("Total 15.00", "5.00", None)]
    out = spark.createDataFrame(rows, "text string, value string, want string").select(p.label_of(F.col("text"), F.col("value")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_rules_are_applied_again_to_what_they_touch(spark):
    docs = spark.createDataFrame([
        (1, "acme", "f1", "Paid in EUR", "Pending", False, 3), (2, "acme", "f1", "Paid in EUR", "Approved", False, 1), (3, "acme", "f1", "Paid in EUR", "Hold", True, 1), (4, "other", "f1", "Paid in GBP", "Pending", False, 1),
        (5, "acme", "f2", "no code", "Pending", False, 1), (6, "acme", "f2", "Paid in EUR", None, None, 1), (7, "third", "f3", "Paid in EUR", "Pending", False, 1)], "doc_id int, issuer string, fingerprint string, text string, status string, locked boolean, rev int")
    told = spark.createDataFrame([(i, "invoice_no", "template", f"I{i}", f"I{i}", 0.98) for i in range(1, 8)] + [(6, "currency", "manual", "XXX", "XXX", 1.0), (4, "currency", "generic", "??", None, 0.5)], SCHEMA)
    present = told.select("doc_id", "field", "value")
    rules = spark.createDataFrame([("default", "issuer", "acme", "currency", "EUR", None, 3, "active", 10), ("locator", "fingerprint", "f1", "currency", None, "Paid in", 1, "active", 5), ("default", "issuer", "third", "currency", "EUR", None, 1, "pending", 10)], "kind string, scope string, match_key string, field string, value string, label string, confirm_count int, status string, at int")
    run = lambda since: {r.doc_id: (r.rev, r.fields["currency"].value if "currency" in r.fields else None, r.fields["currency"].source if "currency" in r.fields else None, r.changed, r.missing, r.least_confidence, r.needs_manual) for r in p.reapplied(docs, told, present, rules, F.lit(since), kinds={"currency": "code"}, required=("invoice_no", "currency")).collect()}
    # the rule of acme changed: 1 gets a currency, 5 does not hold it, 6 was entered by hand, 2 and 3 are closed; 4 is not touched
    assert run(10) == {1: (4, "EUR", "learned_locator", ["currency"], [], 0.83, False)}
    assert run(5) == {1: (4, "EUR", "learned_locator", ["currency"], [], 0.83, False), 4: (2, "GBP", "learned_locator", ["currency"], [], 0.83, False)}
    assert run(11) == {}
