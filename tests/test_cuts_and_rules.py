"""Cuts by hand, and rules written as sentences."""

from tallyframe.functions import rule_text
from tallyframe.operators import cuts


def test_cuts(spark):
    words = spark.createDataFrame([("a", p, 0.0, float(y), 9.0, float(y) + 5, f"{p}/{y}") for p in (0, 1) for y in (10, 49, 50, 90, 120)] + [("b", 0, 0.0, 5.0, 9.0, 9.0, "alone"), ("c", 0, 0.0, 5.0, 9.0, 9.0, "no height")], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    lines = spark.createDataFrame([("a", 0, 0.5), ("a", 0, 0.5), ("a", 1, 0.7), ("a", 1, 0.8), ("a", 0, 0.0), ("a", 1, 7.0), ("c", 0, 0.5)], "doc_id string, page int, pos double")
    pages = spark.createDataFrame([("a", 0, 100.0), ("a", 1, 100.0), ("b", 0, 100.0)], "doc_id string, page int, height double")
    out = cuts.cut(words, lines, pages)
    got = {}
    for r in out.orderBy("doc_id", "page", "y0").collect():
        got.setdefault((r.doc_id, r.part, r.parts), []).append(r.text)
    assert got == {("a", 1, 4): ["0/10", "0/49"], ("a", 2, 4): ["0/50", "0/90", "0/120", "1/10", "1/49", "1/50"], ("a", 3, 4): ["1/90"], ("a", 4, 4): ["1/120"], ("b", 1, 1): ["alone"], ("c", 1, 1): ["no height"]}
    assert {r.doc_id for r in cuts.documents(out).collect()} == {"a:cut1/4", "a:cut2/4", "a:cut3/4", "a:cut4/4", "b:cut1/1", "c:cut1/1"}


def test_words_are_cut_in_one_order(spark):
    """Heights come by the document, a page measured twice repeats no word, and no rank over all parts sorts the words again."""
    words = spark.createDataFrame([("a", 0, 0.0, float(y), 9.0, float(y) + 5, str(y)) for y in (10, 60)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    out = cuts.cut(words, spark.createDataFrame([("a", 0, 0.5)], "doc_id string, page int, pos double"), spark.createDataFrame([("a", 0, 100.0), ("a", 0, 90.0)], "doc_id string, page int, height double"))
    assert sorted((r.text, r.part, r.parts) for r in out.collect()) == [("10", 1, 2), ("60", 2, 2)]
    assert "dense_rank" not in out._jdf.queryExecution().optimizedPlan().toString()


SENTENCES = [
    ("classification", "以后老王家的发票都记 6400 咨询费", None, ("老王", "Consulting", "6400 咨询费", None, None, [])),
    ("classification", "invoices from Acme Labs go to account = 6520 Utilities; category = Utilities", None, ("Acme Labs", "Utilities", "6520 Utilities", None, None, [])),
    ("classification", "分类：办公费，科目：9999 其他", "old", ("old", "办公费", "9999 其他", None, None, [])),
    ("classification", "记到 7777", None, (None, None, "7777", None, None, ["match_key", "category"])),
    ("field_default", "Acme 的发票，币种填为「EUR」", None, ("Acme", None, None, "currency", "EUR", [])),
    ("field_default", "issuer = Beta, set to 5% the tax rate", None, ("Beta", None, None, "tax_rate", "5% the tax rate", [])),
    ("field_locator", '发票日期 在 "Issued on" 后面', None, (None, None, None, "invoice_date", "Issued on", [])),
    ("field_locator", "开票方地址 后面", None, (None, None, None, "issuer_address", None, ["value"])),
    ("multi_invoice", "这家都当作一张", None, (None, None, None, None, "single", [])),
    ("multi_invoice", "please split them", None, (None, None, None, None, "multi", [])),
    ("multi_invoice", "?", None, (None, None, None, None, None, ["value"])),
    ("content_class", "catering for events", None, (None, None, None, None, "catering for events", ["category", "account"])),
    ("line_split", "", None, (None, None, None, None, None, [])),
    ("field_default", None, None, (None, None, None, None, None, ["match_key", "target", "value"])),
]


def test_sentences(spark):
    rules = spark.createDataFrame([(i, t, s, k) for i, (t, s, k, _) in enumerate(SENTENCES)], "id int, rule_type string, text string, match_key string")
    pairs = spark.createDataFrame([("Consulting", "6400 咨询费"), ("Utilities", "6520 Utilities"), ("Other", "6400")], "category string, account string")
    got = {r.id: (r.match_key, r.category, r.account, r.target, r.value, r.missing) for r in rule_text.read(rules, pairs).collect()}
    for i, (_, sentence, _, want) in enumerate(SENTENCES):
        assert got[i] == want, sentence


PROSE = {
    "The subtotal is USD 2,605.00. Applicable tax is USD 201.89. The total amount due is USD 2,806.89.": ("2,605.00", "201.89", "2,806.89"),
    "Fund Administration 133,500.00 Tax Advisory 2 32,500.00 65,000.00 Subtotal GBP 217,000.00 Total Due GBP 217,000.00": ("217,000.00", None, "217,000.00"),
    "Total excl. GST HK$5,096.00 Please Pay HK$5,096.00": (None, None, None),
    "Sub total: 12 and VAT = 5% only": ("12", None, None),
    "": (None, None, None),
    None: (None, None, None),
}


def test_amounts_in_sentences(spark):
    from pyspark.sql import functions as F

    from tallyframe.functions import extract

    rows = spark.createDataFrame([(t,) for t in PROSE], "t string").select("t", extract.prose_amounts(F.col("t")).alias("p")).collect()
    assert {r.t: tuple(r.p) for r in rows} == PROSE
    taxed = spark.createDataFrame([("Total Incl. tax (15%): GBP 11,700.00",), ("incl. VAT £1,200.00",), (None,)], "t string").select(extract.included_tax(F.col("t")).alias("p")).collect()
    assert [tuple(r.p) for r in taxed] == [("15%", "11,700.00"), (None, None), (None, None)]
