"""Small readings of single cells: direction marks, labels that are no items, dates and amounts amid text, spellings to search for."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.dates import parse_date
from tallyframe.functions.money import let, parse_amount

# fixed values: words that say which way money went
INCOME_WORDS = ["收入", "收", "贷", "贷方", "credit", "cr", "c", "+", "in", "收款", "存入", "转入", "进"]
EXPENSE_WORDS = ["支出", "支", "借", "借方", "debit", "dr", "d", "-", "out", "付款", "取出", "转出", "出"]

# fixed values: words of rows that sum up (one of CORE at least, the others beside it), words of stamps, and how names of seals end
SUM_CORE = [
    "total", "subtotal", "net", "tax", "vat", "gst", "cgst", "sgst", "igst", "pst", "hst", "qst", "mwst", "ust", "mehrwertsteuer", "tva", "due", "payable", "owing", "balance", "pay", "charge", "charges", "discount", "less", "freight", "shipping", "delivery", "handling", "rounding", "round",
    "zwischensumme", "montant", "gesamtbetrag", "gesamtsumme", "rechnungsbetrag", "小计", "价税合计", "价税总计", "合计", "税额", "税金", "增值税", "增值税额", "销项税", "销项税额", "应付金额", "总计", "总计金额", "总金额", "折扣", "优惠", "服务费", "小計", "合計", "総計", "消費税",
]
SUM_BESIDE = ["sub", "sous", "grand", "gross", "invoice", "goods", "final", "sales", "state", "consumption", "withholding", "value", "added", "service", "fee", "fees", "amount", "credit", "please", "to", "of", "the", "this", "period", "current", "before", "excl", "incl", "ex", "inclusive", "now", "outstanding", "sum", "ht", "ttc", "off"]
STAMP_WORDS = ["copy", "paid", "draft", "void", "original", "duplicate", "specimen", "canceled", "cancelled", "unpaid", "overdue", "作废", "副本", "已付", "已付款", "付讫", "收讫", "样本", "正本", "复印件"]
SEAL_ENDINGS = ["专用章", "公章", "seal"]
CODES = ["usd", "eur", "gbp", "cny", "rmb", "hkd", "sgd", "jpy", "aud", "cad", "chf", "nzd", "thb", "inr", "krw", "aed"]

#: How much of a text's letters a seal must make up beside a name; letters that show a stamp word cut off at the edge.
SEALED, CUT_OFF = 0.5, 3

#: Bounds of the grades, best first.
GRADES = [("Excellent", "0.98"), ("Good", "0.95"), ("Warning", "0.90")]


def words_of(text: Column) -> Column:
    """The runs of letters of a text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def _listed(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def strip_mark(raw: Column) -> Column:
    """struct(text, mark): an amount's text without a trailing Cr or Dr, and that mark in lower case."""
    pattern = r"(?i)\b(cr|dr)\.?\s*$"
    mark = F.nullif(F.lower(F.regexp_extract(F.trim(raw), pattern, 1)), F.lit(""))
    return F.struct(F.when(mark.isNull(), raw).otherwise(F.trim(F.regexp_replace(F.trim(raw), pattern, ""))).alias("text"), mark.alias("mark"))


def flow(word: Column) -> Column:
    """in, out, or null: what a word of a direction column says."""
    plain = F.lower(F.trim(word))
    return F.when(plain.isin(INCOME_WORDS), "in").when(plain.isin(EXPENSE_WORDS), "out")


def plain_text(s: Column) -> Column:
    """Blanks and hyphens of their families as plain ones; characters of no width go."""
    return F.translate(s, "\u00a0\u2007\u202f\u2010\u2011\u2012\u2060\u200b", "   ---")


def is_summary(description: Column) -> Column:
    """Whether a row sums up: all its words are those of sums, taxes and adjustments, and what else it has is brackets, a rate or a code."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(description, F.lit("")), r"[（(][^()（）]*[)）]", " "), r"\d+(?:\.\d+)?\s*%", " ")

    def judge(w: Column) -> Column:
        return F.exists(w, lambda x: x.isin(SUM_CORE)) & F.forall(w, lambda x: x.isin(SUM_CORE + SUM_BESIDE))

    # a text without such a word, and most have none, is not taken apart
    some = F.exists(words_of(F.coalesce(description, F.lit(""))), lambda x: x.isin(SUM_CORE))
    return F.when(some, ~bare.rlike(r"\d") & let(F.filter(words_of(bare), lambda x: ~x.isin(CODES)), judge)).otherwise(False)


def is_stamp(description: Column, words: Column | None = None) -> Column:
    """Whether a line is a stamp or a watermark: stamp words alone, the beginnings of such words beside whole ones, or a seal that makes up half of the letters.

    words: those of the text, where they are known."""
    letters = lambda w: F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x))
    begun = lambda x: (F.length(x) >= CUT_OFF) & F.exists(_listed(STAMP_WORDS), lambda w: w.startswith(x))

    def judge(w: Column) -> Column:
        stamps = F.filter(w, lambda x: x.isin(STAMP_WORDS))
        seals = F.filter(w, lambda x: F.exists(_listed(SEAL_ENDINGS), lambda e: x.endswith(e)))
        told = F.forall(w, lambda x: x.isin(STAMP_WORDS) | begun(x))
        return ((F.size(stamps) > 0) & told) | ((F.size(seals) > 0) & (letters(seals) + letters(stamps) >= SEALED * letters(w)))

    said = F.coalesce(description, F.lit(""))
    some = lambda w: F.exists(w, lambda x: x.isin(STAMP_WORDS) | reduce(or_, [x.endswith(e) for e in SEAL_ENDINGS]))
    of = lambda w: F.when(some(w), judge(w)).otherwise(False)
    return F.lower(said).rlike(r"^\W*not\s+for\s+payment\W*$") | (let(words_of(said), of) if words is None else of(words))


def leading_date(cell: Column) -> Column:
    """struct(value, words, rest): the date that a cell begins with, of its first three, two or one words; rest is the cell without it."""
    words = F.filter(F.split(F.trim(F.coalesce(cell, F.lit(""))), r"\s+"), lambda w: w != "")

    def read(w: Column) -> Column:
        tried = F.struct(*[F.when(F.size(w) >= n, parse_date(F.array_join(F.slice(w, 1, n), " "))["value"]).alias(f"t{n}") for n in (3, 2, 1)])

        def result(t: Column) -> Column:
            n = F.when(t["t3"].isNotNull(), 3).when(t["t2"].isNotNull(), 2).when(t["t1"].isNotNull(), 1)
            rest = F.when(n.isNull(), cell).otherwise(F.array_join(F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0))), " "))
            return F.struct(F.coalesce(t["t3"], t["t2"], t["t1"]).alias("value"), F.when(n.isNotNull(), F.array_join(F.slice(w, 1, n), " ")).alias("words"), rest.alias("rest"))

        return let(tried, result)  # each try is made once

    return let(words, read)


def lenient_amount(raw: Column) -> Column:
    """An amount as a person would type it: any common notation, else the first number in the text."""
    found = F.replace(F.regexp_extract(raw, r"-?\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit("")).try_cast("decimal(28,6)")
    return F.coalesce(parse_amount(raw)["value"], found)


def grade(quality: Column) -> Column:
    out = F.lit("HighRisk")
    for name, least in reversed(GRADES):
        out = F.when(quality >= F.lit(least).cast("decimal(3,2)"), name).otherwise(out)
    return out


def review_level(quality: Column) -> Column:
    return F.when(quality >= F.lit("0.95").cast("decimal(3,2)"), "normal").when(quality >= F.lit("0.90").cast("decimal(3,2)"), "recheck_key_fields").otherwise("needs_review")


def category_key(name: Column) -> Column:
    """Lower-case letters and digits, without one s at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", ""), "s$", "")


def date_variants(date: Column, raw: Column) -> Column:
    """Spellings of a date to look for in a document, the raw one first; those of under six characters are left out."""
    spelt = [F.date_format(date, f) for f in ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyMMdd")]
    return F.filter(F.array(raw, *spelt), lambda v: v.isNotNull() & (F.length(v) >= 6))


def amount_variants(amount: Column) -> Column:
    """Spellings of an amount without its sign: with a point, and with a comma for it; those of under three characters are left out."""
    s = F.trim(F.regexp_replace(amount.cast("string"), r"^[+-]+", ""))
    return F.filter(F.array(s, F.when(F.contains(s, F.lit(".")), F.replace(s, F.lit("."), F.lit(",")))), lambda v: v.isNotNull() & (F.length(v) >= 3))
