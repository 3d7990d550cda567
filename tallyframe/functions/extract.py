"""Extracts from the text of invoices and statements."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Any code of three capitals, and two of four.
CODES = "USDC|USDT|[A-Z]{3}"


def _first(s: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


#: Where a code stands: behind a label, in brackets, behind `in`, and before a number with decimals or groups.
CODE_PATTERNS = [rf"(?i:currency|\bccy)\s*[:：]?\s*({CODES})\b", rf"\(\s*({CODES})\s*\)", rf"\b(?i:in) ({CODES})\b", rf"\b({CODES})\s*(?:\d{{1,3}}(?:,\d{{3}})+|\d+\.\d{{2}})"]


def currency(s: Column) -> Column:
    """By label, header `(GBP)`, `in USD`, a code before an amount, then signs; a bare dollar or yen sign tells nothing."""
    sign = F.when(s.rlike(r"US\$"), "USD").when(s.rlike(r"HK\$"), "HKD").when(s.rlike(r"S\$\s?\d"), "SGD").when(s.rlike("€"), "EUR").when(s.rlike("£"), "GBP")
    for mark, code in (("₹", "INR"), ("₩", "KRW"), ("฿", "THB"), ("₱", "PHP"), ("₦", "NGN"), ("₫", "VND"), ("₪", "ILS")):
        sign = sign.when(F.contains(s, F.lit(mark)), code)
    return F.coalesce(*[_first(s, p) for p in CODE_PATTERNS], sign)


#: A number as sentences have it, with a code or a sign before it; no rate.
_SAID = r"(?:[A-Z]{3}\s*)?[$€£¥₹]?\s*(\d[\d,]*(?:\.\d+)?)(?![\d.,]*\d|\s*%)"
_LINK = r"\s*(?:(?:is|of|totals?|totalling|amounts to|comes to)\b)?\s*[:：=]?\s*"


def prose_amounts(s: Column) -> Column:
    """struct(subtotal, sales_tax, total_due) as sentences name them: `the subtotal is USD 2,605.00`, `applicable tax: 201.89`.

    Nothing but a verb or a colon may stand between the words and the amount, so a service called Tax Advisory has no tax; the tax in `total excl. GST` is part of another name."""
    # a tax that is only named as left out or included goes first, and a total without it with the name
    said = F.regexp_replace(s, r"(?i)\b(?:total\s+)?(?:excl|excluding|incl|including|before)\b\.?\s+(?:tax|vat|gst)\b", " ; ")
    amount = lambda words: _first(said, rf"(?i)\b(?:{words})\b{_LINK}(?-i:{_SAID})")
    return F.struct(amount(r"sub\s?total").alias("subtotal"), amount(r"(?:applicable |sales )?(?:tax|vat|gst)").alias("sales_tax"), amount(r"(?<!sub)(?<!sub )total(?: amount)?(?: due| payable)?").alias("total_due"))


def included_tax(s: Column) -> Column:
    """struct(rate, amount) of `incl. tax (15%): GBP 11,700.00`."""
    pattern = rf"(?i)\bincl(?:uding|usive of|\.)?\s*(?:of\s+)?(?:tax|vat|gst)\s*\(?\s*(\d+(?:\.\d+)?)\s*%\s*\)?\s*[:：]?\s*(?-i:{_SAID})"
    return F.struct(F.nullif(F.concat(_first(s, pattern, 1), F.lit("%")), F.lit("%")).alias("rate"), _first(s, pattern, 2).alias("amount"))


def period(s: Column) -> Column:
    """struct(start, end) of a range of ISO or written dates."""
    day = r"(\d{4}-\d{2}-\d{2}|\d{1,2} [A-Z][a-z]{2} \d{4})"
    pattern = rf"(?:from\s+)?{day}\s*(?:to|until|through|-|–|至)\s*{day}"
    read = lambda i: F.coalesce(F.try_to_date(F.regexp_extract(s, pattern, i), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(s, pattern, i), "d MMM yyyy"))
    return F.struct(read(1).alias("start"), read(2).alias("end"))


def total_markers(s: Column) -> Column:
    """How many invoices a text holds, by its lines of totals."""
    return F.regexp_count(s, F.lit(r"(?im)^\s*(?:grand total|total due|amount due|balance due|total)\b"))


def segments(s: Column) -> Column:
    """The text cut before each line that starts an invoice, if there are as many starts as totals; else whole."""
    parts = F.filter(F.split(s, r"(?m)(?=^\s*(?:INVOICE|Invoice)\b)"), lambda x: F.trim(x) != "")
    return F.when((total_markers(s) >= 2) & (F.size(parts) == total_markers(s)), parts).otherwise(F.array(s))


SPLITS = [("newline", r"\r?\n"), ("numbered", r"\s*(?:^|\s)\d{1,2}[.)]\s+"), ("bullet", r"\s*[•·▪]\s*"), ("semicolon", r"\s*;\s*"), ("pipe", r"\s*\|\s*"), ("dash", r"\s+[-–]\s+")]


def pieces(s: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(s, pattern), lambda x: F.trim(x)), lambda x: x != "")


def split_pattern(s: Column, wanted: Column) -> Column:
    """The name of the first pattern that cuts the text into just these pieces."""
    return F.coalesce(*[F.when(pieces(s, p) == wanted, F.lit(name)) for name, p in SPLITS])


def exploded_description(s: Column) -> Column:
    """Parts of a description, cut at `;`, `|`, lines and amounts; parts without a letter go."""
    money = r"(?:[$€£¥]|\b[A-Z]{3}\s)?\s?\b\d{1,3}(?:,\d{3})*\.\d{2}\b"
    return F.filter(pieces(s, rf"[;|\n]|{money}"), lambda x: x.rlike(r"\pL"))


def repaired_amounts(s: Column) -> Column:
    """Reading errors in amounts: S or 5 for a dollar sign before digits, a colon for the point."""
    return F.regexp_replace(F.regexp_replace(s, r"(^|\s)S(\d{1,3}(?:,\d{3})*[.:]\d{2})\b", r"$1\$$2"), r"(\d{1,3}(?:,\d{3})*|\d+):(\d{2})\b(?!:)", "$1.$2")


def is_statement(s: Column) -> Column:
    words = lambda *w: s.rlike("(?i)" + "|".join(w))
    return words("bank statement", "account statement", "对账单", "交易明细") | (words(r"\bdate\b", "日期") & words(r"\bbalance\b", "余额") & words("debit|credit|amount|withdrawal|deposit", "金额|借方|贷方"))


def statement_head(s: Column) -> Column:
    """struct(opening, closing, currency, account)."""
    amount = lambda label: F.replace(_first(s, rf"(?i)(?:{label})\s*[:：]?\s*(?:[A-Z]{{3}}\s*)?(-?[\d,]+\.\d{{2}})"), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    return F.struct(amount("opening balance|brought forward").alias("opening"), amount("closing balance|carried forward").alias("closing"), _first(s, CODE_PATTERNS[0]).alias("currency"), _first(s, r"(?i)account (?:no\.?|number)\s*[:：]?\s*([A-Z0-9-]{5,34})").alias("account"))


def useful_chars(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"[^\pL\pN]", ""))


def decimal_places(s: Column) -> Column:
    """Digits behind the last point; null without one."""
    return F.when(F.contains(s, F.lit(".")), F.length(F.regexp_replace(F.substring_index(s, ".", -1), r"\D", "")))


_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _tron(address: str | None) -> bool:
    n = 0
    for c in address or "0":
        if c not in _BASE58:
            return False
        n = n * 58 + _BASE58.index(c)
    if n.bit_length() > 200:
        return False
    data = n.to_bytes(25, "big")
    return data[0] == 0x41 and hashlib.sha256(hashlib.sha256(data[:21]).digest()).digest()[:4] == data[21:]


@F.pandas_udf(T.BooleanType())
def valid_tron(address: pd.Series) -> pd.Series:
    """Base58 with a checksum, which needs numbers of 25 bytes."""
    return address.map(_tron)
