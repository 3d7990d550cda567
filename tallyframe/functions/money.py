"""Money: decimal types, half-even rounding, tolerances, and reading amounts from text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, RATE, REPORT = "decimal(18,2)", "decimal(18,12)", "decimal(38,2)"

# fixed values: currencies without decimals, and with three
NO_DECIMALS = ["JPY", "KRW", "VND", "CLP", "ISK", "XOF", "XAF"]
THREE_DECIMALS = ["BHD", "KWD", "OMR", "IQD", "JOD", "TND", "LYD"]


def money(c: Column | str) -> Column:
    """A number as money; doubles are cast before any arithmetic."""
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def total(c: Column) -> Column:
    return F.sum(c).cast(REPORT)


def half_even(c: Column, places: int = 2) -> Column:
    return F.bround(c, places)


def currency_decimals(currency: Column) -> Column:
    return F.when(currency.isin(NO_DECIMALS), 0).when(currency.isin(THREE_DECIMALS), 3).otherwise(2)


def match_tolerance(currency: Column) -> Column:
    """The least of a hundredth and one unit in the last place, places counted as two at least."""
    return F.when(currency_decimals(currency) == 3, F.lit("0.001")).otherwise(F.lit("0.01")).cast("decimal(18,4)")


def fee_tolerance(amount: Column) -> Column:
    """One, or half a hundredth of the amount where that is more."""
    return F.greatest(F.lit(1).cast("decimal(18,4)"), (F.abs(amount) * F.lit("0.005").cast("decimal(4,3)")).cast("decimal(18,4)"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often it is named.

    By element_at, which knows its type once; get asks the whole body for its type again for every row."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


_WRITTEN_PLAINLY = r"^-?(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)(?:\.[0-9]+)?\z"


def parse_amount(raw: Column) -> Column:
    """struct(value, suspicious): a number in any common notation; null where it is none.

    Without look-around, so that other engines can run the same patterns."""
    read = lambda t: let(_without_marks(t), lambda s: let(_plain(s), lambda body: _number(t, body)))
    # most amounts are written plainly, and a dozen patterns would find nothing to change in them
    plain = lambda t: F.struct(F.replace(t, F.lit(","), F.lit("")).try_cast("decimal(28,6)").alias("value"), F.lit(False).alias("suspicious"))
    return let(F.trim(F.translate(raw, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬", "01234567890123456789.,")), lambda t: F.when(t.rlike(_WRITTEN_PLAINLY), plain(t)).otherwise(read(t)))


def _without_marks(t: Column) -> Column:
    """Without a trailing minus, currency codes, and blanks or apostrophes between digits."""
    s = F.regexp_replace(t, r"\s*-$", "")
    s = F.regexp_replace(s, r"^[A-Za-z]{1,3}([$€£¥])", "$1")
    s = F.regexp_replace(s, r"^[A-Z]{3}[ \x{00A0}]+", "")
    s = F.regexp_replace(s, r"[ \x{00A0}]+[A-Z]{3}$", "")
    for _ in range(2):  # groups of one digit overlap
        s = F.regexp_replace(s, r"(\d)[ \x{00A0}\x{202F}'’](\d)", "$1$2")
    return s


def _plain(s: Column) -> Column:
    """With a point for the decimals and, where the grouping is valid, no commas; without parentheses."""
    european = s.rlike(r"\..*,[^.]*$")
    both = s.rlike(r",.*\.") & ~european
    whole = F.regexp_replace(F.substring_index(s, ".", 1), r"[^0-9,]", "")
    lone = s.rlike(r"^[^,.]*,[^,.]*$") & ~s.rlike(r",\d{3}([^0-9]*)$")
    comma_to_point = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.when(european | lone, comma_to_point).when(both & whole.rlike(r"^\d{1,3}(,\d{2,3})*,\d{3}$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
    return F.trim(F.regexp_replace(plain, r"[()]", ""))


def _number(t: Column, body: Column) -> Column:
    blank = t.isNull() | (t == "")
    odd = body.rlike("[OoIlSsBZ]") | body.rlike(r"\..*\.")
    valid = body.rlike(r"^[-+]?[$€£¥]?[-+]?(\d{1,3}(,\d{2,3})*,\d{3}|\d+)(\.\d+)?$")
    value = F.regexp_replace(body, r"[,$€£¥+\-]", "").try_cast("decimal(28,6)")
    negative = t.rlike(r"^\(.*\)$") | t.rlike(r"-$") | F.contains(body, F.lit("-"))
    number = F.when(~blank & valid, F.when(negative, -value).otherwise(value))
    return F.struct(number.alias("value"), F.when(blank, F.lit(False)).otherwise(~valid | odd).alias("suspicious"))
