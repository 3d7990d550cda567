"""Currency: the latest rate on or before a day, conversion, revaluation of what is open.

Rates: currency, rate_date, rate (one unit in the functional currency).  They are small next to what they are joined
to, but their number is not assumed: a join by currency keeps, for each row, the range of days each rate holds for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import RATE, half_even, total

FUNCTIONAL = "USD"


def latest_rates(rates: DataFrame) -> DataFrame:
    """One positive rate per currency and day: the last by `version`, where there is one."""
    order = [F.desc("version")] if "version" in rates.columns else [F.desc("rate")]
    best = F.row_number().over(Window.partitionBy("currency", "rate_date").orderBy(*order))
    return rates.where((F.col("rate") > 0) & (F.col("currency") != FUNCTIONAL)).withColumn("_n", best).where("_n = 1").select("currency", "rate_date", "rate")


def rate_as_of(df: DataFrame, rates: DataFrame, *, currency: str = "currency", date: str = "date") -> DataFrame:
    """df with rate and rate_date: 1 for the functional currency; null without an earlier rate or without a date.

    Each rate becomes a range of days, so a row meets at most one."""
    until = F.lead("rate_date").over(Window.partitionBy("currency").orderBy("rate_date"))
    ranges = latest_rates(rates).select(F.col("currency").alias("_ccy"), F.col("rate").cast(RATE).alias("_rate"), F.col("rate_date").alias("_from"), until.alias("_until"))
    meets = (F.col(currency) == F.col("_ccy")) & (F.col(date) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(date) < F.col("_until")))
    joined = df.join(ranges, meets, "left")
    own = F.col(currency) == FUNCTIONAL
    return joined.withColumns({"rate": F.when(own, F.lit(1).cast(RATE)).otherwise(F.col("_rate")), "rate_date": F.when(own, F.col(date)).otherwise(F.col("_from"))}).drop("_ccy", "_rate", "_from", "_until")


def stale_days(date: Column, rate_date: Column) -> Column:
    return F.abs(F.datediff(date, rate_date))


def to_functional(amount: Column, rate: Column) -> Column:
    return half_even(amount * rate).cast("decimal(38,2)")


def revaluation(open_items: DataFrame, rates: DataFrame, as_of: Column) -> DataFrame:
    """open_items(hash, direction, currency, total, gross, open): what is open in its own currency at the rate of as_of, and the gain not yet realised."""
    foreign = open_items.where((F.col("currency") != FUNCTIONAL) & (F.col("total") > 0) & (F.col("gross") > 0) & (F.col("open") > 0)).withColumn("as_of", as_of)
    # product and quotient with places enough that rounding happens once
    open_ccy = half_even((F.col("total").cast("decimal(14,2)") * F.col("open").cast("decimal(14,2)")).cast("decimal(28,4)") / F.col("gross").cast("decimal(9,2)"))
    valued = rate_as_of(foreign.withColumn("open_ccy", open_ccy.cast("decimal(18,2)")), rates, date="as_of")
    reval = to_functional(F.col("open_ccy"), F.col("rate"))
    diff = reval - F.col("open")
    return valued.withColumns({"reval": reval, "unrealised": F.when(F.col("direction") == "AR", diff).otherwise(-diff).cast("decimal(38,2)"), "missing_rate": F.col("rate").isNull()})


def revaluation_by_currency(valued: DataFrame) -> DataFrame:
    return valued.groupBy("currency").agg(F.count("*").alias("n_items"), total(F.col("open_ccy")).alias("open_ccy"), total(F.col("open")).alias("book"), total(F.col("reval")).alias("reval"), total(F.col("unrealised")).alias("unrealised"), F.bool_or("missing_rate").alias("missing_rate"))
