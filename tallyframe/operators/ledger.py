"""Double-entry postings as rows: accrual, settlement, reversal, closing, and what is derived from them.

Journal lines: entry_id, entry_date, source_kind, source_id, party, activity, reverses_id, account, debit, credit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import MONEY, total
from tallyframe.operators import accounts as A
from tallyframe.session import checkpointed, small

LINE_COLUMNS = ["entry_id", "entry_date", "source_kind", "source_id", "party", "activity", "reverses_id", "account", "debit", "credit"]


def zero() -> Column:
    return F.lit(0).cast(MONEY)



def period(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("0000-00"))


Line = tuple[Column | str, Column | None, Column | None]


def _explode(entries: DataFrame, lines: list[Line], other: list[Line] | None = None, when: Column | None = None) -> DataFrame:
    """A row per line (account, debit, credit); lines of nothing are left out.  `other` stands instead where `when` does not hold.

    Rows are numbered first and each takes its own line, so amounts are columns that are computed once, in compiled code."""
    k = F.col("_k")
    other = other or lines
    none = (F.lit(None).cast("string"), None, None)

    def pick(part: int, own: Callable[[Column | str | None], Column]) -> Column:
        out = F.lit(None)
        for n in range(max(len(lines), len(other)) - 1, -1, -1):
            a, b = (own((x[n] if n < len(x) else none)[part]) for x in (lines, other))
            out = F.when(k == n, a if when is None else F.when(when, a).otherwise(b)).otherwise(out)
        return out

    amount = lambda c: zero() if c is None else c.cast(MONEY)
    numbered = entries.withColumn("_k", F.explode(F.array(*[F.lit(n) for n in range(max(len(lines), len(other)))])))
    out = numbered.select(*[c for c in LINE_COLUMNS if c not in ("account", "debit", "credit")], pick(0, lambda c: F.lit(c) if isinstance(c, str) else c).alias("account"), pick(1, amount).cast(MONEY).alias("debit"), pick(2, amount).cast(MONEY).alias("credit"))
    return out.where("debit <> 0 OR credit <> 0")


def _entry(df: DataFrame, **columns: Column) -> DataFrame:
    blank = {c: F.lit(None).cast("string") for c in ("party", "activity", "reverses_id") if c not in columns}
    return df.withColumns(columns | blank)


def repaired_amounts(total_: Column, subtotal: Column, tax: Column) -> dict[str, Column]:
    """total, subtotal, tax that add up: a missing total is their sum, a missing subtotal the total, else tax gives way."""
    t = F.when(F.coalesce(total_, zero()) <= 0, F.coalesce(subtotal, zero()) + F.coalesce(tax, zero())).otherwise(total_).cast(MONEY)
    s = F.when(F.coalesce(subtotal, zero()) <= 0, t).otherwise(F.least(subtotal, t)).cast(MONEY)
    return {"total": t, "subtotal": s, "tax": (t - s).cast(MONEY)}


def accruals(invoices: DataFrame, *, deductible: bool = True) -> DataFrame:
    """invoices(hash, date, party, direction AR|AP, account, total, subtotal, tax) -> lines; those without a positive total post nothing."""
    # amounts come out of an array, as a filter on plain columns would move below them and compute them again
    repaired = F.struct(*[c.alias(k) for k, c in repaired_amounts(F.col("total"), F.col("subtotal"), F.col("tax")).items()])
    fixed = invoices.withColumn("_a", F.explode(F.array(repaired))).where("_a.total > 0").withColumns({c: F.col(f"_a.{c}") for c in ("total", "subtotal", "tax")}).drop("_a")
    entries = _entry(fixed, entry_id=F.concat(F.lit("acc-"), F.col("hash")), entry_date=F.col("date"), source_kind=F.lit("invoice"), source_id=F.col("hash"), party=F.col("party"))
    net = F.col("subtotal") if deductible else F.col("total")
    ap = [(F.col("account"), net, None), (A.INPUT_TAX, F.col("tax") if deductible else None, None), (A.PAYABLE, None, F.col("total"))]
    ar = [(A.RECEIVABLE, F.col("total"), None), (F.col("account"), None, F.col("subtotal")), (A.OUTPUT_TAX, None, F.col("tax"))]
    return _explode(entries, ar, ap, F.col("direction") == "AR")


def settlements(paid: DataFrame) -> DataFrame:
    """paid(hash, date, party, direction, settle, diff, diff_account, nature) -> lines.

    `settle` clears the control account, `diff` goes to its own account and the rest through the bank; buying a fixed asset is investing."""
    activity = F.when(F.col("nature").startswith("15") | F.col("nature").startswith("16"), "investing").otherwise("operating")
    entries = _entry(paid.where("settle > 0"), entry_id=F.concat(F.lit("set-"), F.col("hash")), entry_date=F.col("date"), source_kind=F.lit("settlement"), source_id=F.col("hash"), party=F.col("party"), activity=activity)
    cash = F.col("settle") - F.col("diff")
    more, less = F.greatest(F.col("diff"), zero()), F.greatest(-F.col("diff"), zero())
    ar = [(A.CASH, cash, None), (F.col("diff_account"), more, less), (A.RECEIVABLE, None, F.col("settle"))]
    ap = [(A.PAYABLE, F.col("settle"), None), (F.col("diff_account"), less, more), (A.CASH, None, cash)]
    return _explode(entries, ar, ap, F.col("direction") == "AR")


def manual_entries(rows: DataFrame) -> DataFrame:
    """rows(id, date, debit_account, credit_account, amount, activity, kind) -> two lines each."""
    entries = _entry(rows.where("amount > 0"), entry_id=F.concat_ws("-", F.col("kind"), F.col("id")), entry_date=F.col("date"), source_kind=F.col("kind"), source_id=F.col("id"), activity=F.col("activity"))
    return _explode(entries, [(F.col("debit_account"), F.col("amount"), None), (F.col("credit_account"), None, F.col("amount"))])


def reversals(lines: DataFrame) -> DataFrame:
    """The lines with their sides swapped, as entries that reverse theirs."""
    return lines.select(
        F.concat(F.lit("rev-"), F.col("entry_id")).alias("entry_id"), "entry_date", F.lit("reversal").alias("source_kind"), F.col("entry_id").alias("source_id"), "party", "activity",
        F.col("entry_id").alias("reverses_id"), "account", F.col("credit").alias("debit"), F.col("debit").alias("credit"),
    )


def trial_balance(lines: DataFrame) -> DataFrame:
    return lines.groupBy("account").agg(total(F.col("debit")).alias("debit"), total(F.col("credit")).alias("credit")).withColumn("net", (F.col("debit") - F.col("credit")).cast("decimal(38,2)"))


def entry_audit(lines: DataFrame) -> DataFrame:
    """Per entry: totals, balance, movement of cash, and whether its activity is as it has to be."""
    cash = F.when(A.is_cash(F.col("account")), F.col("debit") - F.col("credit")).otherwise(zero())
    out = lines.groupBy("entry_id").agg(
        total(F.col("debit")).alias("debit"), total(F.col("credit")).alias("credit"), total(cash).alias("cash_delta"),
        # marks and not texts: an aggregate that holds texts sorts all lines, before and after their shuffle
        F.bool_or(F.col("activity").isNotNull()).alias("active"), F.bool_or(F.col("source_kind") == "opening").alias("opening"), F.bool_and((F.col("debit") >= 0) & (F.col("credit") >= 0)).alias("no_negative"),
    )
    balanced = (F.col("debit") == F.col("credit")) & (F.col("debit") > 0) & F.col("no_negative")
    fits = F.col("opening") | ((F.col("cash_delta") != 0) == F.col("active"))
    return out.select("entry_id", "debit", "credit", "cash_delta", balanced.alias("balanced"), fits.alias("activity_ok"))


def voucher_numbers(lines: DataFrame) -> DataFrame:
    """YYYYMM-NNNN per entry, counted within its period by date and id.

    Entries are dealt by ranges of that order, so a period of any size lies over several tasks; each place in a range is
    counted on from the entries of its period in the ranges before (a row per range and period, two small numbers)."""
    order = ["period", "entry_date", "entry_id"]
    entries = lines.select("entry_id", "entry_date").distinct().withColumn("period", period(F.col("entry_date")))
    ranged = checkpointed(entries.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("at", F.monotonically_increasing_id())
    placed = ranged.withColumn("part", F.shiftright("at", 33))
    ranges = placed.groupBy("part", "period").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("period").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("part", "period", (F.col("first") - before).alias("start"))
    entries = placed.join(small(ranges), ["part", "period"])
    n = F.col("at") - F.col("start") + 1
    return entries.select("entry_id", "period", F.format_string("%s-%04d", F.regexp_replace("period", "-", ""), n).alias("voucher_no"))


def _unreversed(lines: DataFrame) -> DataFrame:
    """Lines of entries that are neither reversals nor reversed."""
    gone = lines.where("reverses_id IS NOT NULL").select(F.col("reverses_id").alias("entry_id")).distinct()
    return lines.where("reverses_id IS NULL").join(small(gone), "entry_id", "left_anti")


ACCRUED, SETTLED = ["invoice", "opening"], "settlement"


def control_sums(lines: DataFrame) -> DataFrame:
    """(source_id, side, party, gross, settled, other, balance) of the control accounts, each line dealt once, by its source.

    Entries that were reversed are told by their ids, which are few and go to the lines: these, and reversals, count for the balance alone, a reversal's
    under the entry that it takes back.  Sums are of numbers; an aggregate that holds texts would sort all lines."""
    touched = lines.withColumn("side", A.control_side(F.col("account"))).where("side IS NOT NULL")
    signed = F.when(F.col("side") == "AR", F.col("debit") - F.col("credit")).otherwise(F.col("credit") - F.col("debit"))
    gone = small(lines.where("reverses_id IS NOT NULL").select(F.col("reverses_id").alias("_entry")).distinct())
    marked = touched.join(gone, F.col("entry_id") == F.col("_entry"), "left")
    live, kind = F.col("reverses_id").isNull() & F.col("_entry").isNull(), F.col("source_kind")
    of = lambda when: total(F.when(live & when, signed))
    zero = F.lit(0).cast("decimal(38,2)")
    return marked.groupBy("source_id", "side").agg(
        F.max(F.when(live, F.col("party"))).alias("party"), of(kind.isin(ACCRUED)).alias("gross"), F.coalesce((-of(kind == SETTLED)).cast("decimal(38,2)"), zero).alias("settled"),
        F.coalesce(of(~kind.isin(*ACCRUED, SETTLED)), zero).alias("other"), total(signed).alias("balance"),
    )


def open_items(lines: DataFrame) -> DataFrame:
    """Per source with an accrual on a control account: gross, settled, open; those with something open."""
    sums = control_sums(lines).where("gross IS NOT NULL").select("source_id", "side", "party", "gross", "settled")
    return sums.withColumn("open", (F.col("gross") - F.col("settled")).cast("decimal(38,2)")).where("open > 0")


def over_settled(lines: DataFrame) -> DataFrame:
    """Settlements that take the running total of their source beyond its gross amount."""
    live = _unreversed(lines).withColumn("side", A.control_side(F.col("account"))).where("side IS NOT NULL")
    gross = live.where(F.col("source_kind").isin("invoice", "opening")).groupBy("source_id").agg(total(F.abs(F.col("debit") - F.col("credit"))).alias("gross"))
    run = Window.partitionBy("source_id").orderBy("entry_date", "entry_id").rowsBetween(Window.unboundedPreceding, 0)
    paid = live.where("source_kind = 'settlement'").withColumn("running", F.sum(F.abs(F.col("debit") - F.col("credit"))).over(run))
    return paid.join(gross, "source_id").where("running > gross").select("entry_id", "source_id", F.col("running").cast("decimal(38,2)").alias("running"), "gross")


def control_reconciliation(lines: DataFrame) -> DataFrame:
    """Per control account: its balance, the open detail, movements of other sources, and whether these agree."""
    zero = F.lit(0).cast("decimal(38,2)")
    left = (F.col("gross") - F.col("settled")).cast("decimal(38,2)")
    out = control_sums(lines).groupBy("side").agg(total(F.col("balance")).alias("balance"), F.coalesce(total(F.when(left > 0, left)), zero).alias("detail"), F.coalesce(total(F.col("other")), zero).alias("other"))
    return out.withColumn("agrees", F.col("balance") == F.col("detail") + F.col("other"))


def business_lines(lines: DataFrame) -> DataFrame:
    """Without closing entries and reversals of them."""
    closing = lines.where("source_kind = 'closing'").select(F.col("entry_id").alias("reverses_id")).distinct()
    return lines.where("source_kind <> 'closing'").join(closing, "reverses_id", "left_anti").select(LINE_COLUMNS)


def pl_balances(lines: DataFrame, chart: DataFrame) -> DataFrame:
    """(period, account, type, amount) of profit and loss, by natural sign, without nothing."""
    known = A.with_account(business_lines(lines), chart).where("type IN ('revenue', 'expense')")
    signed = F.when(F.col("type") == "revenue", F.col("credit") - F.col("debit")).otherwise(F.col("debit") - F.col("credit"))
    return known.withColumn("period", period(F.col("entry_date"))).groupBy("period", "account", "type").agg(total(signed).alias("amount")).where("amount <> 0")


def closing_entries(lines: DataFrame, chart: DataFrame) -> DataFrame:
    """Lines that close each period: revenue and expenses to the year's profit, that to retained earnings; balances of the other sign on the other side."""
    pl = pl_balances(lines, chart)
    pos, neg = F.greatest(F.col("amount"), F.lit(0)), F.greatest(-F.col("amount"), F.lit(0))
    own = pl.select("period", F.concat(F.col("type"), F.lit("-close")).alias("step"), "account", F.when(F.col("type") == "revenue", pos).otherwise(neg).alias("debit"), F.when(F.col("type") == "revenue", neg).otherwise(pos).alias("credit"))
    sums = pl.groupBy("period", "type").agg(total(F.col("amount")).alias("amount"))
    to_profit = sums.select("period", F.concat(F.col("type"), F.lit("-close")).alias("step"), F.lit(A.PROFIT).alias("account"), F.when(F.col("type") == "revenue", neg).otherwise(pos).alias("debit"), F.when(F.col("type") == "revenue", pos).otherwise(neg).alias("credit"))
    profit = pl.groupBy("period").agg(total(F.when(F.col("type") == "revenue", F.col("amount")).otherwise(-F.col("amount"))).alias("amount"))
    carry = profit.select("period", F.explode(F.array(F.struct(F.lit(A.PROFIT).alias("account"), pos.alias("debit"), neg.alias("credit")), F.struct(F.lit(A.RETAINED).alias("account"), neg.alias("debit"), pos.alias("credit")))).alias("l"))
    carry = carry.select("period", F.lit("carry").alias("step"), "l.*")
    cast = [F.col(c).cast("decimal(38,2)").alias(c) for c in ("debit", "credit")]
    return own.union(to_profit).union(carry).where("debit <> 0 OR credit <> 0").select("period", "step", "account", *cast)


