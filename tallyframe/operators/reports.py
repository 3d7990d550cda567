"""Income statement, balance sheet, cash flow by both methods, and the checks that tie them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.money import REPORT, total
from tallyframe.operators import accounts as A
from tallyframe.session import checkpointed



def zero() -> Column:
    return F.lit(0).cast(REPORT)


# fixed values: rows of the statements, in their order
INCOME = ["Revenue", "COGS", "GrossProfit", "Opex", "FinanceCosts", "OtherIncome", "IncomeTax", "NetIncome"]
BALANCE = [("assets", "CashAndEquivalents"), ("assets", "Receivables"), ("assets", "OtherCurrentAssets"), ("assets", "PPE"), ("liabilities", "Payables"), ("liabilities", "TaxPayable"), ("equity", "Equity"), ("equity", "ShareCapital"), ("equity", "RetainedEarnings")]


def summary(lines: DataFrame) -> DataFrame:
    """debit and credit by account, source kind, activity, and whether they close a period or take that back.

    Every statement needs these few rows alone, so the journal is read and added up once."""
    closings = lines.where("source_kind = 'closing'").select(F.col("entry_id").alias("reverses_id"), F.lit(True).alias("_c")).distinct()
    back = lines.where("reverses_id IS NOT NULL").join(closings, "reverses_id", "left").withColumn("of_closing", F.coalesce("_c", F.lit(False)) | (F.col("source_kind") == "closing"))
    rest = lines.where("reverses_id IS NULL").withColumn("of_closing", F.col("source_kind") == "closing")
    keep = ["account", "source_kind", "activity", "of_closing"]
    both = rest.select(*keep, "debit", "credit").union(back.select(*keep, "debit", "credit"))
    return both.groupBy(*keep).agg(total(F.col("debit")).alias("debit"), total(F.col("credit")).alias("credit"))


def _business(sums: DataFrame) -> DataFrame:
    return sums.where(~F.col("of_closing"))


def by_report_line(lines: DataFrame, chart: DataFrame) -> DataFrame:
    """(report_line, amount) by natural sign; a null line holds accounts that belong nowhere."""
    known = A.with_account(lines.groupBy("account").agg(total(F.col("debit") - F.col("credit")).alias("net")).where("net <> 0"), chart)
    natural = F.when(F.col("type").isin("liability", "equity", "revenue"), -F.col("net")).otherwise(F.col("net"))
    return known.groupBy("report_line").agg(total(natural).alias("amount"))


def _of(*tokens: str) -> Column:
    return F.coalesce(total(F.when(F.col("report_line").isin(*tokens), F.col("amount"))), zero())


def _income_row(by_line: DataFrame) -> DataFrame:
    row = by_line.agg(*[_of(f"IncomeStatement:{k}").alias(k) for k in INCOME if k not in ("GrossProfit", "NetIncome")])
    row = row.withColumn("GrossProfit", (F.col("Revenue") - F.col("COGS")).cast(REPORT))
    return row.withColumn("NetIncome", (F.col("GrossProfit") + F.col("OtherIncome") - F.col("Opex") - F.col("FinanceCosts") - F.col("IncomeTax")).cast(REPORT))


def _unpivot(row: DataFrame, names: list[str], label: str = "line") -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias(label), F.col(k).alias("amount")) for i, k in enumerate(names)])).alias("x")).select("x.*")


def income_statement(lines: DataFrame, chart: DataFrame) -> DataFrame:
    """(ord, line, amount) over all periods, without closing entries and their reversals."""
    return _unpivot(_income_row(by_report_line(_business(summary(lines)), chart)), INCOME)


def balance_sheet(lines: DataFrame, chart: DataFrame) -> DataFrame:
    """(section, line, amount): lines of nothing are hidden, but for retained earnings; what is not yet closed stands in equity; totals per section."""
    return _sheet(summary(lines), chart)


def _sheet(sums: DataFrame, chart: DataFrame) -> DataFrame:
    by_line = by_report_line(sums, chart)
    columns = [_of(f"BalanceSheet:{k}").alias(k) for _, k in BALANCE]
    row = by_line.agg(*columns).crossJoin(_income_row(by_line).select(F.col("NetIncome").alias("CurrentNetIncome")))  # one row each
    listed = [*BALANCE, ("equity", "CurrentNetIncome")]
    items = row.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("line"), F.col(k).alias("amount")) for s, k in listed])).alias("x")).select("x.*")
    items = items.where(F.col("line").isin("RetainedEarnings", "CurrentNetIncome") | (F.col("amount") != 0))
    return items.unionByName(items.groupBy("section").agg(total(F.col("amount")).alias("amount")).withColumn("line", F.lit("Total")))


def _cash_row(lines: DataFrame) -> DataFrame:
    cash = F.when(A.is_cash(F.col("account")), F.col("debit") - F.col("credit")).otherwise(F.lit(0))
    of = lambda when: F.coalesce(total(F.when(when, cash)), zero())
    row = lines.agg(*[of(F.col("activity") == k).alias(k) for k in ("operating", "investing", "financing")], of(F.col("source_kind") == "opening").alias("opening"), F.coalesce(total(cash), zero()).alias("bs_cash"))
    row = row.withColumn("net_change", (F.col("operating") + F.col("investing") + F.col("financing")).cast(REPORT))
    return row.withColumn("ending", (F.col("opening") + F.col("net_change")).cast(REPORT))


CASH_ROWS = ["operating", "investing", "financing", "net_change", "opening", "ending", "bs_cash"]


def cash_flow_direct(lines: DataFrame) -> DataFrame:
    return _unpivot(_cash_row(summary(lines)), CASH_ROWS)


def _indirect_row(lines: DataFrame, chart: DataFrame) -> DataFrame:
    net_income = _income_row(by_report_line(_business(lines), chart)).select("NetIncome")
    known = A.with_account(lines, chart)
    delta, line = F.col("debit") - F.col("credit"), F.col("report_line")
    moved = F.col("source_kind") != "opening"
    of = lambda when, value: F.coalesce(total(F.when(when, value)), zero())
    aside = F.col("activity").isin("investing", "financing") & F.col("type").isin("revenue", "expense")
    row = known.agg(
        of(moved & line.isin("BalanceSheet:Receivables", "BalanceSheet:OtherCurrentAssets"), delta).alias("op_assets"),
        of(moved & line.isin("BalanceSheet:Payables", "BalanceSheet:TaxPayable"), delta).alias("op_liab"),
        of(moved & (line == "BalanceSheet:PPE") & (F.col("normal") == "credit"), F.col("credit")).alias("depreciation"),
        of(aside, -delta).alias("non_operating"),
    ).crossJoin(net_income)  # one row each
    operating = F.col("NetIncome") - F.col("non_operating") + F.col("depreciation") - F.col("op_assets") - F.col("op_liab")
    return row.withColumn("operating", operating.cast(REPORT))


INDIRECT_ROWS = ["NetIncome", "non_operating", "depreciation", "op_assets", "op_liab", "operating"]


def cash_flow_indirect(lines: DataFrame, chart: DataFrame) -> DataFrame:
    return _unpivot(_indirect_row(summary(lines), chart), INDIRECT_ROWS)


def tie_out_checks(lines: DataFrame, chart: DataFrame) -> DataFrame:
    """One row: E1 assets = liabilities + equity, E2 business net income = unclosed + closed, E3 cash, E4 direct = indirect, E6 all accounts classified, and whether statements can be issued."""
    sums = checkpointed(summary(lines))  # a few rows, which five reports read
    sheet = _sheet(sums, chart).where("line = 'Total'").agg(*[F.coalesce(total(F.when(F.col("section") == s, F.col("amount"))), zero()).alias(s) for s in ("assets", "liabilities", "equity")])
    by_line = by_report_line(sums, chart)
    unclosed = _income_row(by_line).select(F.col("NetIncome").alias("unclosed"))
    loose = by_line.agg(F.count_if(F.col("report_line").isNull()).alias("loose"))
    closed = sums.where(F.col("of_closing") & (F.col("account") == A.RETAINED)).agg(F.coalesce(total(F.col("credit") - F.col("debit")), zero()).alias("closed"))
    cash = _cash_row(sums).select(F.col("ending"), F.col("bs_cash"), F.col("operating").alias("direct"))
    row = sheet.crossJoin(unclosed).crossJoin(loose).crossJoin(closed).crossJoin(cash).crossJoin(_indirect_row(sums, chart).select("NetIncome", "operating"))  # one row each
    checks = {
        "e1": F.col("assets") == F.col("liabilities") + F.col("equity"),
        "e2": F.col("NetIncome") == F.col("unclosed") + F.col("closed"),
        "e3": F.col("ending") == F.col("bs_cash"),
        "e4": F.col("direct") == F.col("operating"),
        "e6": F.col("loose") == 0,
    }
    out = row.select(*[c.alias(k) for k, c in checks.items()], "assets", "liabilities", "equity", F.col("NetIncome").alias("net_income"))
    return out.withColumn("can_issue", F.col("e1") & F.col("e2") & F.col("e3") & F.col("e4") & F.col("e6"))
