"""The chart of accounts and what follows from an account's code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: code, name, type, normal side, statement and line
CHART = [
    ("1001", "Cash on Hand", "asset", "debit", "BalanceSheet:CashAndEquivalents"),
    ("1002", "Bank", "asset", "debit", "BalanceSheet:CashAndEquivalents"),
    ("1100", "Accounts Receivable", "asset", "debit", "BalanceSheet:Receivables"),
    ("1180", "Input Tax", "asset", "debit", "BalanceSheet:OtherCurrentAssets"),
    ("1500", "Fixed Assets", "asset", "debit", "BalanceSheet:PPE"),
    ("2100", "Accounts Payable", "liability", "credit", "BalanceSheet:Payables"),
    ("2210", "Output Tax", "liability", "credit", "BalanceSheet:TaxPayable"),
    ("3000", "Share Capital", "equity", "credit", "BalanceSheet:Equity"),
    ("3200", "Retained Earnings", "equity", "credit", "BalanceSheet:RetainedEarnings"),
    ("3300", "Current-Year Profit", "equity", "credit", "BalanceSheet:RetainedEarnings"),
    ("4000", "Sales Revenue", "revenue", "credit", "IncomeStatement:Revenue"),
    ("1221", "Prepaid Income Tax", "asset", "debit", "BalanceSheet:OtherCurrentAssets"),
    ("2221", "Withholding Tax Payable", "liability", "credit", "BalanceSheet:TaxPayable"),
    ("6603", "Bank/Platform Fees", "expense", "debit", "IncomeStatement:FinanceCosts"),
    ("6604", "Cash Discount", "expense", "debit", "IncomeStatement:Opex"),
    ("6605", "Rounding Difference", "expense", "debit", "IncomeStatement:FinanceCosts"),
    ("6900", "Other Expenses", "expense", "debit", "IncomeStatement:Opex"),
    ("1012", "Other Cash Equivalents", "asset", "debit", "BalanceSheet:CashAndEquivalents"),
    ("1122", "Other Receivables", "asset", "debit", "BalanceSheet:Receivables"),
    ("1123", "Prepayments", "asset", "debit", "BalanceSheet:OtherCurrentAssets"),
    ("1405", "Inventory", "asset", "debit", "BalanceSheet:OtherCurrentAssets"),
    ("1509", "Accumulated Depreciation", "asset", "credit", "BalanceSheet:PPE"),
    ("1601", "Intangible Assets", "asset", "debit", "BalanceSheet:PPE"),
    ("1602", "Accumulated Amortization", "asset", "credit", "BalanceSheet:PPE"),
    ("2202", "Advances from Customers", "liability", "credit", "BalanceSheet:Payables"),
    ("2211", "VAT Payable", "liability", "credit", "BalanceSheet:TaxPayable"),
    ("2220", "Income Tax Payable", "liability", "credit", "BalanceSheet:TaxPayable"),
    ("2241", "Salaries Payable", "liability", "credit", "BalanceSheet:Payables"),
    ("2280", "Other Payables", "liability", "credit", "BalanceSheet:Payables"),
    ("4001", "Operating Revenue", "revenue", "credit", "IncomeStatement:Revenue"),
    ("4100", "Interest Income", "revenue", "credit", "IncomeStatement:OtherIncome"),
    ("4200", "Other Income", "revenue", "credit", "IncomeStatement:OtherIncome"),
    ("6401", "Cost of Sales", "expense", "debit", "IncomeStatement:COGS"),
    ("6601", "Salaries Expense", "expense", "debit", "IncomeStatement:Opex"),
    ("6602", "Depreciation & Amortization", "expense", "debit", "IncomeStatement:Opex"),
    ("6606", "Interest Expense", "expense", "debit", "IncomeStatement:FinanceCosts"),
    ("6607", "FX Gain/Loss", "expense", "debit", "IncomeStatement:FinanceCosts"),
    ("6610", "Rent Expense", "expense", "debit", "IncomeStatement:Opex"),
    ("6620", "Office & Admin", "expense", "debit", "IncomeStatement:Opex"),
    ("6630", "Travel Expense", "expense", "debit", "IncomeStatement:Opex"),
    ("6640", "Professional Fees", "expense", "debit", "IncomeStatement:Opex"),
    ("6650", "Marketing Expense", "expense", "debit", "IncomeStatement:Opex"),
    ("6801", "Income Tax Expense", "expense", "debit", "IncomeStatement:IncomeTax"),
]
CASH, RECEIVABLE, INPUT_TAX, PAYABLE, OUTPUT_TAX = "1002", "1100", "1180", "2100", "2210"
CAPITAL, RETAINED, PROFIT, REVENUE, FEES = "3000", "3200", "3300", "4000", "6603"
CASH_CODES = [c for c, _, _, _, line in CHART if line.endswith(":CashAndEquivalents")]


def chart(spark: SparkSession, overlay: DataFrame | None = None) -> DataFrame:
    """(code, name, type, normal, report_line); rows of an overlay replace those of the same code or come on top."""
    own = spark.createDataFrame(CHART, "code string, name string, type string, normal string, report_line string")
    if overlay is None:
        return own
    lines = [line for *_, line in CHART if line.startswith("IncomeStatement")]
    valid = overlay.select(own.columns).where(F.col("type").isin(["asset", "liability", "equity", "revenue", "expense"]) & (F.col("report_line").isin(lines) | F.col("report_line").rlike("^BalanceSheet:.")))
    return own.join(valid, "code", "left_anti").unionByName(valid)


def account_code(account: Column) -> Column:
    """The digits that an account's text begins with; null if it has none."""
    # codes of the chart are told without a search
    return F.when(account.isin([c for c, *_ in CHART]), account).otherwise(F.nullif(F.regexp_extract(account, r"^\s*(\d+)", 1), F.lit("")))


def with_account(lines: DataFrame, chart: DataFrame, account: str = "account") -> DataFrame:
    """lines with type, normal side and report line; codes outside the chart fall back on their first digit."""
    dim = F.broadcast(chart.select(F.col("code").alias("_code"), "type", "normal", "report_line"))  # a chart has some dozens of rows
    joined = lines.join(dim, account_code(F.col(account)) == F.col("_code"), "left")
    first = F.substring(account_code(F.col(account)), 1, 1)
    by_digit = lambda *pairs: F.when(first == pairs[0][0], pairs[0][1]) if len(pairs) == 1 else F.coalesce(*[F.when(first == d, v) for d, v in pairs])
    kind = by_digit(("1", "asset"), ("2", "liability"), ("3", "equity"), ("4", "revenue"), ("5", "expense"), ("6", "expense"))
    line = by_digit(("1", "BalanceSheet:OtherCurrentAssets"), ("2", "BalanceSheet:Payables"), ("3", "BalanceSheet:RetainedEarnings"), ("4", "IncomeStatement:Revenue"), ("5", "IncomeStatement:COGS"), ("6", "IncomeStatement:Opex"))
    side = F.when(first.isin("1", "5", "6"), "debit").when(first.isin("2", "3", "4"), "credit")
    return joined.withColumns({"type": F.coalesce("type", kind), "normal": F.coalesce("normal", side), "report_line": F.coalesce("report_line", line)}).drop("_code")


def is_cash(account: Column) -> Column:
    return account_code(account).isin(CASH_CODES)


def control_side(account: Column) -> Column:
    code = account_code(account)
    return F.when(code == RECEIVABLE, "AR").when(code == PAYABLE, "AP")
