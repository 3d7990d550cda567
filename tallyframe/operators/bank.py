"""Bank statements: direction and amounts from balances, headers, reconciliation of a statement, and kinds of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import total
from tallyframe.functions.text import looks_referenced

# fixed values: statuses of transactions that are not booked
PENDING = ["pending", "hold", "held", "authorized", "authorised", "auth", "processing", "in process", "provisional", "未入账", "待入账", "冻结", "挂起", "处理中", "预授权"]
# fixed values: kinds of transactions by keyword, in order; and the keywords that are certain
KINDS = [
    ("bank_fee", ["手续费", "利息", "服务费", "bank fee", "service charge", "interest", " fee ", "commission", "wire fee", "charge off"]),
    ("payroll", ["工资", "薪资", "薪酬", "社保", "公积金", "payroll", "salary", "wage", "social security", "provident fund"]),
    ("tax", ["纳税", "完税", "税款", "增值税", "个税", "withholding tax", "vat", "gst", "tax payment", "income tax"]),
    ("reimbursement", ["报销", "reimburse", "expense claim", "expense reimb"]),
    ("internal_transfer", ["内部划转", "账户划转", "备用金", "internal transfer", "book transfer", "own account", "intra-account", "sweep"]),
    ("loan", ["借款", "还款", "贷款", "本金", "loan", "repayment", "principal", "drawdown"]),
    ("prepayment", ["押金", "保证金", "预付", "定金", "deposit", "prepay", "prepayment", "retainer", "advance payment"]),
    ("refund", ["退款", "冲正", "红字", "refund", "reversal", "chargeback", "return"]),
]
CERTAIN = {
    "bank_fee": ["手续费", "利息", "bank fee", "wire fee", "interest charge", "overdraft"],
    "payroll": ["工资", "薪资", "薪酬", "社保", "公积金", "payroll", "salary", "wage", "social security", "provident fund"],
    "tax": ["纳税", "完税", "增值税", "个税", "withholding tax", "vat payment", "gst payment", "income tax", "税款缴纳"],
    "internal_transfer": ["内部划转", "账户划转", "备用金", "book transfer", "own account", "intra-account"],
    "loan": ["借款", "还款", "贷款", "本金", "loan disbursement", "loan repayment", "principal"],
    "prepayment": ["押金", "保证金", "定金", "security deposit", "retainer"],
}
NO_INVOICE = ["payroll", "tax", "internal_transfer", "loan", "prepayment", "bank_fee"]
LARGE = 50_000


def _padded(description: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), r"\s+", " "), F.lit(" "))


def _any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def kind_of(description: Column, direction: Column) -> Column:
    """struct(kind, certain): the first kind with a keyword in the description, else by direction."""
    text = _padded(description)
    chain = F.when(F.lit(False), F.lit(""))
    for kind, words in KINDS:
        chain = chain.when(_any_of(text, words), F.lit(kind))
    kind = chain.otherwise(F.when(direction == "in", "customer_receipt").otherwise("vendor_payment"))
    certain = F.when(F.lit(False), F.lit(False))
    for k, words in CERTAIN.items():
        certain = certain.when(kind == k, _any_of(text, words))
    return F.struct(kind.alias("kind"), certain.otherwise(F.lit(False)).alias("certain"))


def no_match_gate(kind: Column, certain: Column, description: Column, amount: Column) -> dict[str, Column]:
    """Whether a transaction needs no invoice without anyone looking, and what holds it back."""
    no_invoice = kind.isin(NO_INVOICE)
    reasons = F.array_compact(F.array(F.when(~certain, "weak keyword"), F.when(looks_referenced(description), "names a document"), F.when(amount >= LARGE, "large amount")))
    return {"auto_no_match": no_invoice & (F.size(reasons) == 0), "hold_why": F.when(no_invoice, F.array_join(reasons, "; ")).otherwise("")}


def _by_statement(statement: str = "stmt", index: str = "idx") -> Window:
    return Window.partitionBy(statement).orderBy(index)


def direction_from_balance(txns: DataFrame) -> DataFrame:
    """txns(stmt, idx, amount unsigned, balance, opening): income and expense, from whether the balance fell; the first row looks at the opening balance, one without an anchor is income."""
    before = F.coalesce(F.lag("balance").over(_by_statement()), F.when(F.row_number().over(_by_statement()) == 1, F.col("opening")))
    fell = F.coalesce(F.col("balance") < before, F.lit(False))
    return txns.withColumns({"income": F.when(~fell, F.col("amount")), "expense": F.when(fell, F.col("amount"))})


def amount_from_balance(txns: DataFrame) -> DataFrame:
    """txns(stmt, idx, balance, opening): income or expense as the step from the last known balance, seeded with the opening one."""
    last = F.last("balance", ignorenulls=True).over(_by_statement().rowsBetween(Window.unboundedPreceding, -1))
    delta = F.col("balance") - F.coalesce(last, F.col("opening"))
    return txns.withColumns({"income": F.when(delta > 0, delta), "expense": F.when(delta < 0, -delta)})


def booked(txns: DataFrame, status: str = "status") -> DataFrame:
    return txns.where(F.col(status).isNull() | ~F.lower(F.trim(F.col(status))).isin(PENDING))


def statement_header(txns: DataFrame) -> DataFrame:
    """txns(stmt, idx, date, balance, account, status): period, closing balance, whether accounts mix, and how many rows are not booked."""
    live = F.col("status").isNull() | ~F.lower(F.trim("status")).isin(PENDING)
    return txns.groupBy("stmt").agg(
        F.min(F.when(live, F.col("date"))).alias("period_start"), F.max(F.when(live, F.col("date"))).alias("period_end"),
        F.max_by(F.when(live, F.col("balance")), F.when(live, F.col("idx"))).alias("closing_balance"), (F.count_distinct("account") > 1).alias("multi_account"), F.count_if(~live).alias("pending_skipped"),
    )


def bank_reconciliation(txns: DataFrame, tolerance: Column) -> DataFrame:
    """txns(stmt, income, expense, opening, closing, posted, reconciled): flows, whether they lead from opening to closing, and how many rows are left."""
    sums = txns.groupBy("stmt").agg(
        F.coalesce(total(F.col("income")), F.lit(0)).cast("decimal(38,2)").alias("total_in"), F.coalesce(total(F.col("expense")), F.lit(0)).cast("decimal(38,2)").alias("total_out"),
        F.max("opening").alias("opening"), F.max("closing").alias("closing"), F.count_if("posted").alias("n_posted"), F.count_if("reconciled").alias("n_reconciled"), F.count_if(~F.col("posted") & ~F.col("reconciled")).alias("n_open"),
    )
    net = (F.col("total_in") - F.col("total_out")).cast("decimal(38,2)")
    return sums.withColumn("net", net).withColumn("ties", F.abs(F.col("opening") + F.col("net") - F.col("closing")) <= tolerance)
