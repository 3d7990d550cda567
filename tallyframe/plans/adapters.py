"""Views over the driver's tables that stand for invoices, bills, bank transactions and the like; and the same in SQL.

ORACLE_* are the views again as common table expressions for another engine, in whole cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.money import half_even, money
from tallyframe.operators import ledger


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c: str) -> Column:
    return F.col(c).cast("string")


CURRENCIES = ["USD", "EUR", "GBP", "JPY", "KWD"]


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    total = money("o_totalprice")
    tax = half_even(total * F.lit("0.05").cast("decimal(3,2)")).cast("decimal(18,2)")
    return joined.select(
        "o_orderkey", F.concat(F.lit("inv-"), text("o_orderkey")).alias("hash"), F.concat(F.lit("INV-"), F.lpad(text("o_orderkey"), 8, "0")).alias("invoice_no"),
        F.col("c_name").alias("party"), F.lit("AR").alias("direction"), F.lit("4000").alias("account"), total.alias("total"), (total - tax).cast("decimal(18,2)").alias("subtotal"), tax.alias("tax"),
        F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", "Approved").when(F.col("o_orderstatus") == "O", "Pending").otherwise("Hold").alias("status"),
        F.element_at(F.array(*map(F.lit, CURRENCIES)), (F.col("c_nationkey") % 5 + 1).cast("int")).alias("currency"),
    )


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    joined = items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"])
    net = half_even(money("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,2)")
    tax = half_even(F.col("subtotal") * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,2)")
    account = F.when(F.col("l_returnflag") == "A", "6401").when(F.col("l_returnflag") == "N", "6620").otherwise("6640")
    # each amount is computed once, also where a filter stands on the total
    out = joined.withColumn("subtotal", F.explode(F.array(net))).withColumn("tax", F.explode(F.array(tax)))
    return out.select(
        "l_orderkey", "l_linenumber", "l_linestatus", F.concat_ws("-", F.lit("bill"), text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("hash"), F.col("s_name").alias("party"), F.lit("AP").alias("direction"),
        account.alias("account"), (F.col("subtotal") + F.col("tax")).cast("decimal(18,2)").alias("total"), "subtotal", "tax", F.to_date("l_shipdate").alias("date"),
    )


def paid_invoices(invoices: DataFrame) -> DataFrame:
    """By order key modulo 4: in full, with a fee of 1.00, half, not."""
    k = F.col("o_orderkey") % 4
    settle = F.when(k == 3, F.lit(0)).when(k == 2, half_even(F.col("total") / F.lit(2).cast("decimal(1,0)"))).otherwise(F.col("total"))
    return invoices.where("status = 'Approved'").select("hash", F.date_add("date", 30).alias("date"), "party", "direction", settle.cast("decimal(18,2)").alias("settle"), F.when(k == 1, 1).otherwise(0).cast("decimal(18,2)").alias("diff"), F.lit("6603").alias("diff_account"), F.col("account").alias("nature"))


def paid_bills(bills: DataFrame) -> DataFrame:
    due = (F.col("l_linestatus") == "F") & ((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0)
    return bills.where(due).select("hash", F.date_add("date", 14).alias("date"), "party", "direction", F.col("total").alias("settle"), F.lit(0).cast("decimal(18,2)").alias("diff"), F.lit("6603").alias("diff_account"), F.col("account").alias("nature"))


def other_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening capital, and per nation a machine bought, written down and a loan's interest paid."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", text("n_nationkey").alias("id"))
    k = F.col("n_nationkey") + 1
    one = lambda kind, debit, credit, amount, activity, day: F.struct(F.lit(kind).alias("kind"), F.lit(day).cast("date").alias("date"), F.lit(debit).alias("debit_account"), F.lit(credit).alias("credit_account"), amount.cast("decimal(18,2)").alias("amount"), F.lit(activity).cast("string").alias("activity"))
    rows = F.array(
        one("opening", "1002", "3000", k * 100000, None, "1995-01-01"), one("machine", "1500", "1002", k * 10000, "investing", "1996-03-31"),
        one("writedown", "6602", "1509", k * 1000, None, "1997-12-31"), one("interest", "6606", "1002", k * 10, "financing", "1998-06-30"),
    )
    return nation.select("id", F.explode(rows).alias("r")).select("id", "r.*")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines: approved invoices, all bills, their settlements, the other entries, and a few accruals reversed."""
    inv, bill = invoices(spark, sf_dir), bills(spark, sf_dir)
    accrued = ledger.accruals(inv.where("status = 'Approved'").select("hash", "date", "party", "direction", "account", "total", "subtotal", "tax"))
    owed = ledger.accruals(bill.select("hash", "date", "party", "direction", "account", "total", "subtotal", "tax"))
    paid = ledger.settlements(paid_invoices(inv).unionByName(paid_bills(bill)))
    wrong = ledger.accruals(inv.where("status = 'Approved' AND o_orderkey % 52 = 3").select("hash", "date", "party", "direction", "account", "total", "subtotal", "tax"))
    parts = [accrued, owed, paid, ledger.manual_entries(other_entries(spark, sf_dir)), ledger.reversals(wrong)]
    out = parts[0].select(ledger.LINE_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(ledger.LINE_COLUMNS))
    return out


RATES = [
    ("EUR", "1995-01-01", "1.100000"), ("EUR", "1996-06-15", "1.150000"), ("EUR", "1998-06-30", "1.200000"), ("EUR", "2000-01-10", "1.035000"),
    ("GBP", "1995-03-01", "1.560000"), ("GBP", "1997-07-01", "1.640000"), ("GBP", "1999-12-31", "1.615000"),
    ("JPY", "1995-01-02", "0.009950"), ("JPY", "1998-08-11", "0.006780"), ("JPY", "2000-05-01", "0.009260"),
]


def fx_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "currency string, d string, r string").select("currency", F.col("d").cast("date").alias("rate_date"), F.col("r").cast("decimal(18,12)").alias("rate"))


def he(n: str, d: int | str) -> str:
    """SQL: n / d for whole n >= 0, rounded half to even."""
    return f"(({n}) // {d} + CASE WHEN 2 * (({n}) % {d}) > {d} OR (2 * (({n}) % {d}) = {d} AND (({n}) // {d}) % 2 = 1) THEN 1 ELSE 0 END)"


def dec(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(38,2))"


ORACLE_INVOICES = f"""
inv0 AS (SELECT o_orderkey, 'inv-' || o_orderkey AS hash, 'INV-' || lpad(o_orderkey::VARCHAR, 8, '0') AS invoice_no, c_name AS party,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS total, o_orderdate::DATE AS d,
  CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Pending' ELSE 'Hold' END AS status,
  ['USD', 'EUR', 'GBP', 'JPY', 'KWD'][c_nationkey % 5 + 1] AS currency
  FROM orders JOIN customer ON o_custkey = c_custkey),
inv AS (SELECT *, {he("total * 5", 100)} AS tax FROM inv0)"""

ORACLE_JOURNAL = f"""{ORACLE_INVOICES},
bill0 AS (SELECT l_orderkey, l_linenumber, l_linestatus, 'bill-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS hash, s_name AS party,
  CASE l_returnflag WHEN 'A' THEN '6401' WHEN 'N' THEN '6620' ELSE '6640' END AS account, l_shipdate::DATE AS d,
  {he("CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) * (100 - CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS BIGINT))", 100)} AS net,
  CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS BIGINT) AS pct FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
bill AS (SELECT *, {he("net * pct", 100)} AS tax FROM bill0),
jl0 AS (
  SELECT 'acc-' || hash AS entry_id, d, 'invoice' AS kind, hash AS source_id, party, NULL AS activity, NULL AS rev,
         unnest(['1100', '4000', '2210']) AS account, unnest([total, 0, 0]) AS dr, unnest([0, total - tax, tax]) AS cr FROM inv WHERE status = 'Approved' AND total > 0
  UNION ALL
  SELECT 'acc-' || hash, d, 'invoice', hash, party, NULL, NULL, unnest([account, '1180', '2100']), unnest([net, tax, 0]), unnest([0, 0, net + tax]) FROM bill WHERE net + tax > 0
  UNION ALL
  SELECT 'set-' || hash, d + 30, 'settlement', hash, party, 'operating', NULL, unnest(['1002', '6603', '1100']), unnest([s - f, f, 0]), unnest([0, 0, s])
  FROM (SELECT *, CASE o_orderkey % 4 WHEN 3 THEN 0 WHEN 2 THEN {he("total", 2)} ELSE total END AS s, CASE o_orderkey % 4 WHEN 1 THEN 100 ELSE 0 END AS f FROM inv WHERE status = 'Approved') WHERE s > 0
  UNION ALL
  SELECT 'set-' || hash, d + 14, 'settlement', hash, party, 'operating', NULL, unnest(['2100', '1002']), unnest([net + tax, 0]), unnest([0, net + tax])
  FROM bill WHERE l_linestatus = 'F' AND (l_orderkey + l_linenumber) % 3 = 0 AND net + tax > 0
  UNION ALL
  SELECT k || '-' || n_nationkey, day, k, n_nationkey::VARCHAR, NULL, act, NULL, unnest([a, b]), unnest([(n_nationkey + 1) * amount, 0]), unnest([0, (n_nationkey + 1) * amount])
  FROM nation, (VALUES ('opening', DATE '1995-01-01', NULL, '1002', '3000', 10000000), ('machine', DATE '1996-03-31', 'investing', '1500', '1002', 1000000),
    ('writedown', DATE '1997-12-31', NULL, '6602', '1509', 100000), ('interest', DATE '1998-06-30', 'financing', '6606', '1002', 1000)) v(k, day, act, a, b, amount)
  UNION ALL
  SELECT 'rev-acc-' || hash, d, 'reversal', 'acc-' || hash, party, NULL, 'acc-' || hash, unnest(['1100', '4000', '2210']), unnest([0, total - tax, tax]), unnest([total, 0, 0])
  FROM inv WHERE status = 'Approved' AND total > 0 AND o_orderkey % 52 = 3),
jl AS (SELECT * FROM jl0 WHERE dr <> 0 OR cr <> 0)"""
