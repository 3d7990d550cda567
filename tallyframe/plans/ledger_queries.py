"""Ledger, report and currency queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.money import total
from tallyframe.operators import accounts, fx, ledger, reports
from tallyframe.plans.adapters import ORACLE_INVOICES, ORACLE_JOURNAL, RATES, dec, fx_rates, he, invoices, journal

J = f"WITH {ORACLE_JOURNAL}"
CHART = "chart(code, name, type, normal, line) AS (VALUES " + ", ".join("('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in accounts.CHART) + ")"
JC = f"{J}, {CHART}, net AS (SELECT account, sum(dr) - sum(cr) AS net FROM jl GROUP BY 1), by_line AS (SELECT line, sum(CASE WHEN type IN ('liability', 'equity', 'revenue') THEN -net ELSE net END) AS amount FROM net LEFT JOIN chart ON code = account WHERE net <> 0 GROUP BY 1)"
_LINE = lambda k: f"coalesce((SELECT amount FROM by_line WHERE line = 'IncomeStatement:{k}'), 0)"
_NET = f"{_LINE('Revenue')} + {_LINE('OtherIncome')} - {_LINE('COGS')} - {_LINE('Opex')} - {_LINE('FinanceCosts')} - {_LINE('IncomeTax')}"
_CASH = "account IN ('1001', '1002', '1012')"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"{J} SELECT entry_id, account, {dec('dr')} AS debit, {dec('cr')} AS credit, strftime(d, '%Y-%m') AS period FROM jl WHERE kind = 'invoice'")
def accrual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = journal(spark, sf_dir).where("source_kind = 'invoice'")
    return lines.select("entry_id", "account", F.col("debit").cast("decimal(38,2)").alias("debit"), F.col("credit").cast("decimal(38,2)").alias("credit"), ledger.period(F.col("entry_date")).alias("period"))


@query(f"{J} SELECT account, {dec('sum(dr)')} AS debit, {dec('sum(cr)')} AS credit, {dec('sum(dr) - sum(cr)')} AS net FROM jl GROUP BY account")
def trial_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.trial_balance(journal(spark, sf_dir))


@query(f"""{J}, e AS (SELECT entry_id, sum(dr) AS dr, sum(cr) AS cr, sum(CASE WHEN {_CASH} THEN dr - cr ELSE 0 END) AS cash, any_value(activity) AS act, any_value(kind) AS kind, min(least(dr, cr)) AS low FROM jl GROUP BY 1)
SELECT entry_id, {dec('dr')} AS debit, {dec('cr')} AS credit, {dec('cash')} AS cash_delta, dr = cr AND dr > 0 AND low >= 0 AS balanced, kind = 'opening' OR ((cash <> 0) = (act IS NOT NULL)) AS activity_ok FROM e""")
def entry_balance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.entry_audit(journal(spark, sf_dir))


@query(f"""{JC}, r AS (SELECT {_LINE('Revenue')} AS a, {_LINE('COGS')} AS b, {_LINE('Opex')} AS c, {_LINE('FinanceCosts')} AS d, {_LINE('OtherIncome')} AS e, {_LINE('IncomeTax')} AS f)
SELECT unnest(range(8))::INT AS ord, unnest(['Revenue', 'COGS', 'GrossProfit', 'Opex', 'FinanceCosts', 'OtherIncome', 'IncomeTax', 'NetIncome']) AS line,
  unnest([{dec('a')}, {dec('b')}, {dec('a - b')}, {dec('c')}, {dec('d')}, {dec('e')}, {dec('f')}, {dec('a + e - b - c - d - f')}]) AS amount FROM r""")
def income_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.income_statement(journal(spark, sf_dir), accounts.chart(spark))


_SHEET = f"""{JC}, s(section, name) AS (VALUES {', '.join(f"('{s}', '{k}')" for s, k in reports.BALANCE)}),
i AS (SELECT section, name AS line, coalesce(amount, 0) AS v FROM s LEFT JOIN by_line ON by_line.line = 'BalanceSheet:' || name
      UNION ALL SELECT 'equity', 'CurrentNetIncome', {_NET}),
j AS (SELECT * FROM i WHERE v <> 0 OR line IN ('RetainedEarnings', 'CurrentNetIncome')),
k AS (SELECT * FROM j UNION ALL SELECT section, 'Total', sum(v) FROM j GROUP BY 1)"""


@query(f"{_SHEET} SELECT section, line, {dec('v')} AS amount FROM k")
def balance_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.balance_sheet(journal(spark, sf_dir), accounts.chart(spark))


_FLOW = f"""c AS (SELECT coalesce(sum(x) FILTER (activity = 'operating'), 0) AS o, coalesce(sum(x) FILTER (activity = 'investing'), 0) AS i, coalesce(sum(x) FILTER (activity = 'financing'), 0) AS f,
  coalesce(sum(x) FILTER (kind = 'opening'), 0) AS op, coalesce(sum(x), 0) AS bs FROM (SELECT *, dr - cr AS x FROM jl WHERE {_CASH}))"""


@query(f"""{J}, {_FLOW} SELECT unnest(range(7))::INT AS ord, unnest(['operating', 'investing', 'financing', 'net_change', 'opening', 'ending', 'bs_cash']) AS line,
  unnest([{dec('o')}, {dec('i')}, {dec('f')}, {dec('o + i + f')}, {dec('op')}, {dec('op + o + i + f')}, {dec('bs')}]) AS amount FROM c""")
def cash_flow_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cash_flow_direct(journal(spark, sf_dir))


_INDIRECT = f"""k AS (SELECT jl.*, type, normal, line FROM jl LEFT JOIN chart ON code = account),
m AS (SELECT {_NET} AS ni,
  (SELECT coalesce(sum(dr - cr), 0) FROM k WHERE kind <> 'opening' AND line IN ('BalanceSheet:Receivables', 'BalanceSheet:OtherCurrentAssets')) AS oa,
  (SELECT coalesce(sum(dr - cr), 0) FROM k WHERE kind <> 'opening' AND line IN ('BalanceSheet:Payables', 'BalanceSheet:TaxPayable')) AS ol,
  (SELECT coalesce(sum(cr), 0) FROM k WHERE kind <> 'opening' AND line = 'BalanceSheet:PPE' AND normal = 'credit') AS dep,
  (SELECT coalesce(sum(cr - dr), 0) FROM k WHERE activity IN ('investing', 'financing') AND type IN ('revenue', 'expense')) AS non)"""


@query(f"""{JC}, {_INDIRECT} SELECT unnest(range(6))::INT AS ord, unnest(['NetIncome', 'non_operating', 'depreciation', 'op_assets', 'op_liab', 'operating']) AS line,
  unnest([{dec('ni')}, {dec('non')}, {dec('dep')}, {dec('oa')}, {dec('ol')}, {dec('ni - non + dep - oa - ol')}]) AS amount FROM m""")
def cash_flow_indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cash_flow_indirect(journal(spark, sf_dir), accounts.chart(spark))


@query(f"""{_SHEET}, {_FLOW}, {_INDIRECT.replace('k AS (', 'kk AS (').replace('FROM k ', 'FROM kk ')},
t AS (SELECT sum(v) FILTER (section = 'assets') AS a, sum(v) FILTER (section = 'liabilities') AS l, sum(v) FILTER (section = 'equity') AS q FROM k WHERE line = 'Total'),
x AS (SELECT a = l + q AS e1, true AS e2, op + o + i + f = bs AS e3, o = ni - non + dep - oa - ol AS e4, NOT EXISTS (SELECT 1 FROM by_line WHERE line IS NULL) AS e6, a, l, q, ni FROM t, c, m)
SELECT e1, e2, e3, e4, e6, {dec('a')} AS assets, {dec('l')} AS liabilities, {dec('q')} AS equity, {dec('ni')} AS net_income, e1 AND e2 AND e3 AND e4 AND e6 AS can_issue FROM x""")
def tie_out_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tie_out_checks(journal(spark, sf_dir), accounts.chart(spark))


@query(f"""{J}, e AS (SELECT DISTINCT entry_id, d, strftime(d, '%Y-%m') AS period FROM jl)
SELECT entry_id, period, replace(period, '-', '') || '-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS voucher_no
FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY d, entry_id) AS n FROM e)""")
def voucher_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.voucher_numbers(journal(spark, sf_dir))


@query(f"{J} SELECT entry_id, account, {dec('dr')} AS debit, {dec('cr')} AS credit, activity FROM jl WHERE kind = 'settlement'")
def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = journal(spark, sf_dir).where("source_kind = 'settlement'")
    return lines.select("entry_id", "account", F.col("debit").cast("decimal(38,2)").alias("debit"), F.col("credit").cast("decimal(38,2)").alias("credit"), "activity")


_OPEN = """live AS (SELECT * FROM jl WHERE rev IS NULL AND entry_id NOT IN (SELECT rev FROM jl WHERE rev IS NOT NULL)),
side AS (SELECT *, CASE account WHEN '1100' THEN 'AR' ELSE 'AP' END AS side, CASE account WHEN '1100' THEN dr - cr ELSE cr - dr END AS x FROM live WHERE account IN ('1100', '2100')),
o AS (SELECT source_id, side, max(party) AS party, sum(x) FILTER (kind IN ('invoice', 'opening')) AS gross, coalesce(sum(-x) FILTER (kind = 'settlement'), 0) AS settled FROM side GROUP BY 1, 2),
op AS (SELECT *, gross - settled AS open FROM o WHERE gross - settled > 0)"""


@query(f"{J}, {_OPEN} SELECT source_id, side, party, {dec('gross')} AS gross, {dec('settled')} AS settled, {dec('open')} AS open FROM op")
def open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.open_items(journal(spark, sf_dir))


@query(f"""{J}, {_OPEN}, b AS (SELECT CASE account WHEN '1100' THEN 'AR' ELSE 'AP' END AS side, sum(CASE account WHEN '1100' THEN dr - cr ELSE cr - dr END) AS balance FROM jl WHERE account IN ('1100', '2100') GROUP BY 1),
d AS (SELECT side, sum(open) AS detail FROM op GROUP BY 1), z AS (SELECT side, sum(x) AS other FROM side WHERE kind NOT IN ('invoice', 'opening', 'settlement') GROUP BY 1),
r AS (SELECT side, balance, coalesce(detail, 0) AS detail, coalesce(other, 0) AS other FROM b LEFT JOIN d USING (side) LEFT JOIN z USING (side))
SELECT side, {dec('balance')} AS balance, {dec('detail')} AS detail, {dec('other')} AS other, balance = detail + other AS agrees FROM r""")
def control_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.control_reconciliation(journal(spark, sf_dir))


@query(f"""{J}, {_OPEN}, g AS (SELECT source_id, sum(abs(x)) AS gross FROM side WHERE kind = 'invoice' GROUP BY 1),
p AS (SELECT entry_id, source_id, sum(abs(x)) OVER (PARTITION BY source_id ORDER BY d, entry_id ROWS UNBOUNDED PRECEDING) AS running FROM side WHERE kind = 'settlement')
SELECT entry_id, source_id, {dec('running')} AS running, {dec('gross')} AS gross FROM p JOIN g USING (source_id) WHERE running > gross""")
def over_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.over_settled(journal(spark, sf_dir))


_PL = f"""pl AS (SELECT strftime(d, '%Y-%m') AS period, account, type, sum(CASE type WHEN 'revenue' THEN cr - dr ELSE dr - cr END) AS v FROM jl JOIN chart ON code = account WHERE type IN ('revenue', 'expense') GROUP BY 1, 2, 3 HAVING v <> 0)"""


@query(f"{J}, {CHART}, {_PL} SELECT period, account, type, {dec('v')} AS amount FROM pl")
def profit_and_loss_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.pl_balances(journal(spark, sf_dir), accounts.chart(spark))


@query(f"""{J}, {CHART}, {_PL}, a AS (
  SELECT period, type || '-close' AS step, account, CASE type WHEN 'revenue' THEN v ELSE -v END AS x FROM pl
  UNION ALL SELECT period, type || '-close', '3300', CASE type WHEN 'revenue' THEN -sum(v) ELSE sum(v) END FROM pl GROUP BY period, type
  UNION ALL SELECT period, 'carry', unnest(['3300', '3200']), unnest([p, -p]) FROM (SELECT period, sum(CASE type WHEN 'revenue' THEN v ELSE -v END) AS p FROM pl GROUP BY 1))
SELECT period, step, account, {dec('greatest(x, 0)')} AS debit, {dec('greatest(-x, 0)')} AS credit FROM a WHERE x <> 0""")
def closing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.closing_entries(journal(spark, sf_dir), accounts.chart(spark))


@query(f"""{J} SELECT source_id AS reversed_id, account, {dec('sum(dr - cr)')} AS net FROM (
  SELECT source_id, account, dr, cr FROM jl WHERE kind = 'reversal' UNION ALL SELECT entry_id, account, dr, cr FROM jl WHERE entry_id IN (SELECT rev FROM jl WHERE rev IS NOT NULL)) GROUP BY 1, 2""")
def reversal_net_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = journal(spark, sf_dir)
    back = lines.where("reverses_id IS NOT NULL")
    first = lines.join(back.select(F.col("reverses_id").alias("entry_id")).distinct(), "entry_id", "left_semi")
    both = back.select(F.col("reverses_id").alias("reversed_id"), "account", "debit", "credit").union(first.select("entry_id", "account", "debit", "credit"))
    return both.groupBy("reversed_id", "account").agg(total(F.col("debit") - F.col("credit")).alias("net"))


@query(f"""{J}, e AS (SELECT entry_id, sum(dr - cr) FILTER ({_CASH}) AS x, any_value(activity) AS act, any_value(kind) AS kind FROM jl GROUP BY 1) SELECT entry_id, {dec('x')} AS cash_delta FROM e WHERE x <> 0 AND act IS NULL""")
def unmarked_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.entry_audit(journal(spark, sf_dir)).join(journal(spark, sf_dir).where("activity IS NULL").select("entry_id").distinct(), "entry_id", "left_semi").where("cash_delta <> 0").select("entry_id", "cash_delta")


@query(f"""{J}, {_OPEN}, e AS (SELECT entry_id, sum(dr) AS dr, sum(cr) AS cr FROM jl GROUP BY 1)
SELECT (SELECT count(DISTINCT entry_id) FROM jl) AS n_entries, (SELECT count(DISTINCT rev) FROM jl) AS n_reversed, (SELECT count(*) FROM op) AS n_open,
  (SELECT bool_and(dr = cr) FROM e) AS balanced, {dec("(SELECT sum(dr) FROM jl)")} AS turnover""")
def ledger_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = journal(spark, sf_dir)
    audit = ledger.entry_audit(lines).agg(F.count("*").alias("n_entries"), F.bool_and(F.col("debit") == F.col("credit")).alias("balanced"), total(F.col("debit")).alias("turnover"))
    rest = lines.agg(F.count_distinct("reverses_id").alias("n_reversed")).crossJoin(ledger.open_items(lines).agg(F.count("*").alias("n_open")))  # one row each
    return audit.crossJoin(rest).select("n_entries", "n_reversed", "n_open", "balanced", "turnover")


_RATES = "rates(currency, rd, r) AS (VALUES " + ", ".join(f"('{c}', DATE '{d}', {int(float(r) * 10**6 + 0.5)})" for c, d, r in RATES) + ")"
_ASOF = f"""{_RATES}, b AS (SELECT inv.*, CASE WHEN inv.currency = 'USD' THEN 1000000 ELSE r END AS r6, CASE WHEN inv.currency = 'USD' THEN d ELSE rd END AS rdate
  FROM inv ASOF LEFT JOIN rates ON inv.currency = rates.currency AND inv.d >= rates.rd)"""


@query(f"WITH {ORACLE_INVOICES}, {_ASOF} SELECT hash, currency, d AS date, CAST(r6 / 1000000.0 AS DECIMAL(18,6)) AS rate, rdate AS rate_date, coalesce(abs(date_diff('day', rdate, d)), -1)::INT AS stale_days FROM b")
def fx_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = fx.rate_as_of(invoices(spark, sf_dir), fx_rates(spark))
    return rated.select("hash", "currency", "date", F.col("rate").cast("decimal(18,6)").alias("rate"), "rate_date", F.coalesce(fx.stale_days(F.col("date"), F.col("rate_date")), F.lit(-1)).alias("stale_days"))


@query(f"WITH {ORACLE_INVOICES}, {_ASOF} SELECT hash, {dec(he('total * r6', 1000000))} AS functional, r6 IS NULL AS missing_rate FROM b")
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = fx.rate_as_of(invoices(spark, sf_dir), fx_rates(spark))
    return rated.select("hash", fx.to_functional(F.col("total"), F.col("rate")).alias("functional"), F.col("rate").isNull().alias("missing_rate"))


@query(f"""WITH {ORACLE_INVOICES}, {_ASOF}, p AS (SELECT *, {he('total * r6', 1000000)} AS gross FROM b WHERE status = 'Approved' AND currency <> 'USD' AND r6 IS NOT NULL),
q AS (SELECT *, gross - CASE o_orderkey % 4 WHEN 2 THEN {he('gross', 2)} ELSE 0 END AS open FROM p WHERE o_orderkey % 4 IN (2, 3)),
v AS (SELECT *, {he('total * open', 'gross')} AS oc, (SELECT r FROM rates WHERE rates.currency = q.currency AND rd <= DATE '2001-12-31' ORDER BY rd DESC LIMIT 1) AS r_end FROM q WHERE open > 0 AND gross > 0),
w AS (SELECT *, {he('oc * r_end', 1000000)} AS reval FROM v)
SELECT currency, count(*) AS n_items, {dec('sum(oc)')} AS open_ccy, {dec('sum(open)')} AS book, {dec('sum(reval)')} AS reval, {dec('sum(reval - open)')} AS unrealised, bool_or(r_end IS NULL) AS missing_rate FROM w GROUP BY 1""")
def fx_revaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = fx.rate_as_of(invoices(spark, sf_dir).where("status = 'Approved' AND currency <> 'USD' AND o_orderkey % 4 IN (2, 3)"), fx_rates(spark))
    booked = rated.where("rate IS NOT NULL").withColumn("gross", fx.to_functional(F.col("total"), F.col("rate")))
    half = F.when(F.col("o_orderkey") % 4 == 2, F.bround(F.col("gross") / F.lit(2).cast("decimal(1,0)"), 2)).otherwise(0)
    items = booked.select("hash", "direction", "currency", "total", "gross", (F.col("gross") - half).cast("decimal(38,2)").alias("open"))
    return fx.revaluation_by_currency(fx.revaluation(items, fx_rates(spark), F.lit("2001-12-31").cast("date")))
