"""Bank statement, date, amount and party queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import dates, money, text
from tallyframe.operators import bank, parties
from tallyframe.plans.adapters import dec, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PHRASES = ["Wire fee March", "Payroll staff", "VAT payment Q2", "Expense claim 12", "Own account sweep", "Loan repayment", "Security deposit desk", "Refund for order", "INV-1234 interest charge", "Contract 77 salary", "Groceries", "Book transfer"]
_PHRASES = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"


def bank_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per user; purchases and views pay in, all else goes out; the balance runs from 1000.00."""
    order = Window.partitionBy("stmt").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stmt"), "ts", "event_type", money.money("value").alias("amount"))
    # dealt over all tasks: by their few bytes adaptive execution would put many statements into one task, and what is laid out and read behind here is far more
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stmt")
    e = e.withColumns({"incoming": F.col("event_type").isin("purchase", "view"), "idx": (F.row_number().over(order) - 1).cast("long"), "opening": F.lit(1000).cast("decimal(18,2)")})
    step = F.when(F.col("incoming"), F.col("amount")).otherwise(-F.col("amount"))
    balance = (F.col("opening") + F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("decimal(38,2)")
    return e.withColumns({
        "balance": balance, "date": F.to_date("ts"), "description": F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("event_id") % len(PHRASES) + 1).cast("int")),
        "status": F.when(F.col("event_type") == "error", "Pending").otherwise("Posted"), "account": F.concat(F.lit("ACC"), (F.col("stmt") + F.when(F.col("event_id") % 977 == 0, 1).otherwise(0)).cast("string")),
    })


_TXN = f"""t0 AS (SELECT event_id, user_id AS stmt, ts, event_type, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount, event_type IN ('purchase', 'view') AS incoming,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
t AS (SELECT *, 100000 + sum(CASE WHEN incoming THEN amount ELSE -amount END) OVER (PARTITION BY stmt ORDER BY idx) AS balance, ts::DATE AS date, {_PHRASES}[event_id % {len(PHRASES)} + 1] AS description,
  CASE event_type WHEN 'error' THEN 'Pending' ELSE 'Posted' END AS status, 'ACC' || (stmt + CASE WHEN event_id % 977 = 0 THEN 1 ELSE 0 END) AS account FROM t0)"""


@query(f"""WITH {_TXN}, p AS (SELECT *, coalesce(lag(balance) OVER (PARTITION BY stmt ORDER BY idx), 100000) AS prev FROM t)
SELECT event_id, coalesce({dec('CASE WHEN balance >= prev THEN amount END')}, 0) AS income, coalesce({dec('CASE WHEN balance < prev THEN amount END')}, 0) AS expense FROM p""")
def direction_from_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bank.direction_from_balance(bank_txns(spark, sf_dir))
    return out.select("event_id", *[F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,2)").alias(c) for c in ("income", "expense")])


@query(f"""WITH {_TXN}, g AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE balance END AS b FROM t),
p AS (SELECT *, b - coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY stmt ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000) AS delta FROM g)
SELECT event_id, coalesce({dec('CASE WHEN delta > 0 THEN delta END')}, 0) AS income, coalesce({dec('CASE WHEN delta < 0 THEN -delta END')}, 0) AS expense FROM p""")
def balance_only_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = bank_txns(spark, sf_dir).withColumn("balance", F.when(F.col("event_id") % 5 != 0, F.col("balance")))
    return bank.amount_from_balance(gaps).select("event_id", *[F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,2)").alias(c) for c in ("income", "expense")])


@query(f"""WITH {_TXN} SELECT stmt, min(date) FILTER (status = 'Posted') AS period_start, max(date) FILTER (status = 'Posted') AS period_end, {dec("coalesce(arg_max(balance, idx) FILTER (status = 'Posted'), 0)")} AS closing_balance,
  count(DISTINCT account) > 1 AS multi_account, count(*) FILTER (status <> 'Posted') AS pending_skipped FROM t GROUP BY stmt""")
def statement_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.statement_header(bank_txns(spark, sf_dir)).withColumn("closing_balance", F.coalesce("closing_balance", F.lit(0)).cast("decimal(38,2)"))


@query(f"""WITH {_TXN}, s AS (SELECT stmt, sum(CASE WHEN incoming THEN amount ELSE 0 END) AS i, sum(CASE WHEN incoming THEN 0 ELSE amount END) AS o, arg_max(balance, idx) + CASE WHEN stmt % 7 = 0 THEN 5 ELSE 0 END AS closing,
  count(*) FILTER (event_id % 3 = 0) AS n_posted, count(*) FILTER (event_id % 4 = 0) AS n_reconciled, count(*) FILTER (event_id % 3 <> 0 AND event_id % 4 <> 0) AS n_open FROM t GROUP BY 1)
SELECT stmt, {dec('i')} AS total_in, {dec('o')} AS total_out, {dec('i - o')} AS net, n_posted, n_reconciled, n_open, abs(100000 + i - o - closing) <= 1 AS ties FROM s""")
def bank_recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bank_txns(spark, sf_dir)
    closing = t.groupBy("stmt").agg(F.max_by("balance", "idx").alias("closing")).withColumn("closing", F.col("closing") + F.when(F.col("stmt") % 7 == 0, F.lit("0.05").cast("decimal(3,2)")).otherwise(F.lit("0.00").cast("decimal(3,2)")))
    ready = t.join(closing, "stmt").select("stmt", F.when(F.col("incoming"), F.col("amount")).alias("income"), F.when(~F.col("incoming"), F.col("amount")).alias("expense"), "opening", "closing", (F.col("event_id") % 3 == 0).alias("posted"), (F.col("event_id") % 4 == 0).alias("reconciled"))
    return bank.bank_reconciliation(ready, F.lit("0.01").cast("decimal(3,2)")).drop("opening", "closing")


def _words(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_KIND = f"""k0 AS (SELECT *, ' ' || regexp_replace(lower(description), '\\s+', ' ', 'g') || ' ' AS d FROM t),
k AS (SELECT *, CASE {' '.join(f"WHEN {_words('d', w)} THEN '{k}'" for k, w in bank.KINDS)} ELSE CASE WHEN incoming THEN 'customer_receipt' ELSE 'vendor_payment' END END AS kind FROM k0),
c AS (SELECT *, CASE {' '.join(f"WHEN kind = '{k}' THEN {_words('d', w)}" for k, w in bank.CERTAIN.items())} ELSE false END AS certain FROM k)"""


@query(f"WITH {_TXN}, {_KIND} SELECT event_id, kind, certain FROM c")
def txn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bank_txns(spark, sf_dir)
    return t.select("event_id", bank.kind_of(F.col("description"), F.when(F.col("incoming"), "in").otherwise("out")).alias("k")).select("event_id", "k.*")


@query(rf"""WITH {_TXN}, {_KIND}, g AS (SELECT *, kind IN ({', '.join(f"'{k}'" for k in bank.NO_INVOICE)}) AS none,
  list_filter([CASE WHEN NOT certain THEN 'weak keyword' END, CASE WHEN list_has_any(regexp_extract_all(lower(description), '[a-z0-9_]+'), [{', '.join(f"'{w}'" for w in text.DOCUMENT_WORDS if w.isascii())}]) OR {' OR '.join(f"contains(description, '{w}')" for w in text.DOCUMENT_WORDS if not w.isascii())} OR regexp_matches(description, '[A-Za-z]{{2}}-[0-9]{{3}}') THEN 'names a document' END, CASE WHEN amount * 1000 >= 5000000 THEN 'large amount' END], lambda x: x IS NOT NULL) AS r FROM c)
SELECT event_id, none AND len(r) = 0 AS auto_no_match, CASE WHEN none THEN array_to_string(r, '; ') ELSE '' END AS hold_why FROM g""")
def no_match_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bank_txns(spark, sf_dir).withColumn("k", bank.kind_of(F.col("description"), F.when(F.col("incoming"), "in").otherwise("out")))
    gate = bank.no_match_gate(F.col("k.kind"), F.col("k.certain"), F.col("description"), F.col("amount") * 1000)
    return t.select("event_id", *[c.alias(k) for k, c in gate.items()])


def raw_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals written in eight ways."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", money.money("o_totalprice").cast("string").alias("s"))
    whole, cents = F.substring_index("s", ".", 1), F.substring_index("s", ".", -1)
    grouped = lambda sep: F.regexp_replace(whole, r"(\d)(\d{3})$", "$1" + sep + "$2")
    ways = [F.concat(grouped(","), F.lit("."), cents), F.concat(grouped("."), F.lit(","), cents), F.concat(grouped(" "), F.lit(","), cents), F.concat(F.lit("("), grouped(","), F.lit("."), cents, F.lit(")")), F.concat(F.lit("USD "), F.col("s")), F.concat(F.col("s"), F.lit("-")), F.concat(grouped("'"), F.lit("."), cents), F.concat(F.lit("O"), whole)]
    chain = F.when(F.lit(False), F.lit(""))
    for i, w in enumerate(ways):
        chain = chain.when(F.col("o_orderkey") % 8 == i, w)
    return o.select("o_orderkey", "s", chain.alias("raw"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
SELECT o_orderkey, coalesce(CAST(CASE o_orderkey % 8 WHEN 3 THEN -v WHEN 5 THEN -v WHEN 7 THEN NULL ELSE v END AS DECIMAL(38,2)), 0) AS value, o_orderkey % 8 = 7 AS suspicious FROM o""")
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raw_amounts(spark, sf_dir).select("o_orderkey", money.parse_amount(F.col("raw")).alias("p"))
    return out.select("o_orderkey", F.coalesce(F.col("p.value"), F.lit(0)).cast("decimal(38,2)").alias("value"), "p.suspicious")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, coalesce(CASE k WHEN 5 THEN NULL WHEN 4 THEN d ELSE d END::VARCHAR, '') AS value, k = 5 OR (k = 2 AND day(d) <= 12 AND day(d) <> month(d)) AS review FROM o""")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    ways = ["yyyy-MM-dd", "d-MMM-yyyy", "MM/dd/yyyy", "yyyy年M月d日", "d MMMM, yyyy"]
    chain = F.when(F.lit(False), F.lit(""))
    for i, w in enumerate(ways):
        chain = chain.when(F.col("o_orderkey") % 6 == i, F.date_format("d", w))
    parsed = o.select("o_orderkey", dates.parse_date(chain.otherwise(F.lit("no date"))).alias("p"))
    return parsed.select("o_orderkey", F.coalesce(F.col("p.value").cast("string"), F.lit("")).alias("value"), "p.review")


@query("""WITH o AS (SELECT o_orderkey, ['USD', 'EUR', 'GBP', 'JPY', 'KWD'][c_nationkey % 5 + 1] AS currency, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS t FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CASE currency WHEN 'JPY' THEN 0 WHEN 'KWD' THEN 3 ELSE 2 END AS places, CAST(CASE currency WHEN 'KWD' THEN 0.001 ELSE 0.01 END AS DECIMAL(18,4)) AS tolerance,
  CAST(greatest(CAST(1 AS DECIMAL(18,4)), CAST(t // 2 AS DECIMAL(14,0)) * CAST(0.0001 AS DECIMAL(4,4)) + CASE WHEN t % 2 = 1 THEN CAST(0.0001 AS DECIMAL(18,4)) ELSE 0 END) AS DECIMAL(18,4)) AS fee FROM o""")
def match_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.plans.adapters import invoices

    return invoices(spark, sf_dir).select("o_orderkey", money.currency_decimals(F.col("currency")).alias("places"), money.match_tolerance(F.col("currency")).alias("tolerance"), money.fee_tolerance(F.col("total")).alias("fee"))


# ---- parties


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as vendors and customers as customers, spelled in four ways; every fiftieth customer is a supplier's name."""
    spell = lambda name, k: F.when(k % 4 == 0, F.concat(name, F.lit(" Inc."))).when(k % 4 == 1, F.concat(F.upper(name), F.lit(", LTD"))).when(k % 4 == 2, F.concat(F.lit("  "), name)).otherwise(name)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") / 50).cast("long").cast("string"), 9, "0"))).otherwise(F.col("c_name")).alias("n"))
    ways = s.unionByName(s.withColumn("k", F.col("k") + 1)).select(spell(F.col("n"), F.col("k")).alias("name"), F.lit("vendor").alias("role"), F.col("k").alias("ord"))
    return ways.unionByName(c.select(spell(F.col("n"), F.col("k")).alias("name"), F.lit("customer").alias("role"), (F.col("k") + 1_000_000_000).alias("ord")))


_SPELL = lambda n, k: f"CASE {k} % 4 WHEN 0 THEN {n} || ' Inc.' WHEN 1 THEN upper({n}) || ', LTD' WHEN 2 THEN '  ' || {n} ELSE {n} END"
_FORMS = ", ".join(f"'{f}'" for f in text.COMPANY_FORMS)
_MENTION = f"""ss AS (SELECT s_suppkey AS k, s_name AS n FROM supplier UNION ALL SELECT s_suppkey + 1, s_name FROM supplier),
cc AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN 'Supplier#' || lpad((c_custkey // 50)::VARCHAR, 9, '0') ELSE c_name END AS n FROM customer),
m0 AS (SELECT {_SPELL('n', 'k')} AS name, 'vendor' AS role, k AS ord FROM ss UNION ALL SELECT {_SPELL('n', 'k')}, 'customer', k + 1000000000 FROM cc),
m AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(lower(trim(name)), '[.,#]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ({_FORMS})), ' ') AS norm FROM m0)"""


@query(f"WITH {_MENTION} SELECT name, norm FROM m")
def party_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select("name", text.party_key(F.col("name")).alias("norm"))


_ROLLUP = f"WITH {_MENTION}, r AS (SELECT norm, arg_min(name, ord) AS name, count(*) AS n, CASE WHEN bool_or(role = 'vendor') AND bool_or(role = 'customer') THEN 'both' ELSE min(role) END AS role FROM m GROUP BY 1)"


@query(f"{_ROLLUP} SELECT norm, name, n, role FROM r")
def party_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parties.party_rollup(mentions(spark, sf_dir))


@query(f"{_ROLLUP} SELECT norm, name, n FROM r WHERE role = 'both' AND norm NOT IN (SELECT 'supplier ' || lpad(s_suppkey::VARCHAR, 9, '0') FROM supplier WHERE s_suppkey % 3 = 0)")
def self_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.col("s_name"), F.lit(" GmbH")).alias("name"))
    return parties.self_candidates(mentions(spark, sf_dir), known)


@query(f"""WITH {_MENTION}, p AS (SELECT s_suppkey AS id, 'supplier ' || lpad(s_suppkey::VARCHAR, 9, '0') AS norm FROM supplier WHERE s_suppkey % 5 <> 0),
al AS (SELECT s_suppkey AS id, 'customer ' || lpad(s_suppkey::VARCHAR, 9, '0') AS norm FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT m.name, m.ord, coalesce(p.id, al.id, -1) AS party_id FROM m LEFT JOIN p USING (norm) LEFT JOIN al ON al.norm = m.norm""")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    known = s.select(F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 == 0, "archived").alias("status"))
    aliases = s.select(F.col("s_suppkey").alias("party_id"), F.concat(F.lit("CUSTOMER "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(" plc")).alias("alias"))
    return parties.resolve(mentions(spark, sf_dir), known, aliases).select("name", "ord", F.coalesce("party_id", F.lit(-1)).alias("party_id"))


@query("""WITH p AS (SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') || ' ' || (p_partkey % 97) AS b FROM part),
n AS (SELECT DISTINCT b AS a FROM p WHERE p_partkey % 10 = 0),
s AS (SELECT a, p_partkey, b, CASE WHEN a = b THEN 1.0 ELSE len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) END AS score FROM n, p),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, p_partkey) AS rank FROM s WHERE score >= 0.62)
SELECT a AS norm, p_partkey AS party_id, b AS party_norm, score, rank::INT AS rank, score >= 0.86 AS likely_same FROM r WHERE rank <= 5""")
def token_jaccard_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.concat_ws(" ", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " "), (F.col("p_partkey") % 97).cast("string"))
    known = p.select(F.col("p_partkey").alias("party_id"), key.alias("name"))
    return parties.jaccard_candidates(known.where("party_id % 10 = 0"), known)


@query()
def fuzzy_party_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    known = p.select(F.col("p_partkey").alias("party_id"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 97).cast("string")).alias("name"))
    asked = known.where("party_id % 50 = 0").withColumn("name", F.regexp_replace("name", "e", "ee"))
    return parties.fuzzy_candidates(asked, known)
