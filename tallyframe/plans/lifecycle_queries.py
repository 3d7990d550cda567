"""Lifecycle and text extract queries, each with its SQL."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import extract, text
from tallyframe.operators import accounts, lifecycle
from tallyframe.plans.adapters import ORACLE_JOURNAL, dec, journal, table
from tallyframe.plans.bank_queries import _TXN, bank_txns
from tallyframe.plans.ledger_queries import CHART

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE array_to_string(list_concat(list_concat(
    CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 THEN ['statement empty'] ELSE [] END, CASE WHEN o_orderkey % 5 = 0 THEN ['missing total_due'] ELSE [] END),
    CASE WHEN o_orderkey % 6 = 0 THEN ['TOTAL_MISMATCH'] ELSE [] END), ';') || CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 12 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'critical' WHEN o_orderkey % 8 = 1 THEN 'not parsed' ELSE '' END ELSE '' END END AS reasons FROM orders""")
def match_block_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    r = lifecycle.block_reasons(F.when(k % 9 == 0, "failed").when(k % 8 == 1, "partial").otherwise("parsed"), F.when(k % 4 == 0, "statement").otherwise("invoice"), k % 3, F.when(k % 5 == 0, F.array(F.lit("total_due"))).otherwise(none), F.when(k % 6 == 0, F.array(F.lit("DATE_AMBIGUOUS"), F.lit("TOTAL_MISMATCH"), F.lit("TOTAL_MISMATCH"))).otherwise(none), k % 7 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(r, ";").alias("reasons"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 6 <> 0 AND o_orderkey % 10 <> 1")
def match_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.when(F.col("o_orderstatus") == "P", "Rejected").when(F.col("o_orderstatus") == "F", "Approved").alias("status"), F.when(F.col("o_orderkey") % 6 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return lifecycle.pool(o, o.where("hash % 10 = 1")).select(F.col("hash").alias("o_orderkey"))


_ACTIONS = ["propose", "confirm", "unconfirm", "reject", "unreject", "ack", "unack"]


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions on matches of thirty events each, the first always a proposal."""
    e = table(spark, sf_dir, "events")
    pick = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("event_id") * 7919 % 101 % 7 + 1).cast("int"))
    return e.select((F.col("event_id") / 30).cast("bigint").alias("match_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 30 == 0, "propose").otherwise(pick).alias("action"))


@query("""WITH RECURSIVE e AS (SELECT event_id // 30 AS match_id, event_id % 30 AS i, CASE WHEN event_id % 30 = 0 THEN 'propose' ELSE ['propose', 'confirm', 'unconfirm', 'reject', 'unreject', 'ack', 'unack'][event_id * 7919 % 101 % 7 + 1] END AS action FROM events),
s AS (SELECT match_id, i, 'proposed' AS state FROM e WHERE i = 0 UNION ALL
  SELECT e.match_id, e.i, CASE WHEN state = 'proposed' AND action = 'confirm' THEN 'confirmed' WHEN state = 'proposed' AND action = 'reject' THEN 'rejected' WHEN state = 'proposed' AND action = 'ack' THEN 'acknowledged'
    WHEN (state = 'confirmed' AND action = 'unconfirm') OR (state = 'rejected' AND action = 'unreject') OR (state = 'acknowledged' AND action = 'unack') THEN 'proposed' ELSE state END FROM s JOIN e ON e.match_id = s.match_id AND e.i = s.i + 1)
SELECT match_id, arg_max(state, i) AS state, count(*)::INT AS n_actions FROM s GROUP BY 1""")
def match_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.match_states(match_events(spark, sf_dir))


_MEMBERS = "m AS (SELECT o_orderkey // 3 AS match_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'invoice' ELSE 'txn' END AS kind, 'k' || (o_orderkey % 400) AS member_key, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS v, o_orderdate::DATE AS d FROM orders)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(k / 3).alias("match_id"), F.when((k % 3 == 0) & (k % 2 == 0), "invoice").otherwise("txn").alias("kind"), F.concat(F.lit("k"), (k % 400).cast("string")).alias("member_key"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.to_date("o_orderdate").alias("date"), k.alias("o_orderkey"))


@query(f"WITH {_MEMBERS} SELECT member_key, count(DISTINCT match_id) AS n FROM m GROUP BY 1 HAVING count(DISTINCT match_id) > 1")
def doubly_used_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.doubly_used(members(spark, sf_dir))


@query(f"WITH {_MEMBERS}, h AS (SELECT *, bool_or(kind = 'invoice') OVER (PARTITION BY match_id) AS has FROM m) SELECT match_id, member_key, CASE WHEN has THEN 'reconciled' ELSE 'no_invoice' END AS \"as\" FROM h WHERE kind = 'txn'")
def confirmed_txn_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.confirmed_kinds(members(spark, sf_dir))


@query(f"WITH {_MEMBERS}, c AS (SELECT match_id, sum(v) AS v, max(d) AS paid_on, count(*) AS n_txns FROM m WHERE kind = 'txn' GROUP BY 1) SELECT 'k' || match_id AS hash, {dec('c.v')} AS cash, paid_on, n_txns FROM m JOIN c USING (match_id) WHERE kind = 'invoice'")
def matched_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir).withColumn("member_key", F.when(F.col("kind") == "invoice", F.concat(F.lit("k"), "match_id")).otherwise(F.col("o_orderkey").cast("string")))
    return lifecycle.matched_cash(m.select("match_id", "kind", "member_key"), m.select(F.col("member_key").alias("txn_key"), "amount", "date"))


@query("""WITH c AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'auto' WHEN 3 THEN 'multi' END AS label FROM orders), k(label) AS (VALUES ('auto'), ('confirm'), ('multi'), ('unmatched'), ('no_match_needed'), ('confirmed'), ('rejected'))
SELECT k.label, count(c.label) AS n FROM k LEFT JOIN c USING (label) GROUP BY 1""")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    m = table(spark, sf_dir, "orders").select(F.when(k == 0, "confirmed").when(k == 1, "rejected").when(k == 4, "acknowledged").otherwise("proposed").alias("state"), F.when(k == 2, "auto").when(k == 3, "multi").otherwise("confirm").alias("category"))
    return lifecycle.match_counts(m, ["auto", "confirm", "multi", "unmatched", "no_match_needed"])


@query("SELECT 'inv-' || o_orderkey AS hash FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), 'r#00000000') OR contains('inv-' || lpad(o_orderkey::VARCHAR, 8, '0'), 'r#00000000') ORDER BY o_orderkey % 2 = 0, 'inv-' || o_orderkey LIMIT 41")
def manual_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    inv = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.concat(F.lit("inv-"), F.col("o_orderkey").cast("string")).alias("hash"), F.concat(F.lit("INV-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("invoice_no"), F.col("c_name").alias("vendor"), F.lit(0).alias("amount"), (F.col("o_orderkey") % 2 == 0).alias("matched"))
    return lifecycle.search(inv, "R#00000000").select("hash")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'AR' ELSE 'AP' END AS direction FROM orders")
def direction_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    issuer = F.when(k % 3 == 0, "Our Firm, GmbH & Co").otherwise("Someone Else")
    return table(spark, sf_dir, "orders").select("o_orderkey", lifecycle.direction_of(["Our Firm"], issuer, F.lit("our firm gmbh")).alias("direction"))


@query(f"""WITH {ORACLE_JOURNAL}, {CHART}, e AS (SELECT entry_id, count(*) AS n, bool_and(code IS NOT NULL AND ((dr > 0 AND cr = 0) OR (cr > 0 AND dr = 0))) AS ok, sum(dr) = sum(cr) AS b FROM jl LEFT JOIN chart ON code = account GROUP BY 1)
SELECT entry_id, n >= 2 AND ok AND b AS valid FROM e""")
def manual_entry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.valid_manual(journal(spark, sf_dir), accounts.chart(spark))


@query(f"WITH {ORACLE_JOURNAL} SELECT DISTINCT entry_id, strftime(d, '%Y-%m') AS period FROM jl WHERE strftime(d, '%m') = '03'")
def closed_period_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = journal(spark, sf_dir)
    closed = spark.createDataFrame([(f"{y}-03",) for y in range(1990, 2030)], "period string")
    return lifecycle.into_closed_periods(lines, closed)


@query(f"WITH {ORACLE_JOURNAL} SELECT DISTINCT strftime(d, '%Y-%m') AS period, CASE WHEN strftime(d, '%m') = '03' THEN 'closed' ELSE 'open' END AS status FROM jl")
def period_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.periods(journal(spark, sf_dir), spark.createDataFrame([(f"{y}-03",) for y in range(1990, 2030)], "period string"))


@query(f"""WITH {_TXN}, f AS (SELECT *, CASE event_id % 4 WHEN 0 THEN '1100' WHEN 1 THEN '6603' ELSE '4100' END AS counter FROM t WHERE event_id % 6 <> 5 AND amount > 0)
SELECT 'stmt-' || event_id AS entry_id, date, unnest(['1002', counter]) AS account, unnest([{dec('CASE WHEN incoming THEN amount ELSE 0 END')}, {dec('CASE WHEN incoming THEN 0 ELSE amount END')}]) AS debit,
  unnest([{dec('CASE WHEN incoming THEN 0 ELSE amount END')}, {dec('CASE WHEN incoming THEN amount ELSE 0 END')}]) AS credit FROM f WHERE counter <> '1100'""")
def statement_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    t = bank_txns(spark, sf_dir).withColumns({"txn_key": F.col("event_id").cast("string"), "counter": F.when(k == 0, "1100").when(k == 1, "6603").otherwise("4100")})
    lines = lifecycle.statement_entries(t, t.where("event_id % 6 = 5"))
    return lines.select("entry_id", "date", "account", F.col("debit").cast("decimal(38,2)").alias("debit"), F.col("credit").cast("decimal(38,2)").alias("credit"))


@query("""WITH r AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey % 3 = 0 THEN '1100' WHEN s_suppkey % 11 = 1 THEN '' ELSE '1405' END AS account, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS party,
  CASE WHEN s_suppkey % 5 <> 0 THEN greatest(CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT), 0) ELSE 0 END AS d, CASE WHEN s_suppkey % 7 = 0 THEN 500 ELSE 0 END AS c FROM supplier)
SELECT n, CASE WHEN account = '' THEN 'no account' WHEN d > 0 AND c > 0 THEN 'both sides' WHEN d <= 0 AND c <= 0 THEN 'no amount' WHEN account = '1100' AND party = '' THEN 'no party' ELSE '' END AS error FROM r""")
def opening_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("n"), F.when(k % 3 == 0, "1100").when(k % 11 == 1, "").otherwise("1405").alias("account"), F.when(k % 2 == 0, F.col("s_name")).alias("party"), F.when(k % 5 != 0, F.greatest(F.col("s_acctbal").cast("decimal(18,2)"), F.lit(0))).alias("debit"), F.when(k % 7 == 0, F.lit(5).cast("decimal(18,2)")).alias("credit"))
    return lifecycle.opening_lines(rows).groupBy("n").agg(F.coalesce(F.max("error"), F.lit("")).alias("error"))


# ---- text

_CODE_FORMS = ["Currency: {c} total", "Amount ({c}) for work", "amounts in {c} only", "{c} {a} due", "pay €{a}", "costs ${a}", "US${a}", "none", "ccy {c}", "₩{a}", "Total {c} {a}"]
_CODE_SQL = "CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN " + " || ".join(x for x in ("'" + f.replace("{c}", "' || c || '").replace("{a}", "' || a || '") + "'").split(" || ") if x != "''") for i, f in enumerate(_CODE_FORMS)) + " END"


@query(rf"""WITH n AS (SELECT o_orderkey, upper(substr(n_name, 1, 3)) AS c, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS a FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT o_orderkey, {_CODE_SQL} AS s FROM n)
SELECT o_orderkey, coalesce({", ".join(f"nullif(regexp_extract(s, '{p}', 1), '')" for p in extract.CODE_PATTERNS)}, CASE WHEN regexp_matches(s, 'US\$') THEN 'USD' WHEN regexp_matches(s, '€') THEN 'EUR' WHEN contains(s, '₩') THEN 'KRW' END, '') AS currency FROM s""")
def currency_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three capitals of each customer's nation, and the order's total, in eleven wordings."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    named = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    code, amount = F.upper(F.substring("n_name", 1, 3)), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    said = F.coalesce(*[F.when(F.col("o_orderkey") % 11 == i, F.replace(F.replace(F.lit(f), F.lit("{c}"), code), F.lit("{a}"), amount)) for i, f in enumerate(_CODE_FORMS)])
    return named.select("o_orderkey", F.coalesce(extract.currency(said), F.lit("")).alias("currency"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS a, CAST(o_orderkey % 90 + 1 AS VARCHAR) || '.05' AS t FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN a END AS subtotal, CASE WHEN k IN (0, 2) THEN t END AS sales_tax, CASE WHEN k IN (0, 3) THEN a END AS total_due, CASE WHEN k = 2 THEN '15%' END AS rate, CASE WHEN k = 2 THEN a END AS included FROM o""")
def amounts_in_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    a, t = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.concat((F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(".05"))
    said = F.when(k == 0, F.concat(F.lit("The subtotal is USD "), a, F.lit(". Applicable tax is USD "), t, F.lit(". The total amount due is "), a, F.lit("."))).when(k == 1, F.concat(F.lit("Tax Advisory 2 "), t, F.lit(" Sub total: "), a)).when(k == 2, F.concat(F.lit("sales tax = "), t, F.lit(" with total excl. VAT "), a, F.lit("; incl. tax (15%): GBP "), a)).otherwise(F.concat(F.lit("total payable: "), a))
    both = table(spark, sf_dir, "orders").select("o_orderkey", extract.prose_amounts(said).alias("p"), extract.included_tax(said).alias("i"))
    return both.select("o_orderkey", "p.*", F.col("i.rate").alias("rate"), F.col("i.amount").alias("included"))


@query("SELECT o_orderkey, o_orderdate::DATE AS s, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE + 30 ELSE DATE '1900-01-01' END AS e FROM orders WHERE o_orderkey % 4 < 3 UNION ALL SELECT o_orderkey, DATE '1900-01-01', DATE '1900-01-01' FROM orders WHERE o_orderkey % 4 = 3")
def service_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, k = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 30), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.concat(F.lit("Service from "), a.cast("string"), F.lit(" to "), b.cast("string"))).when(k == 1, F.concat(F.date_format(a, "d MMM yyyy"), F.lit(" - "), F.date_format(b, "d MMM yyyy"))).when(k == 2, F.concat(a.cast("string"), F.lit("至"), b.cast("string"))).otherwise("no period")
    none = F.lit("1900-01-01").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.period(said).alias("p")).select("o_orderkey", F.coalesce("p.start", none).alias("s"), F.coalesce("p.end", none).alias("e"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END::INT AS n FROM orders")
def invoice_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit("INVOICE "), F.col("o_orderkey").cast("string"), F.lit("\nwork\nTotal Due 5.00\n"))
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.concat(one, one)).when(k == 1, F.concat(F.lit("header\n"), one)).otherwise(F.concat(one, one, one))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(extract.segments(s)).alias("n"))


@query("SELECT p_partkey, ['newline', 'numbered', 'semicolon', 'pipe', ''][p_partkey % 5 + 1] AS pattern FROM part")
def split_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("p_partkey") % 5, F.col("p_brand")
    s = F.when(k == 0, F.concat(p, F.lit("\nx"))).when(k == 1, F.concat(F.lit("1. "), p, F.lit(" 2. x"))).when(k == 2, F.concat(p, F.lit("; x"))).when(k == 3, F.concat(p, F.lit(" | x"))).otherwise(F.concat(p, F.lit(" x")))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(extract.split_pattern(s, F.array(p, F.lit("x"))), F.lit("")).alias("pattern"))


@query("SELECT p_partkey, 'Design ' || p_brand || '/build/ship' AS parts FROM part")
def exploded_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("Design "), F.col("p_brand"), F.lit(" 1,200.00 build; 5.00 | ship"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.exploded_description(s), "/").alias("parts"))


@query("SELECT o_orderkey, '$' || CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS fixed FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR FROM orders WHERE o_totalprice >= 1000")
def ocr_amount_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = F.when(F.col("o_totalprice") < 1000, F.concat(F.lit("S"), a)).otherwise(F.replace(a, F.lit("."), F.lit(":")))
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.repaired_amounts(raw).alias("fixed"))


@query(r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\pL\pN]', '', 'g'))::INT AS useful, regexp_matches(coalesce(text, ''), '(?i)bank statement|account statement') AS statement FROM documents")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", extract.useful_chars(t).alias("useful"), extract.is_statement(t).alias("statement"))


@query("SELECT s_suppkey, substr(sha1('amount|supplier'), 1, 12) AS fp FROM supplier")
def label_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("Supplier: "), F.col("s_name"), F.lit("\nAmount: 5\n amount : 6\nSUPPLIER: x\n12:30\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.fingerprint(s).alias("fp"))


@F.pandas_udf(T.StringType())
def _address(key: pd.Series) -> pd.Series:
    """An address with its checksum, made from the key."""
    def made(k: int) -> str:
        data = b"\x41" + hashlib.sha256(str(k).encode()).digest()[:20]
        n = int.from_bytes(data + hashlib.sha256(hashlib.sha256(data).digest()).digest()[:4], "big")
        out = ""
        while n:
            n, rest = divmod(n, 58)
            out = extract._BASE58[rest] + out
        return out

    return key.map(made)


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS ok FROM orders")
def wallet_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address of each order's own: as it is, with two letters in the middle exchanged or, where they are equal, one left out, and with its last letter changed."""
    k = F.col("o_orderkey")
    made = table(spark, sf_dir, "orders").select("o_orderkey", _address("o_orderkey").alias("a"))
    x, y = F.substring("a", 10, 1), F.substring("a", 11, 1)
    swapped = F.concat(F.substring("a", 1, 9), F.when(x == y, "").otherwise(y), x, F.expr("substring(a, 12)"))
    changed = F.concat(F.expr("left(a, length(a) - 1)"), F.when(F.expr("right(a, 1)") == "z", "y").otherwise("z"))
    return made.withColumn("address", F.when(k % 3 == 0, F.col("a")).when(k % 3 == 1, swapped).otherwise(changed)).select("o_orderkey", extract.valid_tron("address").alias("ok"))


@query(f"""WITH {_TXN}, h AS (SELECT stmt, 100000 AS o, arg_max(balance, idx) AS c FROM t GROUP BY 1) SELECT stmt, {dec('o')} AS opening, {dec('c')} AS closing, 'EUR' AS currency, 'ACC-' || lpad(stmt::VARCHAR, 6, '0') AS account FROM h""")
def statement_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bank_txns(spark, sf_dir).groupBy("stmt").agg(F.max_by("balance", "idx").alias("c"))
    s = F.concat(F.lit("Account Number: ACC-"), F.lpad(F.col("stmt").cast("string"), 6, "0"), F.lit("\nCurrency: EUR\nOpening Balance EUR 1,000.00\nClosing balance: "), F.col("c").cast("decimal(18,2)").cast("string"))
    return t.select("stmt", extract.statement_head(s).alias("h")).select("stmt", F.col("h.opening").cast("decimal(38,2)").alias("opening"), F.col("h.closing").cast("decimal(38,2)").alias("closing"), "h.currency", "h.account")
