"""Document, review, extraction, layout and statement format queries, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import documents, layout
from tallyframe.plans.adapters import ORACLE_INVOICES, dec, invoices, table
from tallyframe.plans.bank_queries import _TXN, bank_txns
from tallyframe.sources import statements

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices as an extraction might leave them: some totals off by 5.00, some parts missing."""
    k = F.col("o_orderkey")
    off = F.when(k % 7 == 0, 5).otherwise(0).cast("decimal(18,2)")
    nothing = F.array().cast("array<decimal(18,2)>")
    return invoices(spark, sf_dir).select(
        "o_orderkey", "subtotal", F.when(k % 11 != 0, F.col("tax")).alias("tax"), F.when(k % 13 != 0, (F.col("total") + off).cast("decimal(18,2)")).alias("total"), F.when(k % 17 == 0, F.col("subtotal")).otherwise((F.col("total") + off).cast("decimal(18,2)")).alias("payment_due"),
        F.when(k % 19 == 0, "0.00 %").otherwise("5.00%").alias("tax_rate"), F.when(k % 14 == 0, F.array(F.lit(5).cast("decimal(18,2)"))).otherwise(nothing).alias("adjustments"),
        F.when(k % 3 == 0, F.array(F.col("subtotal"))).when(k % 3 == 1, F.array(F.col("subtotal"), F.when(k % 5 != 0, F.lit(1).cast("decimal(18,2)")))).otherwise(nothing).alias("line_amounts"),
        F.when(k % 23 != 0, F.col("invoice_no")).alias("invoice_no"), F.when(k % 29 != 0, F.col("date")).alias("invoice_date"), F.when(k % 31 != 0, F.col("party")).alias("issuer"), F.lit("").alias("customer"),
        F.lit("$").alias("symbol"), F.when(k % 37 == 0, "USD/HKD").otherwise(F.col("currency")).alias("currency"), (F.dayofmonth("date") <= 12).alias("date_ambiguous"), F.when(k % 41 == 0, "other").alias("duplicate_of"), (k % 3).alias("n_targets"),
    )


_X = f"""WITH {ORACLE_INVOICES}, x0 AS (SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN total + 500 ELSE total END AS tt FROM inv),
x AS (SELECT k, d, currency AS c0, total - tax AS sub, CASE WHEN k % 11 <> 0 THEN tax END AS tax, CASE WHEN k % 13 <> 0 THEN tt END AS total, CASE WHEN k % 17 = 0 THEN total - tax ELSE tt END AS due,
  CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 2 ELSE 0 END AS n_lines, k % 3 = 1 AND k % 5 = 0 AS no_amount, CASE WHEN k % 37 = 0 THEN 'USD/HKD' ELSE currency END AS ccy FROM x0),
y AS (SELECT *, abs(sub + coalesce(tax, 0) - total) AS gap, CASE WHEN k % 3 = 0 THEN sub ELSE sub + 100 END AS lines FROM x),
i AS (SELECT k, unnest(list_filter([
  CASE WHEN gap > 1 AND NOT (k % 14 = 0 AND abs(500 - gap) <= 1) THEN 'TOTAL_MISMATCH' END, CASE WHEN gap > 1 AND k % 14 = 0 AND abs(500 - gap) <= 1 THEN 'TOTAL_ADJUSTED' END,
  CASE WHEN k % 19 = 0 AND tax <> 0 THEN 'TAX_RATE_CONFLICT' END, CASE WHEN due <> total AND n_lines <= 1 THEN 'PAYMENT_DUE_MISMATCH' END, CASE WHEN no_amount THEN 'LINE_NO_AMOUNT' END,
  CASE WHEN n_lines > 0 AND NOT no_amount AND abs(lines - sub) > 1 THEN 'LINE_SUM_MISMATCH' END, CASE WHEN ccy <> 'USD' THEN 'CURRENCY_SPLIT' END, CASE WHEN contains(ccy, '/') THEN 'CURRENCY_AMBIGUOUS' END,
  CASE WHEN day(d) <= 12 THEN 'DATE_AMBIGUOUS' END, CASE WHEN k % 41 = 0 THEN 'DUPLICATE' END, CASE WHEN k % 23 = 0 THEN 'MISSING_INVOICE_NO' END, CASE WHEN k % 29 = 0 THEN 'MISSING_DATE' END,
  CASE WHEN k % 31 = 0 THEN 'MISSING_PARTY' END, CASE WHEN total IS NULL THEN 'MISSING_TOTAL' END, CASE WHEN k % 3 = 0 THEN 'NO_PAYMENT_INFO' END, CASE WHEN k % 3 = 2 THEN 'MULTI_PAYMENT_METHOD' END], lambda z: z IS NOT NULL)) AS code FROM y)"""


@query(f"{_X} SELECT k AS o_orderkey, code FROM i")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select("o_orderkey", F.explode(documents.issues()).alias("i")).select("o_orderkey", "i.code")


@query(f"""{_X}, f AS (SELECT k, bool_or(code IN ('TOTAL_MISMATCH', 'LINE_SUM_MISMATCH', 'TAX_RATE_CONFLICT')) AS failed FROM i GROUP BY 1),
r AS (SELECT y.k, CASE WHEN y.k % 10 = 0 THEN 20 ELSE 0 END + CASE WHEN y.k % 6 = 0 THEN 30 ELSE 0 END + CASE WHEN y.k % 8 = 0 THEN 50 ELSE 0 END + CASE WHEN coalesce(failed, false) THEN 100 ELSE 0 END
  + 40 * (CASE WHEN y.k % 23 = 0 THEN 1 ELSE 0 END + CASE WHEN y.k % 29 = 0 THEN 1 ELSE 0 END + CASE WHEN total IS NULL THEN 1 ELSE 0 END) + CASE WHEN y.k % 9 = 0 THEN 80 ELSE 0 END AS s, y.k % 23 = 0 OR total IS NULL AS hard FROM y LEFT JOIN f USING (k))
SELECT k AS o_orderkey, s::INT AS risk_score, s > 30 AS needs_manual, s >= 100 OR hard AS critical FROM r""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extracted(spark, sf_dir)
    k, one = F.col("o_orderkey"), lambda c: F.when(c, 1).otherwise(0)
    x = x.withColumns({
        "codes": F.transform(documents.issues(), lambda i: i["code"]), "ocr_quality": F.when(k % 10 == 0, 0.9).otherwise(1.0), "amount_confidence": F.when(k % 6 == 0, 0.9).otherwise(0.99), "decimal_confidence": F.when(k % 8 == 0, 0.9).otherwise(1.0),
        "n_missing": one(F.col("invoice_no").isNull()) + one(F.col("invoice_date").isNull()) + one(F.col("total").isNull()), "hard_missing": F.col("invoice_no").isNull() | F.col("total").isNull(), "text_mismatch": k % 9 == 0, "ocr_mismatch": F.lit(False),
    })
    return x.select("o_orderkey", *[c.alias(n) for n, c in documents.risk(F.col("codes")).items()])


@query(f"""WITH {ORACLE_INVOICES}, b AS (SELECT l_orderkey, sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS s, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, {dec('s')} AS line_sum, n AS n_lines, abs(s - total) <= 1 AS ties FROM inv JOIN b ON l_orderkey = o_orderkey""")
def line_sum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("line_sum"), F.count("*").alias("n_lines"))
    inv = invoices(spark, sf_dir).select("o_orderkey", "total")
    return inv.join(lines, inv["o_orderkey"] == lines["l_orderkey"]).select("o_orderkey", "line_sum", "n_lines", (F.abs(F.col("line_sum") - F.col("total")) <= F.lit("0.01").cast("decimal(3,2)")).alias("ties"))


PHRASES = ["Monthly management fee", "Legal services rendered", "Cloud hosting plan", "Laptop for staff", "Airfare to Berlin", "Unclear item", "Bank charges Q3", "Training seminar", "Server equipment lease", "Freight and delivery", "Sundry", "Audit fee 2020"]
SELLERS = ["Acme", "Uber BV", "FedEx", "Stripe", "Plain Co"]


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    return invoices(spark, sf_dir).select("o_orderkey", pick(PHRASES).alias("description"), pick(SELLERS).alias("supplier"), "total", "currency", F.when(F.col("o_orderkey") % 4 == 0, "interest charge on account").otherwise("nothing here").alias("full_text"))


def _sql_rules(rules: list, column: str, confidence: str, by: str) -> str:
    return " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN {{'category': '{c}', 'account': '{a}', 'confidence': {confidence}, 'by': '{by}'}}" for p, c, a in rules)


_STRUCT = "STRUCT(category VARCHAR, account VARCHAR, confidence DOUBLE, \"by\" VARCHAR)"


@query(f"""WITH {ORACLE_INVOICES}, x AS (SELECT o_orderkey, [{', '.join(f"'{p}'" for p in PHRASES)}][o_orderkey % {len(PHRASES)} + 1] AS descr, [{', '.join(f"'{p}'" for p in SELLERS)}][o_orderkey % {len(SELLERS)} + 1] AS sup, total, currency,
  CASE WHEN o_orderkey % 4 = 0 THEN 'interest charge on account' ELSE 'nothing here' END AS ft FROM inv), z AS (SELECT *, descr || ' ' || sup AS b FROM x),
c AS (SELECT o_orderkey, CAST(CASE {_sql_rules(documents.CATEGORY_RULES, 'descr', '0.8', 'desc')} {_sql_rules(documents.SUPPLIER_RULES, 'sup', '0.8', 'supplier')} {_sql_rules(documents.CATEGORY_RULES, 'b', '0.8', 'keyword')}
  WHEN regexp_matches(b, '(?i){documents.ASSET}') AND total >= 100 * CASE currency WHEN 'GBP' THEN 2500 WHEN 'JPY' THEN 400000 ELSE 3000 END THEN {{'category': 'Fixed Asset (candidate)', 'account': '1500 Fixed Assets', 'confidence': 0.4, 'by': 'asset'}}
  {_sql_rules(documents.CATEGORY_RULES, 'ft', '0.25', 'fulltext')} ELSE {{'category': 'Unclassified', 'account': NULL, 'confidence': 0.0, 'by': 'none'}} END AS {_STRUCT}) AS k FROM z)
SELECT o_orderkey, k.category, coalesce(k.account, '') AS account, k.confidence, k."by" AS rule FROM c""")
def rule_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents.classification(F.col("description"), F.col("supplier"), F.col("total"), F.col("currency"), F.col("full_text"))
    return described(spark, sf_dir).select("o_orderkey", c.alias("k")).select("o_orderkey", "k.category", F.coalesce("k.account", F.lit("")).alias("account"), "k.confidence", F.col("k.by").alias("rule"))


@query(f"""WITH r AS (SELECT unnest(range({len(PHRASES)})) AS rule_id, unnest([{', '.join(f"'{p}'" for p in PHRASES)}]) AS key),
rw AS (SELECT rule_id, list_distinct(regexp_extract_all(lower(key), '[a-z]{{4,}}')) AS ws FROM r), x AS (SELECT o_orderkey AS doc_id, list_distinct(regexp_extract_all(lower([{', '.join(f"'{p}'" for p in PHRASES)}][o_orderkey % {len(PHRASES)} + 1] || ' for the staff'), '[a-z]{{4,}}')) AS ws FROM orders),
s AS (SELECT doc_id, rule_id, len(list_intersect(x.ws, rw.ws))::DOUBLE / len(rw.ws) AS score FROM x, rw WHERE len(rw.ws) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rule_id) AS rank FROM s WHERE score >= 0.5) SELECT doc_id, rule_id, score, rank::INT AS rank FROM k WHERE rank <= 3""")
def content_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = described(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.concat("description", F.lit(" for the staff")).alias("text"))
    return documents.suggestions(texts, spark.createDataFrame(list(enumerate(PHRASES)), "rule_id bigint, key string"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS match_key, event_type AS value, event_id AS seq FROM events), l AS (SELECT match_key, arg_max(value, seq) AS value FROM e GROUP BY 1),
t AS (SELECT e.match_key, l.value, coalesce(max(seq) FILTER (e.value <> l.value), -1) AS turn FROM e JOIN l USING (match_key) GROUP BY 1, 2),
c AS (SELECT t.match_key, t.value, count(*) FILTER (e.value = t.value AND seq > turn) AS confirm_count, count(*) AS n_events FROM e JOIN t USING (match_key) GROUP BY 1, 2)
SELECT 'user' AS rule_type, *, CASE WHEN confirm_count >= 2 THEN 'active' ELSE 'pending' END AS status FROM c""")
def learned_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.lit("user").alias("rule_type"), F.col("user_id").cast("string").alias("match_key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return documents.learned(events)


@query("""WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS h, 'no ' || (doc_id % 150) AS no FROM documents), k AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS mh, min(doc_id) OVER (PARTITION BY no) AS mn FROM d)
SELECT doc_id, CASE WHEN mh < doc_id THEN mh WHEN mn < doc_id THEN mn ELSE -1 END AS duplicate_of FROM k""")
def duplicate_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"), F.concat(F.lit("No. "), (F.col("doc_id") % 150).cast("string")).alias("invoice_no"))
    return documents.duplicates(d).select("doc_id", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


@query("SELECT user_id::VARCHAR AS file_hash, arg_max(event_type, event_id) AS value, max(event_id) AS rev FROM events GROUP BY 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.latest(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_hash"), F.col("event_id").alias("rev"), F.col("event_type").alias("value"))).select("file_hash", "value", "rev")


@query("""WITH v AS (SELECT user_id::VARCHAR AS file_hash, max(event_id) AS rev FROM events GROUP BY 1), e AS (SELECT user_id::VARCHAR AS file_hash, event_id AS base_rev FROM events WHERE event_type = 'signup')
SELECT file_hash, base_rev, rev FROM e JOIN v USING (file_hash) WHERE base_rev <> rev""")
def optimistic_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_hash"), F.col("event_id").alias("rev"), "event_type")
    return documents.stale_edits(e.where("event_type = 'signup'").select("file_hash", F.col("rev").alias("base_rev")), e)


@query("SELECT event_id AS seq, user_id::VARCHAR AS file_hash, event_type AS field, CAST(value AS DECIMAL(18,2))::VARCHAR AS value, coalesce(lag(CAST(value AS DECIMAL(18,2))::VARCHAR) OVER (PARTITION BY user_id, event_type ORDER BY event_id), '') AS old FROM events")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("file_hash"), F.col("event_type").alias("field"), F.col("value").cast("decimal(18,2)").cast("string").alias("value"))
    return documents.audit_trail(e).withColumn("old", F.coalesce("old", F.lit("")))


@query("""WITH s(status) AS (VALUES ('Pending'), ('Approved'), ('Rejected'), ('Hold'), ('Reconciled')), c AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Pending' ELSE 'Hold' END AS status, count(*) AS n FROM orders GROUP BY 1)
SELECT status, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (status)""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Approved").when(F.col("o_orderstatus") == "P", "Hold")
    return documents.status_counts(table(spark, sf_dir, "orders").select(status.alias("status")), ["Pending", "Approved", "Rejected", "Hold", "Reconciled"])


@query("SELECT o_orderkey AS doc_id FROM orders ORDER BY o_orderkey % 9 = 0 DESC, o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 100")
def review_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 9 == 0).alias("needs_fix"), F.col("o_orderdate").alias("uploaded"))
    return documents.review_page(o, 1, 100).select("doc_id")


@query(f"WITH {_TXN} SELECT event_id, stmt, idx FROM t ORDER BY stmt DESC, idx DESC LIMIT 50")
def recent_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_txns(spark, sf_dir).select("event_id", "stmt", "idx").orderBy(F.desc("stmt"), F.desc("idx")).limit(50)


# ---- extraction


@query(rf"""SELECT doc_id, regexp_extract(coalesce(text, ''), '{text.EMAIL}') AS email, regexp_extract(coalesce(text, ''), '{text.PHONE}') AS phone FROM documents""")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract(t, text.EMAIL, 0).alias("email"), F.regexp_extract(t, text.PHONE, 0).alias("phone"))


_WALLET = "CASE doc_id % 5 WHEN 0 THEN ' pay to 0x' || left(md5(doc_id::VARCHAR) || md5(doc_id::VARCHAR), 40) WHEN 1 THEN ' IBAN DE' || lpad((doc_id % 97)::VARCHAR, 2, '0') || '500105175407324931' WHEN 2 THEN ' SWIFT: DEUTDEFF500 and 0x' || left(md5(doc_id::VARCHAR) || md5(doc_id::VARCHAR), 40) ELSE '' END"


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') || {_WALLET} AS s FROM documents),
a AS (SELECT doc_id, 'EVM' AS kind, lower(unnest(regexp_extract_all(s, '{text.EVM}'))) AS target FROM t UNION SELECT doc_id, 'IBAN', unnest(regexp_extract_all(s, '{text.IBAN}')) FROM t UNION SELECT doc_id, 'SWIFT', unnest(regexp_extract_all(s, '{text.SWIFT}', 1)) FROM t)
SELECT * FROM a""")
def payment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    wallet = F.substring(F.concat(F.md5(F.col("doc_id").cast("string").cast("binary")), F.md5(F.col("doc_id").cast("string").cast("binary"))), 1, 40)
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, F.concat(F.lit(" pay to 0x"), wallet)).when(k == 1, F.concat(F.lit(" IBAN DE"), F.lpad((F.col("doc_id") % 97).cast("string"), 2, "0"), F.lit("500105175407324931"))).when(k == 2, F.concat(F.lit(" SWIFT: DEUTDEFF500 and 0x"), wallet)).otherwise("")
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("s"))
    each = lambda kind, pattern, group, low: F.transform(F.regexp_extract_all("s", F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("kind"), (F.lower(x) if low else x).alias("target")))
    found = F.array_distinct(F.concat(each("EVM", text.EVM, 0, True), each("IBAN", text.IBAN, 0, False), each("SWIFT", text.SWIFT, 1, False)))
    return t.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


@query(r"""SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\pL\pN_]', '', 'g')) AS key FROM documents""")
def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_key(F.coalesce("text", F.lit(""))).alias("key"))


# ---- layout


def words_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of orders as words: a page per hundred, four words to a line."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    k = F.col("p_partkey")
    return p.select((k % 100).alias("doc_id"), (k % 3).alias("page"), ((k % 4) * 60.0).alias("x0"), (F.floor(k / 400) * 12.0 + (k % 2)).alias("y0"), ((k % 4) * 60.0 + 40.0).alias("x1"), (F.floor(k / 400) * 12.0 + 9.0).alias("y1"), F.concat(F.col("p_brand"), F.lit("/"), k.cast("string")).alias("text"))


_WORDS = "w AS (SELECT p_partkey % 100 AS doc_id, p_partkey % 3 AS page, (p_partkey % 4) * 60.0::DOUBLE AS x0, (p_partkey // 400) * 12.0::DOUBLE + (p_partkey % 2) AS y0, (p_partkey % 4) * 60.0::DOUBLE + 40.0 AS x1, (p_partkey // 400) * 12.0::DOUBLE + 9.0 AS y1, p_brand || '/' || p_partkey AS text FROM part)"


@query(f"""WITH {_WORDS}, s AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, x0) <= 3 THEN 0 ELSE 1 END AS st FROM w),
n AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page ORDER BY y0, x0) AS line FROM s) SELECT doc_id, page, line::BIGINT AS line, min(y0) AS y, string_agg(text, ' ' ORDER BY x0, text) AS text FROM n GROUP BY 1, 2, 3""")
def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(words_on_pages(spark, sf_dir))


@query(f"""WITH {_WORDS}, r AS (SELECT unnest(range(100)) AS doc_id) SELECT r.doc_id AS region_id, string_agg(text, ' ' ORDER BY y0, x0, text) AS text FROM w JOIN r USING (doc_id) WHERE page = 1 AND x0 < 130 AND x1 > 10 AND y0 < 30 AND y1 > 5 GROUP BY 1""")
def word_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.range(100).select(F.col("id").alias("region_id"), F.col("id").alias("doc_id"), F.lit(1).cast("bigint").alias("page"), F.lit(10.0).alias("rx0"), F.lit(5.0).alias("ry0"), F.lit(130.0).alias("rx1"), F.lit(30.0).alias("ry1"))
    return layout.region_text(words_on_pages(spark, sf_dir), regions)


# ---- statement formats: the bank transactions are written in a format and read back


def _files(spark: SparkSession, sf_dir: str, record, head: str = "", tail: str = "", between: str = "") -> DataFrame:
    """A file per statement, of the records in order."""
    t = bank_txns(spark, sf_dir).withColumn("signed", F.when(F.col("incoming"), F.col("amount")).otherwise(-F.col("amount")).cast("decimal(18,2)"))
    rows = t.groupBy(F.col("stmt").alias("file")).agg(F.array_sort(F.collect_list(F.struct("idx", record(t).alias("r")))).alias("rs"))  # the rows of one file
    return rows.select("file", F.concat(F.lit(head), F.array_join(F.transform("rs", lambda x: x["r"]), between), F.lit(tail)).alias("content"))


_BACK = f"WITH {_TXN} SELECT stmt AS file, idx, date, {dec('CASE WHEN incoming THEN amount ELSE -amount END')} AS amount, description FROM t"


def _back(read: DataFrame) -> DataFrame:
    return read.select("file", F.col("idx").cast("long").alias("idx"), "date", F.col("amount").cast("decimal(38,2)").alias("amount"), "description")


@query(_BACK)
def statement_roundtrip_mt940(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: F.concat(F.lit(":61:"), F.date_format("date", "yyMMdd"), F.when(F.col("incoming"), "C").otherwise("D"), F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")), F.lit("NTRF\n:86:"), F.col("description"), F.lit("\n"))
    return _back(statements.mt940(_files(spark, sf_dir, one, ":20:S1\n:25:ACC1\n:60F:C240101EUR1000,00\n", ":62F:C240131EUR0,00\n")))


@query(_BACK)
def statement_roundtrip_ofx(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: F.concat(F.lit("<STMTTRN><TRNTYPE>X<DTPOSTED>"), F.date_format("date", "yyyyMMdd"), F.lit("120000<TRNAMT>"), F.col("signed").cast("string"), F.lit("<FITID>"), F.col("event_id").cast("string"), F.lit("<NAME>"), F.col("description"), F.lit("</STMTTRN>\n"))
    return _back(statements.ofx(_files(spark, sf_dir, one, "<OFX>\n", "</OFX>")))


@query(_BACK)
def statement_roundtrip_qif(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: F.concat(F.lit("D"), F.date_format("date", "MM/dd/yyyy"), F.lit("\nT"), F.col("signed").cast("string"), F.lit("\nP"), F.col("description"), F.lit("\n^\n"))
    return _back(statements.qif(_files(spark, sf_dir, one, "!Type:Bank\n")))


@query(_BACK)
def statement_roundtrip_camt(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: F.concat(F.lit('<Ntry><Amt Ccy="EUR">'), F.col("amount").cast("string"), F.lit("</Amt><CdtDbtInd>"), F.when(F.col("incoming"), "CRDT").otherwise("DBIT"), F.lit("</CdtDbtInd><BookgDt><Dt>"), F.col("date").cast("string"), F.lit("</Dt></BookgDt><Ustrd>"), F.col("description"), F.lit("</Ustrd></Ntry>"))
    return _back(statements.camt(_files(spark, sf_dir, one, "<Stmt>", "</Stmt>")))


@query(_BACK)
def statement_roundtrip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: F.concat(F.lit("<tr><td>"), F.col("date").cast("string"), F.lit("</td><td><b>"), F.col("description"), F.lit("</b></td><td>"), F.col("signed").cast("string"), F.lit("</td></tr>"))
    return _back(statements.html_statement(_files(spark, sf_dir, one, "<table><tr><td>x</td></tr><tr><th>Posting Date</th><th>Narrative</th><th>Amount</th></tr>", "</table>")))


@query(_BACK)
def statement_roundtrip_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda when: F.format_string("%12s", F.when(when, F.col("amount")).otherwise(F.lit("0.00").cast("decimal(18,2)")).cast("string"))
    one = lambda t: F.concat(F.rpad(F.concat(F.lit("TX"), F.col("event_id").cast("string")), 12, " "), F.col("date").cast("string"), F.lit(" "), F.col("date").cast("string"), F.lit(" EUR"), part(~F.col("incoming")), part(F.col("incoming")), F.format_string("%14s", F.col("balance").cast("decimal(18,2)").cast("string")), F.lit(" "), F.col("description"), F.lit("\n"))
    return _back(statements.fixed_width(_files(spark, sf_dir, one, "ID DATE\n")))


# ---- amounts as they were read


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderkey % 2 = 0 AS seen, floor(o_totalprice)::BIGINT AS n FROM orders)
SELECT o_orderkey, CASE k WHEN 1 THEN 'DECIMAL_NONSTANDARD:error' WHEN 2 THEN 'DECIMAL_MISSING:warning' WHEN 3 THEN 'DECIMAL_NONSTANDARD:warning' WHEN 4 THEN 'AMOUNT_FORMAT:error,DECIMAL_MISSING:warning' WHEN 5 THEN 'AMOUNT_SUSPICIOUS:warning' ELSE '' END
  || CASE WHEN seen THEN ',DECIMAL_NONSTANDARD:info' ELSE ',DECIMAL_NONSTANDARD:warning' END AS issues FROM r""")
def amount_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of each order with two, one, no and three decimals, as words, and with a letter for a digit; beside it one of four decimals that a second reading of every other order confirms."""
    k, n = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    raw = F.when(k % 6 == 0, F.concat(n, F.lit(".25"))).when(k % 6 == 1, F.concat(n, F.lit(".5"))).when(k % 6 == 2, n).when(k % 6 == 3, F.concat(n, F.lit(".125"))).when(k % 6 == 4, "to be agreed").otherwise(F.concat(n, F.lit("O.00")))
    fine = F.concat(n, F.lit(".0415"))
    second = F.when(k % 2 == 0, F.concat(F.lit("paid $ "), fine, F.lit(" only")))
    found = documents.amount_issues({"total_due": raw, "payment_due": fine}, second)
    text = F.array_join(F.transform("i", lambda x: F.concat(x["code"], F.lit(":"), x["severity"])), ",")
    # the first field of some orders is in order: a comma before the second one's issue shows it
    return table(spark, sf_dir, "orders").select(k, found.alias("i")).select("o_orderkey", F.when(k % 6 == 0, F.concat(F.lit(","), text)).otherwise(text).alias("issues"))


@query(f"""WITH {ORACLE_INVOICES} SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'TOTAL_MISMATCH' WHEN 3 THEN '' ELSE 'TOTAL_ADJUSTED' END AS issues FROM inv""")
def adjusted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discount that the total does not name, one on its line, two that add up on the lines below, and none."""
    k = F.col("o_orderkey") % 4
    off = F.lit("12.30").cast("decimal(18,2)")
    said = F.when(k == 0, "Discount of ten% given\nnothing").when(k == 1, "Items 99.00\nDiscount (10%) -$12.30").when(k == 2, "Deposit paid\n$10.00\nRounding\n2.30").otherwise("Shipping\nfree")
    inv = invoices(spark, sf_dir).withColumn("adjustments", documents.adjustments(said))
    gap = F.col("total") - F.when(k < 3, off).otherwise(F.lit(0).cast("decimal(18,2)"))
    none = F.lit(None)
    docs = inv.select("o_orderkey", "subtotal", "tax", gap.cast("decimal(18,2)").alias("total"), none.cast("decimal(18,2)").alias("payment_due"), none.cast("string").alias("tax_rate"), "adjustments", F.array().cast("array<decimal(18,2)>").alias("line_amounts"), "invoice_no", F.col("date").alias("invoice_date"), F.col("party").alias("issuer"), none.cast("string").alias("customer"), none.cast("string").alias("symbol"), "currency", F.lit(False).alias("date_ambiguous"), none.cast("string").alias("duplicate_of"), F.lit(1).alias("n_targets"))
    codes = F.filter(F.transform(documents.issues(), lambda x: x["code"]), lambda c: c.startswith("TOTAL"))
    return docs.select("o_orderkey", F.array_join(codes, ",").alias("issues"))
