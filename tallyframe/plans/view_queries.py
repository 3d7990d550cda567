"""Views, cell readings and guards over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import cells, money
from tallyframe.operators import accounts, ledger, views
from tallyframe.plans.adapters import ORACLE_INVOICES, ORACLE_JOURNAL, RATES, dec, fx_rates, invoices, journal, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pick(values: list[str | None], by: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def _sql_pick(values: list[str | None], by: str) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][{by} % {len(values)} + 1]"


MARKS = [" Cr", " DR.", "", "cr", "  dr ", " credit", " Dr"]


@query(f"""WITH r AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END) || CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR || {_sql_pick(MARKS, 'o_orderkey')} AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(trim(s), '(?i)\\b(cr|dr)\\.?\\s*$') THEN trim(regexp_replace(trim(s), '(?i)\\b(cr|dr)\\.?\\s*$', '')) ELSE s END AS text,
  nullif(lower(regexp_extract(trim(s), '(?i)\\b(cr|dr)\\.?\\s*$', 1)), '') AS mark FROM r""")
def amount_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of each order, with a mark or something else behind it."""
    k = F.col("o_orderkey")
    raw = F.concat(F.when(k % 2 == 0, " ").otherwise(""), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), _pick(MARKS, "o_orderkey"))
    return table(spark, sf_dir, "orders").select(k, cells.strip_mark(raw).alias("m")).select("o_orderkey", "m.text", "m.mark")


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


FLOW_WORDS = [*cells.INCOME_WORDS, *cells.EXPENSE_WORDS]


@query(f"""WITH w AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN ' ' || upper({_sql_pick(FLOW_WORDS, '(event_id // 3)')}) ELSE substr({_sql_pick(FLOW_WORDS, '(event_id // 3)')} || event_type, 1, 1 + (event_id // 7 % 6)::INT) END AS raw FROM events)
SELECT event_id, CASE WHEN list_contains({_sql_list(cells.INCOME_WORDS)}, lower(trim(raw))) THEN 'in' WHEN list_contains({_sql_list(cells.EXPENSE_WORDS)}, lower(trim(raw))) THEN 'out' END AS flow FROM w""")
def direction_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each event, a word of direction in capitals, or the beginning of both run together."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    word = F.element_at(F.array(*map(F.lit, FLOW_WORDS)), (F.expr("event_id div 3") % len(FLOW_WORDS) + 1).cast("int"))
    part = F.substring(F.concat(word, "event_type"), F.lit(1), (1 + F.expr("event_id div 7") % 6).cast("int"))
    raw = F.when(k % 3 == 0, F.col("event_type")).when(k % 3 == 1, F.concat(F.lit(" "), F.upper(word))).otherwise(part)
    return e.select(k, cells.flow(raw).alias("flow"))


@query("""WITH r AS (SELECT doc_id, replace(replace(translate(text, 'ae', CASE doc_id % 3 WHEN 0 THEN chr(160) || chr(8208) WHEN 1 THEN chr(8239) || chr(8209) ELSE 'ae' END), 'o', 'o' || chr(8203)), 'u', chr(8288) || 'u') AS s FROM documents)
SELECT doc_id, replace(replace(translate(s, chr(160) || chr(8199) || chr(8239) || chr(8208) || chr(8209) || chr(8210), '   ---'), chr(8288), ''), chr(8203), '') AS text FROM r""")
def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their letters a and e exchanged for blanks and hyphens of other kinds, and characters of no width beside o and u."""
    k = F.col("doc_id") % 3
    odd = F.when(k == 0, F.translate("text", "ae", "\u00a0\u2010")).when(k == 1, F.translate("text", "ae", "\u202f\u2011")).otherwise(F.col("text"))
    odd = F.replace(F.replace(odd, F.lit("o"), F.lit("o\u200b")), F.lit("u"), F.lit("\u2060u"))
    return table(spark, sf_dir, "documents").select("doc_id", cells.plain_text(odd).alias("text"))


LABEL_HEADS = ["Sub-", "Grand ", "Net ", "", "VAT ", "Sales ", "Copy ", "PAID ", "ORIG ", "Tax ", "Delivery ", "Not for ", "合计 "]
LABEL_TAILS = ["total:", "total (USD)", "tax 20%", "payment", "COPY", "amount due", "", "DUPLICATE!", "fees EUR", "advisory", "专用章", "charge 5"]
_WORDS_OF = r"regexp_extract_all(lower({0}), '\p{{L}}+')"


@query(rf"""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN {_sql_pick(LABEL_HEADS, '(p_partkey // 4)')} || p_type ELSE {_sql_pick(LABEL_HEADS, '(p_partkey // 4)')} || {_sql_pick(LABEL_TAILS, '(p_partkey // 7)')} END AS s FROM part),
b AS (SELECT *, regexp_replace(regexp_replace(s, '[（(][^()（）]*[)）]', ' ', 'g'), '\d+(?:\.\d+)?\s*%', ' ', 'g') AS bare FROM r),
w AS (SELECT *, list_filter({_WORDS_OF.format('bare')}, lambda x: NOT list_contains({_sql_list(cells.CODES)}, x)) AS sums, {_WORDS_OF.format('s')} AS words FROM b),
t AS (SELECT *, list_filter(words, lambda x: list_contains({_sql_list(cells.STAMP_WORDS)}, x)) AS stamps, list_filter(words, lambda x: len(list_filter({_sql_list(cells.SEAL_ENDINGS)}, lambda e: ends_with(x, e))) > 0) AS seals FROM w)
SELECT p_partkey, NOT regexp_matches(bare, '\d') AND len(list_filter(sums, lambda x: list_contains({_sql_list(cells.SUM_CORE)}, x))) > 0 AND len(list_filter(sums, lambda x: NOT list_contains({_sql_list(cells.SUM_CORE + cells.SUM_BESIDE)}, x))) = 0 AS summary,
  regexp_matches(lower(s), '^\W*not\s+for\s+payment\W*$')
  OR (len(stamps) > 0 AND len(list_filter(words, lambda x: NOT list_contains({_sql_list(cells.STAMP_WORDS)}, x) AND NOT (length(x) >= {cells.CUT_OFF} AND len(list_filter({_sql_list(cells.STAMP_WORDS)}, lambda y: starts_with(y, x))) > 0))) = 0)
  OR (len(seals) > 0 AND length(array_to_string(seals, '')) + length(array_to_string(stamps, '')) >= {cells.SEALED} * length(array_to_string(words, ''))) AS stamp FROM t""")
def no_item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, their types behind the beginnings of labels, and beginnings and ends of labels put together."""
    k = F.col("p_partkey")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.expr(f"p_partkey div {by}") % len(words) + 1).cast("int"))
    s = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat(pick(LABEL_HEADS, 4), "p_type")).otherwise(F.concat(pick(LABEL_HEADS, 4), pick(LABEL_TAILS, 7)))
    return table(spark, sf_dir, "part").select(k, cells.is_summary(s).alias("summary"), cells.is_stamp(s).alias("stamp"))


_LEAD_FORMATS = [("yyyy-MM-dd", "%Y-%m-%d"), ("d MMMM yyyy", "%-d %B %Y"), ("MMMM d, yyyy", "%B %-d, %Y"), ("dd-MMM-yyyy", "%d-%b-%Y"), ("yyyy/M/d", "%Y/%-m/%-d")]


@query("WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate::DATE, '{f}')" for i, (_, f) in enumerate(_LEAD_FORMATS)) + """ END AS said, 'paid ' || o_orderpriority AS rest FROM orders)
SELECT o_orderkey, CASE WHEN said IS NOT NULL THEN d END AS date, said AS words, CASE WHEN o_orderkey % 7 = 0 AND said IS NOT NULL THEN '' WHEN said IS NULL AND o_orderkey % 7 = 0 THEN 'undated' ELSE rest END AS rest FROM o""")
def leading_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each order in one of five forms, or none, before words about its priority, or nothing."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    said = F.coalesce(*[F.when(k % 6 == i, F.date_format(day, f)) for i, (f, _) in enumerate(_LEAD_FORMATS)])
    rest = F.when(k % 7 != 0, F.concat(F.lit("paid "), "o_orderpriority"))
    cell = F.when(said.isNull() & rest.isNull(), "undated").otherwise(F.concat_ws(" ", said, rest))
    # a table of one row group would be one task
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority").repartition("o_orderkey")
    return orders.select(k, cells.leading_date(cell).alias("d")).select("o_orderkey", F.col("d.value").alias("date"), "d.words", "d.rest")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders)
SELECT o_orderkey, CAST(CASE k WHEN 2 THEN -a WHEN 3 THEN -a WHEN 4 THEN o_orderkey % 1000 WHEN 5 THEN NULL ELSE a END AS DECIMAL(28,6)) AS value FROM o""")
def lenient_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of each order as people type it: with a code and a sign, behind words, in brackets, with a minus after a sign, a count of things, and nothing of the kind."""
    k, a = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    shown = F.format_number(a, 2)
    typed = F.when(k % 6 == 0, F.concat(F.lit("US$ "), shown)).when(k % 6 == 1, F.concat(F.lit("about "), shown, F.lit(" or so"))).when(k % 6 == 2, F.concat(F.lit("("), shown, F.lit(")"))).when(k % 6 == 3, F.concat(F.lit("HK$-"), shown)).when(k % 6 == 4, F.concat((k % 1000).cast("string"), F.lit(" units"))).otherwise(F.lit("n/a"))
    return table(spark, sf_dir, "orders").select(k, cells.lenient_amount(typed).alias("value"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate::DATE, '%d.%m.%y') END AS raw, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders)
SELECT o_orderkey, array_to_string(list_filter([raw, strftime(d, '%Y-%m-%d'), strftime(d, '%Y%m%d'), strftime(d, '%Y/%m/%d'), strftime(d, '%d/%m/%Y'), strftime(d, '%m/%d/%Y'), strftime(d, '%y%m%d')], lambda x: x IS NOT NULL), ' ') AS dates,
  a::VARCHAR || ' ' || replace(a::VARCHAR, '.', ',') AS amounts FROM d""")
def search_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "dd.MM.yy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(cells.date_variants(day, raw), " ").alias("dates"), F.array_join(cells.amount_variants(-money.money("o_totalprice")), " ").alias("amounts"))


# ---- documents: an order stands for a document, its items for lines


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices cut from the batches of a customer, with lines and issues."""
    inv = invoices(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem")
    line = F.struct(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description"), F.when(F.col("l_linenumber") % 3 != 0, money.money("l_extendedprice")).alias("amount"))
    lines = items.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda s: s["x"]).alias("lines"))  # an order has seven items at most
    issue = lambda s: F.struct(F.lit(s).alias("severity"))
    k = F.col("o_orderkey")
    issues = F.filter(F.array(F.when(k % 7 == 0, issue("error")), F.when(k % 3 == 0, issue("warning")), F.when(k % 11 == 0, issue("critical"))), lambda x: x.isNotNull())
    joined = inv.join(lines, inv["o_orderkey"] == lines["l_orderkey"], "left")
    return joined.select("o_orderkey", "hash", F.lit("invoice").alias("doc_type"), "status", F.col("party").alias("issuer"), F.col("invoice_no").alias("number"), "date", "currency", "total", F.lit("Sales").alias("category"), F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"), issues.alias("issues"), F.col("party").alias("source_hash"), k.alias("position"))


_SEG = f"WITH {ORACLE_INVOICES}, s AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY o_orderkey) - 1 AS segment_index, count(*) OVER (PARTITION BY party) AS segment_total FROM inv)"


@query(f"{_SEG} SELECT hash, segment_index::BIGINT AS segment_index, segment_total FROM s")
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.segments(_documents(spark, sf_dir)).select("hash", F.col("segment_index").cast("long").alias("segment_index"), "segment_total")


@query(f"{_SEG} SELECT a.hash, b.hash AS sibling, b.segment_index::BIGINT AS segment_index FROM s a JOIN s b ON a.party = b.party WHERE a.total > 30000000")
def document_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.segments(_documents(spark, sf_dir))
    return views.siblings(docs, docs.where("total > 300000")).withColumn("segment_index", F.col("segment_index").cast("long"))


@query(f"""WITH {ORACLE_INVOICES}, n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT *, (o_orderkey % 7 = 0)::INT + (o_orderkey % 11 = 0)::INT AS sev, (o_orderkey % 3 = 0)::INT AS warn FROM inv)
SELECT hash, 'invoice' AS doc_type, status, party AS issuer, invoice_no AS number, strftime(d, '%Y-%m-%d') AS date, currency, CAST(CAST(total AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))::VARCHAR AS total, 'Sales' AS category,
  coalesce(n, 0)::INT AS n_lines, sev + warn AS n_issues, sev AS n_severe, sev > 0 AS needs_fix, 0 AS segment_index, 1 AS segment_total FROM c LEFT JOIN n ON l_orderkey = o_orderkey""")
def document_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("int")
    return views.display(_documents(spark, sf_dir).withColumns({"segment_index": null, "segment_total": null}))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def document_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.count_documents(_documents(spark, sf_dir), "Approved", "invoice")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, 'part ' || l_partkey AS d, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS a FROM lineitem)
SELECT o_orderkey, coalesce(CASE WHEN max(a) IS NOT NULL THEN max_by(d, a) ELSE string_agg(d, ' ' ORDER BY l_linenumber, d) END, '') AS dominant FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def dominant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("o_orderkey", views.dominant_description(F.col("lines")).alias("dominant"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) > 0 AS has_detail, CAST(s AS DECIMAL(28,3)) AS sub_sum, coalesce(abs(s - CAST(o_totalprice AS DECIMAL(18,2))) <= CASE WHEN o_orderkey % 2 = 1 THEN 0.001 ELSE 0.01 END, false) AS matched FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def sub_item_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(money.money("l_extendedprice")).alias("sub_amounts"))  # an order has seven items at most
    o = table(spark, sf_dir, "orders")
    lines = o.join(items, o["o_orderkey"] == items["l_orderkey"], "left").select("o_orderkey", money.money("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 2 == 1, 3).otherwise(2).alias("places"), F.coalesce("sub_amounts", F.array().cast("array<decimal(18,2)>")).alias("sub_amounts"))
    return views.sub_item_check(lines).select("o_orderkey", "has_detail", "sub_sum", "matched")


_KEY = lambda c: f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]', '', 'g'), 's$', '')"


@query(f"""WITH l AS (SELECT l_orderkey AS hash, l_linenumber AS line_no, {_KEY('p_name')} AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT o_orderkey AS hash, {_sql_pick(['Part 1s', 'part 2 ', 'Items 3', 'Zinc Plates'], 'o_orderkey')} AS category, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)
SELECT s.hash, category, max(amount)::DECIMAL(38,2) AS sub_sum, 1::BIGINT AS n_rows, min(line_no) AS line_no FROM s LEFT JOIN l ON l.hash = s.hash AND l.k <> '' AND (contains(l.k, {_KEY('category')}) OR contains({_KEY('category')}, l.k)) GROUP BY 1, 2""")
def schedule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    lines = i.join(p, i["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("hash"), F.col("l_linenumber").alias("line_no"), F.col("p_name").alias("description"))
    groups = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), _pick(["Part 1s", "part 2 ", "Items 3", "Zinc Plates"], "o_orderkey").alias("category"), money.money("o_totalprice").alias("amount"))
    return views.attach_schedules(lines, groups)


@query("""WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 0.93 ELSE 1.0 END AS leg, o_orderkey % 6 <> 0 AS a, o_orderkey % 10 <> 0 AS b, CASE WHEN o_orderkey % 4 = 0 THEN 0.90 ELSE 0.97 END AS ca, 0.96 AS cb FROM orders),
e AS (SELECT *, (a::INT + b::INT) / 2.0 AS coverage, CASE WHEN a AND b THEN least(ca, cb) ELSE 0.0 END AS kc FROM d)
SELECT k AS o_orderkey, coverage::DOUBLE AS coverage, kc::DOUBLE AS key_confidence, CASE WHEN least(leg, coverage, kc) >= 0.98 THEN 'Excellent' WHEN least(leg, coverage, kc) >= 0.95 THEN 'Good' WHEN least(leg, coverage, kc) >= 0.90 THEN 'Warning' ELSE 'HighRisk' END AS grade FROM e""")
def document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    field = lambda there, sure: F.struct(F.when(there, F.lit("x")).alias("raw"), sure.alias("confidence"))
    fields = F.create_map(F.lit("number"), field(k % 6 != 0, F.when(k % 4 == 0, 0.90).otherwise(0.97)), F.lit("total"), field(k % 10 != 0, F.lit(0.96)))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 == 0, 0.93).otherwise(1.0).alias("legibility"), fields.alias("fields"))
    return views.confidence(docs, ["number", "total"], ["number", "total"]).select("o_orderkey", "coverage", "key_confidence", "grade")


@query("""WITH s AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS n, user_id % 3 <> 0 AS h, CASE WHEN user_id % 4 = 0 THEN 0.96 ELSE 1.0 END AS leg FROM events GROUP BY 1),
c AS (SELECT *, CASE WHEN n > 0 AND h THEN 1.0 WHEN n > 0 THEN 0.7 ELSE 0.0 END AS cov FROM s)
SELECT user_id, cov::DOUBLE AS coverage, CASE WHEN n > 0 THEN leg ELSE 0 END::DOUBLE AS key_confidence, CASE WHEN least(leg, cov) >= 0.98 THEN 'Excellent' WHEN least(leg, cov) >= 0.95 THEN 'Good' WHEN least(leg, cov) >= 0.90 THEN 'Warning' ELSE 'HighRisk' END AS grade FROM c""")
def statement_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("n_txns"))
    s = s.withColumns({"has_header": F.col("user_id") % 3 != 0, "legibility": F.when(F.col("user_id") % 4 == 0, 0.96).otherwise(1.0)})
    return views.statement_confidence(s).select("user_id", "coverage", "key_confidence", "grade")


# ---- statements: the events of a user


@query("""SELECT event_id, CAST(value AS DECIMAL(18,2)) AS amount, CASE WHEN event_type IN ('purchase', 'view') THEN 'in' ELSE 'out' END AS direction, CASE WHEN event_id % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency
FROM events WHERE event_type <> 'error'""")
def statement_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount, kind = money.money("value"), F.col("event_type")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(~kind.isin("purchase", "view", "error"), amount).alias("expense"), F.when(kind.isin("purchase", "view"), amount).alias("income"), F.when(F.col("event_id") % 3 == 0, F.lit("EUR")).alias("currency"), F.lit("USD").alias("header_currency"))
    return views.transactions(rows).select("event_id", "amount", "direction", "currency")


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as statements write them, by source day or month first; every thirteenth row is a title."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    raw = F.when(F.col("event_id") % 13 == 0, "=== March 2026 ===").when(F.col("user_id") % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    return e.select("event_id", F.col("user_id").alias("source"), raw.alias("raw"), day.alias("true_day"))


_RAW = """r AS (SELECT event_id, user_id AS source, ts::DATE AS d, event_id % 13 = 0 AS title, day(ts::DATE) AS dd, month(ts::DATE) AS mm FROM events),
f AS (SELECT source, bool_or(NOT title AND source % 2 = 0 AND dd > 12) AS a, bool_or(NOT title AND source % 2 = 1 AND dd > 12) AS b FROM r GROUP BY 1)"""


@query(f"WITH {_RAW} SELECT source, CASE WHEN a AND NOT b THEN true WHEN b AND NOT a THEN false END AS day_first FROM f")
def day_first_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.day_first(_dates(spark, sf_dir))


@query(f"""WITH {_RAW} SELECT event_id, CASE WHEN source % 2 = 0 AND NOT a AND dd <= 12 THEN make_date(year(d), dd, mm) ELSE d END AS date FROM r JOIN f USING (source) WHERE NOT title""")
def dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dated(_dates(spark, sf_dir)).select("event_id", "date")


@query("""WITH t AS (SELECT event_id, user_id AS stmt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, CAST(value AS DECIMAL(18,2)) AS v, event_type IN ('purchase', 'view') AS inc FROM events),
b AS (SELECT *, sum(CASE WHEN inc THEN v ELSE -v END) OVER (PARTITION BY stmt ORDER BY idx) AS bal, event_id % 4 = 0 AS lost FROM t),
s AS (SELECT *, bal - lag(bal) OVER (PARTITION BY stmt ORDER BY idx) AS step FROM b)
SELECT event_id, CAST(CASE WHEN lost THEN CASE WHEN step > 0 THEN step END WHEN inc THEN v END AS DECIMAL(38,2)) AS income, CAST(CASE WHEN lost THEN CASE WHEN step < 0 THEN -step END WHEN NOT inc THEN v END AS DECIMAL(38,2)) AS expense, lost AND coalesce(step <> 0, false) AS recovered FROM s""")
def recovered_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("stmt").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stmt"), "ts", money.money("value").alias("v"), F.col("event_type").isin("purchase", "view").alias("inc"))
    e = e.withColumn("idx", F.row_number().over(order)).withColumn("balance", F.sum(F.when(F.col("inc"), F.col("v")).otherwise(-F.col("v"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    there = F.col("event_id") % 4 != 0
    rows = e.withColumns({"income": F.when(there & F.col("inc"), F.col("v")), "expense": F.when(there & ~F.col("inc"), F.col("v"))})
    out = views.recovered_amounts(rows)
    return out.select("event_id", F.col("income").cast("decimal(38,2)").alias("income"), F.col("expense").cast("decimal(38,2)").alias("expense"), "recovered")


@query("""WITH l AS (SELECT user_id AS doc, event_id AS line_no, CASE event_id % 4 WHEN 0 THEN 'Invoice No:' WHEN 1 THEN '' ELSE 'v' || event_id END AS text FROM events),
n AS (SELECT *, lead(text) OVER (PARTITION BY doc ORDER BY line_no) AS value FROM l WHERE text <> '') SELECT doc, line_no, value FROM n WHERE text = 'Invoice No:'""")
def values_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("line_no"), F.when(k == 0, "Invoice No:").when(k == 1, "").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("text"))
    return views.value_below(lines, r"invoice\s*no\.?")


@query("""SELECT event_id, CAST(value AS DECIMAL(18,2)) AS amount, CASE WHEN event_type IN ('purchase', 'view') THEN 'in' ELSE 'out' END AS direction FROM events WHERE CAST(value AS DECIMAL(18,2)) > 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0""")
def open_statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    amount, inc = money.money("value"), F.col("event_type").isin("purchase", "view")
    key = [F.col("user_id").cast("string").alias("stmt_hash"), F.col("event_id").alias("index")]
    rows = e.select("event_id", *key, F.when(~inc, amount).alias("expense"), F.when(inc, amount).alias("income"))
    posted = e.where("event_id % 5 = 0").select(key)
    confirmed = e.where("event_id % 7 IN (0, 1)").select(*key, F.when(F.col("event_id") % 7 == 0, "reconciled").otherwise("no_invoice").alias("kind"))
    return views.open_statement_lines(rows, posted, confirmed).select("event_id", "amount", "direction")


# ---- lists in their order


@query("SELECT o_orderkey AS id, (floor(o_totalprice)::INT % 100)::INT AS match_score FROM orders")
def match_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.matches_in_order(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.floor("o_totalprice").cast("int") % 100).alias("match_score")))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'active' ELSE 'pending' END AS status, DATE '2024-01-01' + (p_partkey % 50)::INT AS confirmed_at FROM part")
def rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return views.rules_in_order(table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 0, "active").otherwise("pending").alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).alias("confirmed_at")))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS name FROM supplier")
def party_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.parties_in_order(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("name")))


@query("SELECT c_name AS raw, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def pending_party_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return views.counted_parties_in_order(o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_name").alias("raw")).agg(F.count("*").alias("count")))


@query("SELECT user_id AS stmt_hash, ts::DATE AS date, event_id AS index FROM events")
def statement_line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.statement_lines_in_order(table(spark, sf_dir, "events").select(F.col("user_id").alias("stmt_hash"), F.to_date("ts").alias("date"), F.col("event_id").alias("index")))


@query("SELECT user_id AS bank_name, min(ts)::DATE AS period_start, CASE WHEN user_id % 3 <> 0 THEN max(ts)::DATE END AS period_end FROM events GROUP BY 1")
def statement_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("bank_name")).agg(F.to_date(F.min("ts")).alias("period_start"), F.to_date(F.max("ts")).alias("end"))
    return views.statements_in_order(s.select("bank_name", "period_start", F.when(F.col("bank_name") % 3 != 0, F.col("end")).alias("period_end")))


@query(f"WITH {ORACLE_JOURNAL} SELECT DISTINCT entry_id AS entry_no, strftime(d, '%Y-%m') AS period FROM jl WHERE kind = 'settlement'")
def entry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = journal(spark, sf_dir).where("source_kind = 'settlement'")
    return views.entries_in_order(lines.select(F.col("entry_id").alias("entry_no"), ledger.period(F.col("entry_date")).alias("period")).distinct())


# ---- matches and rules


@query("""SELECT o_orderkey AS id, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) FILTER (l_linenumber % 2 = 1), '') AS invoices, count(l_linenumber) FILTER (l_linenumber % 2 = 0) AS n_txns FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def match_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.when(F.col("l_linenumber") % 2 == 1, "invoice").otherwise("txn").alias("kind"), F.col("l_partkey").cast("string").alias("hash"), F.col("l_linenumber").alias("index"))
    out = views.match_members(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), members)
    return out.select("id", F.array_join("invoices", ",").alias("invoices"), F.size("txns").cast("long").alias("n_txns"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS pool_invoices, (SELECT count(*) FROM events) AS pool_transactions, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS fix_invoices, 0::BIGINT AS fix_statements")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return views.pool_summary(o.where("o_orderstatus = 'F'"), table(spark, sf_dir, "events"), o.where("o_orderstatus = 'P'").select(F.lit("invoice").alias("doc_type")))


@query("""WITH r AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'classification' WHEN 1 THEN 'content_class' ELSE 'field_locator' END AS t, nullif('c' || (p_partkey % 9), 'c4') AS c, 'a' || (p_partkey % 4) AS a FROM part),
b AS (SELECT 'c1' AS c, 'a1' AS a, 0 AS ord UNION ALL SELECT 'seed', 'a9', 1 UNION ALL SELECT coalesce(c, ''), a, 1073741824 FROM r WHERE t <> 'field_locator') SELECT c AS category, a AS account, min(ord)::INT AS ord FROM b GROUP BY 1, 2""")
def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rules = table(spark, sf_dir, "part").select(F.when(k % 3 == 0, "classification").when(k % 3 == 1, "content_class").otherwise("field_locator").alias("rule_type"), F.when(k % 9 != 4, F.concat(F.lit("c"), (k % 9).cast("string"))).alias("category"), F.concat(F.lit("a"), (k % 4).cast("string")).alias("account"))
    seeds = spark.createDataFrame([("c1", "a1", 0), ("seed", "a9", 1)], "category string, account string, ord int")
    return views.class_pairs(seeds, rules)


_LOCATORS = [(1, "global", "", ""), (2, "issuer", "Customer#000000001", "f1"), (3, "issuer", "Customer#000000002", "f2"), (4, "issuer", "", "f3"), (5, "issuer", "Customer#000000005", "")]


@query(f"""WITH {ORACLE_INVOICES}, g(id, scope, k, f) AS (VALUES {', '.join(map(str, _LOCATORS))}), x AS (SELECT hash, party, 'f' || (o_orderkey % 5) AS fp FROM inv)
SELECT DISTINCT hash, id FROM x, g WHERE id <> 5 AND (scope = 'global' OR (k <> '' AND k = party) OR (f <> '' AND f = fp))""")
def locators_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    locators = spark.createDataFrame([(*r, "pending" if r[0] == 5 else "active") for r in _LOCATORS], "id int, scope string, match_key string, account string, status string")
    docs = invoices(spark, sf_dir).select("hash", F.col("party").alias("issuer"), F.concat(F.lit("f"), (F.col("o_orderkey") % 5).cast("string")).alias("fingerprint"))
    return views.locators_for(docs, locators)


@query("""WITH r AS (SELECT p_partkey AS id, 'f' || (p_partkey % 20) AS match_key, CASE WHEN p_partkey % 3 = 0 THEN 'single' ELSE 'multi' END AS value, p_partkey % 7 AS n FROM part WHERE p_partkey % 5 <> 0)
SELECT match_key, arg_max(value, n * 1000000000 - id) AS value FROM r GROUP BY 1""")
def multi_invoice_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rules = table(spark, sf_dir, "part").select(k.alias("id"), F.lit("multi_invoice").alias("rule_type"), F.when(k % 5 == 0, "pending").otherwise("active").alias("status"), F.concat(F.lit("f"), (k % 20).cast("string")).alias("match_key"), F.when(k % 3 == 0, "single").otherwise("multi").alias("value"), (k % 7).alias("confirm_count"))
    return views.multi_invoice_prior(rules)


# ---- before posting

FILES = [".pdf", ".PDF", ".exe", ".csv", ""]


@query(f"""WITH f AS (SELECT o_orderkey, {_sql_pick(FILES, 'o_orderkey')} AS e, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS size, (o_orderkey % 300)::INT AS pages FROM orders)
SELECT o_orderkey, CASE WHEN lower(e) NOT IN ('.pdf', '.csv') THEN 'extension' WHEN size > 200000 THEN 'size' WHEN size <= 0 THEN 'empty' WHEN pages > 200 THEN 'pages' END AS refused FROM f""")
def upload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("in/x"), k.cast("string"), _pick(FILES, "o_orderkey")).alias("path"), F.when(k % 11 == 0, 0).otherwise(F.floor("o_totalprice")).alias("size"), (k % 300).cast("int").alias("pages"))
    return views.upload_guard(files, most_bytes=200_000, extensions=[".pdf", ".csv"], most_pages=200).select("o_orderkey", "refused")


_CHART_CODES = [c for c, *_ in accounts.CHART]


@query("WITH c(code, name) AS (VALUES " + ", ".join(f"('{c}', '{n.replace(chr(39), chr(39) * 2)}')" for c, n, *_ in accounts.CHART) + f"""),
r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {_sql_pick(_CHART_CODES, '(p_partkey // 4)')} || p_name WHEN 1 THEN '  ' || {_sql_pick(_CHART_CODES, '(p_partkey // 4)')} WHEN 2 THEN (1000 + p_partkey % 9000)::VARCHAR || ' ' || p_type ELSE p_name || ' ' END AS raw FROM part)
SELECT p_partkey, coalesce(code || ' ' || name, trim(raw)) AS account FROM r LEFT JOIN c ON code = regexp_extract(trim(raw), '^[0-9]+')""")
def canonical_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the chart before the names of parts, alone behind blanks, codes of any kind, and names without one."""
    k = F.col("p_partkey")
    code = F.element_at(F.array(*map(F.lit, _CHART_CODES)), (F.expr("p_partkey div 4") % len(_CHART_CODES) + 1).cast("int"))
    raw = F.when(k % 4 == 0, F.concat(code, "p_name")).when(k % 4 == 1, F.concat(F.lit("  "), code)).when(k % 4 == 2, F.concat((1000 + k % 9000).cast("string"), F.lit(" "), "p_type")).otherwise(F.concat("p_name", F.lit(" ")))
    return views.canonical_account(table(spark, sf_dir, "part").select(k, raw.alias("account")), accounts.chart(spark)).select("p_partkey", "account")


@query("""SELECT 'e' || o_orderkey AS entry_id, '1100' AS account FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0""")
def control_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("e"), k.cast("string")).alias("entry_id"), F.when(k % 2 == 0, "manual").otherwise("invoice").alias("source_kind"), F.when(k % 3 == 0, " ").otherwise("someone").alias("party"), F.explode(F.array(F.lit("1100"), F.lit("6602"))).alias("account"))
    return views.control_breaches(lines)


_RATE_ROWS = ", ".join(f"('{c}', DATE '{d}', CAST({r} AS DECIMAL(18,12)))" for c, d, r in RATES)


@query(f"""WITH {ORACLE_INVOICES}, rt(ccy, d0, rate) AS (VALUES {_RATE_ROWS}), q AS (SELECT inv.*, d + 10 AS day FROM inv WHERE status = 'Approved' AND total > 0 AND o_orderkey % 52 < 26),
z AS (SELECT q.*, CASE WHEN currency = 'USD' THEN day ELSE (SELECT max(d0) FROM rt WHERE ccy = q.currency AND d0 <= day) END AS eff FROM q),
y AS (SELECT z.*, CASE WHEN currency = 'USD' THEN CAST(1 AS DECIMAL(18,12)) ELSE rt.rate END AS rate FROM z LEFT JOIN rt ON ccy = currency AND d0 = eff WHERE eff IS NOT NULL),
c AS (SELECT *, CAST(round_even(CAST(total AS DECIMAL(20,0)) * rate, 0) AS BIGINT) AS t, CAST(round_even(CAST(total - tax AS DECIMAL(20,0)) * rate, 0) AS BIGINT) AS s FROM y)
SELECT hash AS source_id, account, {dec('dr')} AS debit, {dec('cr')} AS credit, (day - eff)::INT AS stale_days FROM
(SELECT hash, day, eff, unnest(['1100', '4000', '2210']) AS account, unnest([t, 0, 0]) AS dr, unnest([0, least(s, t), t - least(s, t)]) AS cr FROM c) WHERE dr <> 0 OR cr <> 0""")
def fx_accrual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = invoices(spark, sf_dir).where("status = 'Approved' AND o_orderkey % 52 < 26").withColumn("entry_day", F.date_add("date", 10))
    lines, _ = views.fx_accruals(inv, fx_rates(spark))
    return lines.select("source_id", "account", F.col("debit").cast("decimal(38,2)").alias("debit"), F.col("credit").cast("decimal(38,2)").alias("credit"), "stale_days")


@query(f"WITH {ORACLE_INVOICES} SELECT hash, {dec('total')} AS preview_total FROM inv WHERE status = 'Approved' AND o_orderkey % 3 <> 0 OR status = 'Approved' AND total <= 0")
def postable_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = invoices(spark, sf_dir)
    done = ledger.accruals(inv.where("status = 'Approved' AND o_orderkey % 3 = 0"))
    return views.postable(inv, done).select("hash", F.col("preview_total").cast("decimal(38,2)").alias("preview_total"))
