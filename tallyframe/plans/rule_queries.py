"""Rules learned from reviews, applied again to the orders that they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import rule_text
from tallyframe.operators import provenance
from tallyframe.plans.adapters import ORACLE_INVOICES, invoices, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all orders; currencies by key modulo 5: entered by hand, unreadable, sure, none, none."""
    inv = invoices(spark, sf_dir)
    k = F.col("o_orderkey") % 5
    no = F.struct(F.lit("invoice_no").alias("field"), F.lit("template").alias("source"), F.col("invoice_no").alias("raw"), F.col("invoice_no").alias("value"), F.lit(0.98).alias("confidence"))
    code = lambda source, raw, value, c: F.struct(F.lit("currency").alias("field"), F.lit(source).alias("source"), F.lit(raw).alias("raw"), F.lit(value).cast("string").alias("value"), F.lit(c).alias("confidence"))
    told = F.array_compact(F.array(no, F.when(k == 0, code("manual", "XXX", "XXX", 1.0)).when(k == 1, code("generic", "??", None, 0.5)).when(k == 2, code("generic", "YYY", "YYY", 0.96))))
    return inv.select(F.col("o_orderkey").alias("doc_id"), F.explode(told).alias("c")).select("doc_id", "c.*")


@query("""SELECT o_orderkey AS doc_id, unnest(['invoice_no', 'currency']) AS field, unnest(['INV-' || lpad(o_orderkey::VARCHAR, 8, '0'), CASE o_orderkey % 5 WHEN 0 THEN 'XXX' WHEN 2 THEN 'YYY' END]) AS value, unnest(['template', ['manual', 'generic', 'generic'][o_orderkey % 5 + 1]]) AS source
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 < 3 UNION ALL SELECT o_orderkey, 'invoice_no', 'INV-' || lpad(o_orderkey::VARCHAR, 8, '0'), 'template' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 >= 3""")
def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside each candidate stands one of a weaker source, and an unreadable one of a stronger source."""
    told = candidates(spark, sf_dir)
    weaker = told.where("value IS NOT NULL").withColumn("source", F.lit("recovered")).withColumn("value", F.lit("other")).withColumn("raw", F.lit("other"))
    broken = told.where("source <> 'manual'").withColumn("source", F.lit("learned_locator")).withColumn("value", F.lit(None).cast("string"))
    both = told.unionByName(weaker).unionByName(broken.where("field = 'invoice_no'"))
    return provenance.filled(both).select("doc_id", "field", "value", "source")


@query(f"""WITH {ORACLE_INVOICES}, d AS (SELECT inv.*, c_custkey AS c FROM inv JOIN customer ON party = c_name),
t AS (SELECT *, o_orderkey % 3 = 1 AS located, c % 7 <> 0 AS active FROM d WHERE status <> 'Approved' AND o_orderkey % 11 <> 0 AND c % 3 = 0 AND c % 2 = 0 AND o_orderkey % 5 NOT IN (0, 2))
SELECT o_orderkey AS doc_id, o_orderkey % 4 + 1 AS rev, currency AS value, CASE WHEN located THEN 'learned_locator' ELSE 'learned_default' END AS source, CASE WHEN located THEN 0.86 ELSE least(0.97, (88 + 2 * (c % 4 + 1)) / 100) END::DOUBLE AS confidence FROM t WHERE located OR active""")
def reapplied_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = invoices(spark, sf_dir)
    k = F.col("o_orderkey")
    docs = inv.select(k.alias("doc_id"), F.col("party").alias("issuer"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("fingerprint"), F.concat(F.lit("Invoice "), "invoice_no", F.lit("\nPaid in "), "currency", F.lit("\nthank you")).alias("text"), "status", (k % 11 == 0).alias("locked"), (k % 4).alias("rev"))
    told = candidates(spark, sf_dir)
    c = F.col("c_custkey")
    codes = inv.groupBy(F.col("party").alias("c_name")).agg(F.max("currency").alias("value"))
    defaults = table(spark, sf_dir, "customer").where(c % 3 == 0).join(codes, "c_name").select(
        F.lit("default").alias("kind"), F.lit("issuer").alias("scope"), F.col("c_name").alias("match_key"), F.lit("currency").alias("field"), "value", F.lit(None).cast("string").alias("label"), (c % 4 + 1).cast("int").alias("confirm_count"), F.when(c % 7 == 0, "pending").otherwise("active").alias("status"), F.when(c % 2 == 0, 10).otherwise(5).alias("at"))
    locator = spark.createDataFrame([("locator", "fingerprint", "p1", "currency", None, "Paid in", 2, "active", 5)], defaults.schema)
    found = provenance.reapplied(docs, told, told.select("doc_id", "field", "value"), defaults.unionByName(locator), F.lit(10), kinds={"currency": "code"}, required=("invoice_no", "currency"))
    own = F.try_element_at("fields", F.lit("currency"))
    return found.select("doc_id", "rev", own["value"].alias("value"), own["source"].alias("source"), F.col("least_confidence").alias("confidence"))


# ---- rules written as sentences

_FIELDS = [("币种", "currency"), ("税率", "tax_rate"), ("发票日期", "invoice_date"), ("invoice number", "invoice_no"), ("开票方地址", "issuer_address")]
_NAMES = "[" + ", ".join(f"'{a}'" for a, _ in _FIELDS) + "]"
_KEYS = "[" + ", ".join(f"'{b}'" for _, b in _FIELDS) + "]"


@query(f"""WITH r AS (SELECT p_partkey AS id, p_partkey % 4 AS k, replace(p_name, ' ', '_') || p_partkey AS who, p_type AS t, p_size AS s, {_KEYS}[p_partkey % 5 + 1] AS f, (4000 + p_partkey % 3000)::VARCHAR AS code FROM part)
SELECT id, CASE WHEN k IN (0, 1) THEN who END AS match_key, CASE WHEN k = 0 THEN t END AS category, CASE WHEN k = 0 THEN code || ' ' || t END AS account, CASE WHEN k IN (1, 2) THEN f END AS target,
  CASE k WHEN 1 THEN t || s WHEN 3 THEN CASE WHEN s % 2 = 0 THEN 'single' ELSE 'multi' END END AS value, CASE k WHEN 2 THEN 'value' ELSE '' END AS missing FROM r""")
def rule_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence about each part: an account, a default, a locator without its label, and whether to split."""
    part = table(spark, sf_dir, "part")
    k, key = F.col("p_partkey") % 4, F.col("p_partkey")
    who = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), key.cast("string"))
    name = F.element_at(F.array(*[F.lit(a) for a, _ in _FIELDS]), (key % 5 + 1).cast("int"))
    code = (4000 + key % 3000).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("以后"), who, F.lit("的发票，科目："), code, F.lit(" "), "p_type", F.lit("；分类："), "p_type"))
        .when(k == 1, F.concat(F.lit("invoices from "), who, F.lit(" always: "), name, F.lit(" 填为「"), "p_type", F.col("p_size").cast("string"), F.lit("」")))
        .when(k == 2, F.concat(name, F.lit(" stands somewhere")))
        .otherwise(F.when(F.col("p_size") % 2 == 0, F.lit("this is one invoice, do not split")).otherwise(F.lit("再拆开一点")))
    )
    kind = F.element_at(F.array(*map(F.lit, ["classification", "field_default", "field_locator", "multi_invoice"])), (k + 1).cast("int"))
    rules = part.select(key.alias("id"), kind.alias("rule_type"), text.alias("text"), F.lit(None).cast("string").alias("match_key"))
    pairs = spark.createDataFrame([("Nowhere", "no such account")], "category string, account string")
    return rule_text.read(rules, pairs).select("id", "match_key", "category", "account", "target", "value", F.array_join("missing", ", ").alias("missing"))
