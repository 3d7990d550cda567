"""Edits of orders as documents: the items of an order are its commands, and what is left after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import edits
from tallyframe.plans.adapters import ORACLE_INVOICES, dec, invoices
from tallyframe.plans.page_queries import _ORDER_ITEMS, order_items

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order with its items; every fifth one is locked."""
    inv = invoices(spark, sf_dir)
    item = F.struct(F.col("name").alias("description"), F.col("quantity").cast("string").alias("quantity"), F.col("amount").cast("string").alias("amount"))
    own = order_items(spark, sf_dir).groupBy(F.col("o_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("i")))), lambda x: x["i"]).alias("items"))
    fields = F.create_map(F.lit("invoice_no"), F.col("invoice_no"), F.lit("invoice_date"), F.col("date").cast("string"), F.lit("total_due"), F.col("total").cast("string"), F.lit("subtotal"), F.col("subtotal").cast("string"), F.lit("sales_tax"), F.col("tax").cast("string"))
    head = inv.select(F.col("o_orderkey").alias("doc_id"), fields.alias("fields"), (F.col("o_orderkey") % 5 == 0).alias("locked"), F.lit("Pending").alias("status"), F.lit(0).cast("long").alias("rev"))
    return head.join(own, "doc_id")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th item of an order by n modulo 6: a note, a subtotal that is no number, another amount, an item that is not there, an edit on an old revision, an item more; at the end an action."""
    rows = order_items(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), "n", "mode")
    k = F.col("n") % 6
    text = lambda *pairs: F.coalesce(*[F.when(k == i, v) for i, v in pairs])
    names = ["add_item", "change_field", "change_field", "change_item", "delete_item", "change_field"]
    kind = F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    own = rows.select(
        "doc_id", F.col("n").cast("long").alias("seq"), F.lit("a").alias("by"), kind.alias("kind"), F.when(k == 3, F.col("n") - 1).when(k == 4, 999).cast("int").alias("at"), text((0, F.lit("1.00")), (1, F.lit("note")), (2, F.lit("subtotal")), (3, F.lit("amount")), (5, F.lit("note"))).alias("field"),
        text((0, F.lit("more")), (1, F.concat("mode", F.col("n").cast("string"))), (2, F.lit("about ten")), (3, F.lit("US$ 2,000.50")), (5, F.lit("stale"))).alias("value"), F.lit(None).cast("string").alias("reason"), F.when(k == 5, 0).cast("long").alias("base"),
    )
    last = rows.groupBy("doc_id").agg(F.max("n").alias("n"))
    d = F.col("doc_id") % 3
    act = last.select("doc_id", (F.col("n") + 1).cast("long").alias("seq"), F.lit("b").alias("by"), F.lit("act").alias("kind"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("field"), F.when(d == 1, "Hold").otherwise("Rejected").alias("value"), F.when(d == 2, "wrong order").alias("reason"), F.lit(None).cast("long").alias("base"))
    return own.unionByName(act)


_KEPT = f"""{ORACLE_INVOICES}, {_ORDER_ITEMS}, it AS (SELECT oi.* FROM oi JOIN inv USING (o_orderkey)),
c AS (SELECT *, n % 6 AS k, o_orderkey % 5 = 0 AS locked, max(n) OVER (PARTITION BY o_orderkey) AS last FROM it)"""


@query(f"""WITH {_KEPT},
d AS (SELECT o_orderkey, bool_or(locked) AS locked, count(*) FILTER (k IN (0, 1, 3)) AS good, arg_max(mode || n, n) FILTER (k = 1) AS note, count(*) AS items, count(*) FILTER (k = 0) AS more,
  sum(CASE WHEN k = 3 AND NOT locked THEN 200050 ELSE CAST(amount * 100 AS BIGINT) END) + 100 * count(*) FILTER (k = 0 AND NOT locked) AS cents FROM c GROUP BY 1)
SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Hold' ELSE 'Rejected' END AS status, CASE WHEN NOT locked THEN note END AS note, CASE WHEN locked THEN items ELSE items + more END AS items, {dec('cents')}::DECIMAL(18,2) AS amount,
  CASE WHEN locked THEN 0 ELSE good END + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS rev FROM d""")
def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, _ = edits.fold(documents(spark, sf_dir), commands(spark, sf_dir))
    amount = F.aggregate("items", F.lit(0).cast("decimal(18,2)"), lambda s, i: (s + F.coalesce(i["amount"].cast("decimal(18,2)"), F.lit(0))).cast("decimal(18,2)"))
    return states.select("doc_id", "status", F.try_element_at("fields", F.lit("note")).alias("note"), F.size("items").cast("long").alias("items"), amount.alias("amount"), "rev")


@query(f"""WITH {_KEPT}, l AS (SELECT o_orderkey AS doc_id, n AS seq, CASE WHEN k = 5 AND before > 0 THEN 'made on revision 0, the document is at ' || before WHEN locked THEN 'part of a confirmed match' WHEN k = 2 THEN 'subtotal is no number' WHEN k = 4 THEN 'no such item: 999' END AS refused
  FROM (SELECT *, CASE WHEN locked THEN 0 ELSE coalesce(count(*) FILTER (k IN (0, 1, 3)) OVER (PARTITION BY o_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS before FROM c))
SELECT * FROM l UNION ALL SELECT DISTINCT o_orderkey, last + 1, CASE WHEN o_orderkey % 3 = 0 THEN 'a rejection needs a reason' END FROM c""")
def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, log = edits.fold(documents(spark, sf_dir), commands(spark, sf_dir))
    return log.select("doc_id", "seq", "refused")
