"""Tables that stand on end: every label and every value on a line of its own, and tables whose columns are told from the right.

A block of labels opens a table of as many columns; the lines after it are dealt to records by their place in the block modulo the number of labels.
Blocks are islands of label lines, places are running counts, so a document is read once and in order, and nothing of it is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from tallyframe.functions.text import norm_key
from tallyframe.operators import items
from tallyframe.operators.pages import money_tokens, page_rows

#: Characters of a line that can be a label, and labels that make a block.
LABEL, BLOCK = 40, 4

# fixed values: heads of item tables
ITEM_HEADS = {
    "description": ["description", "service", "particular", "particulars", "item", "items", "detail", "details", "项目", "名称", "品名", "商品", "服务", "摘要", "货物"],
    "quantity": ["qty", "quantity", "units", "hours", "数量"],
    "unit_price": ["unit price", "unit cost", "rate", "price", "unit", "单价"],
    "amount": ["amount", "line total", "total", "fee", "charge", "sum", "value", "cost", "金额", "价税", "合计"],
}


def by_wording(names: dict[str, list[str]]) -> Column:
    """Wording -> name, for keys of norm_key."""
    key = lambda w: "".join(c for c in w.lower() if c.isalnum())
    return F.create_map(*[F.lit(x) for name, words in names.items() for w in words for x in (key(w), name)])


def records(lines: DataFrame, names: dict[str, list[str]], *, least: int = BLOCK, needs: tuple[str, ...] = (), longest: int = LABEL, end: Column | None = None) -> DataFrame:
    """lines(doc_id, line, text) -> (doc_id, block, record, place, name, value): the values of whole records, with the names of their columns.

    `least` labels in a row open a block, if all of `needs` are among them; smaller islands of labels are passed over and are no values.
    `end` ends a block at the first line that it holds for.  The last record of a block counts only if it is whole."""
    order = Window.partitionBy("doc_id").orderBy("line")
    known = by_wording(names)
    said = lines.withColumn("text", F.trim("text")).where("text <> ''")
    said = said.withColumn("_name", F.when(F.length("text") <= longest, F.try_element_at(known, norm_key(F.col("text")))))
    fresh = F.when(F.col("_name").isNotNull() & F.lag("_name").over(order).isNull(), 1).otherwise(0)
    said = said.withColumn("_f", fresh).withColumn("_island", F.when(F.col("_name").isNotNull(), F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    island = Window.partitionBy("doc_id", "_island")
    held = F.collect_set("_name").over(island)
    opens = F.col("_island").isNotNull() & (F.count("*").over(island) >= least) & (F.size(F.array_except(F.array(*map(F.lit, needs)).cast("array<string>"), held)) == 0)
    said = said.withColumn("_opens", F.when(opens, F.col("_island")))
    said = said.withColumn("block", F.last("_opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("block IS NOT NULL")
    # the names of a block's columns, in their order, come to its lines along the block, so the document is read once and meets nothing
    block = Window.partitionBy("doc_id", "block").orderBy("line")
    so_far, whole = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.when(F.col("_opens").isNotNull(), F.col("_name"))
    values = said.withColumn("n", F.count(head).over(whole)).withColumn("names", F.collect_list(head).over(whole)).where("_name IS NULL")
    if end is not None:
        values = values.withColumn("_over", F.max(F.coalesce(end, F.lit(False))).over(so_far)).where("NOT _over")
    values = values.withColumn("_at", F.row_number().over(block) - 1).withColumn("_of", F.count("*").over(whole))
    placed = values.withColumn("record", F.expr("cast(_at div n as int)")).withColumn("place", (F.col("_at") % F.col("n")).cast("int"))
    return placed.where("record < _of div n").select("doc_id", "block", "record", "place", F.get("names", F.col("place")).alias("name"), F.col("text").alias("value"))


def as_columns(found: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, block, record, ...): a row for each record; of columns with one name the first counts."""
    first = lambda n: F.min_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("place"))).alias(n)
    return found.groupBy("doc_id", "block", "record").agg(*[first(n) for n in names])


def upright_items(words: DataFrame) -> DataFrame:
    """Line items of pages whose tables stand on end, as items.line_items gives them: heads for a text and an amount, then so many lines an item, up to the sums."""
    order = Window.partitionBy("doc_id").orderBy("page", "row")
    rows = items.table_rows(words)
    lines = rows.select("doc_id", F.row_number().over(order).alias("line"), "text", "ends", "stamp").where("NOT stamp")
    found = as_columns(records(lines, ITEM_HEADS, least=2, needs=("description", "amount"), longest=items.HEAD, end=F.col("ends")), list(ITEM_HEADS))
    first = Window.partitionBy("doc_id")
    found = found.withColumn("_b", F.min("block").over(first)).where("block = _b")
    money = lambda c: F.coalesce(F.get(money_tokens(F.col(c)), F.lit(0)), F.col(c))
    return items.numbered(found.select("doc_id", F.col("record").alias("n"), F.col("description").alias("d"), F.col("quantity").alias("q"), money("unit_price").alias("u"), money("amount").alias("a")))


_VAT_MONEY = r"(\d[\d,]*\.\d{2})"


def _vat_rows(words: DataFrame) -> DataFrame:
    """(doc_id, page, row, texts, text, inside, monies) of every row; inside: between the heads of a Chinese VAT invoice and its sum, with an amount."""
    rows = page_rows(words).select("doc_id", "page", F.posexplode("rows").alias("row", "c"))
    rows = rows.select("doc_id", "page", (F.col("row") + 1).cast("long").alias("row"), F.col("c.text").alias("texts"), F.array_join("c.text", " ").alias("text"))
    place = F.struct("page", "row")
    doc = Window.partitionBy("doc_id")
    has = lambda w: F.contains(F.col("text"), F.lit(w))
    rows = rows.withColumn("_vat", F.max(has("增值税") | has("价税合计")).over(doc)).withColumn("_head", F.min(F.when(has("金额") & has("税额"), place)).over(doc))
    ends = F.col("text").startswith("合计") | has("价税合计")
    rows = rows.withColumn("_end", F.min(F.when((place > F.col("_head")) & ends, place)).over(doc))
    inside = F.coalesce(F.col("_vat") & (place > F.col("_head")) & (F.col("_end").isNull() | (place < F.col("_end"))), F.lit(False))
    monies = F.when(inside, F.regexp_extract_all("text", F.lit(_VAT_MONEY), F.lit(1)))
    return rows.select("doc_id", "page", "row", "texts", "text", monies.alias("monies")).withColumn("inside", F.coalesce(F.size("monies") > 0, F.lit(False)))


def _vat_amounts() -> tuple[Column, Column]:
    """The amount and the tax of a row inside: of its amounts the last is the tax and the one before it the amount."""
    value = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    amount = F.when(F.size("monies") > 1, F.try_element_at("monies", F.lit(-2))).otherwise(F.try_element_at("monies", F.lit(-1)))
    return value(amount), value(F.when(F.size("monies") > 1, F.try_element_at("monies", F.lit(-1))))


def vat_items(words: DataFrame) -> DataFrame:
    """(doc_id, page, row, description, amount, tax) of Chinese VAT invoices: of a row's amounts the last is the tax and the one before it the amount, whatever columns are run together."""
    amount, tax = _vat_amounts()
    described = F.get(F.filter("texts", lambda t: t.rlike(r"\p{L}")), F.lit(0))
    return _vat_rows(words).where("inside").select("doc_id", "page", "row", described.alias("description"), amount.alias("amount"), tax.alias("tax"))


def vat_sums(words: DataFrame) -> DataFrame:
    """(doc_id, subtotal, sales_tax, total_due): the sums of the items, and the total that the invoice names, else both together.

    Rows are read once: those inside are added up, and of all the first that names a total counts."""
    amount, tax = _vat_amounts()
    named = F.when(F.contains("text", F.lit("价税合计")), F.regexp_extract(F.substring_index(F.array_join("texts", ""), "价税合计", -1), _VAT_MONEY, 1))
    rows = _vat_rows(words).select("doc_id", "page", "row", "inside", F.when(F.col("inside"), amount).alias("amount"), F.when(F.col("inside"), tax).alias("tax"), F.replace(named, F.lit(","), F.lit("")).try_cast("decimal(18,2)").alias("t"))
    sums = rows.groupBy("doc_id").agg(F.count_if("inside").alias("n"), F.sum("amount").cast("decimal(18,2)").alias("subtotal"), F.sum("tax").cast("decimal(18,2)").alias("sales_tax"), F.min(F.when(F.col("t").isNotNull(), F.struct("page", "row", "t")))["t"].alias("t")).where("n > 0")
    both = (F.col("subtotal") + F.coalesce("sales_tax", F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)")
    return sums.select("doc_id", "subtotal", "sales_tax", F.coalesce("t", both).alias("total_due"))
