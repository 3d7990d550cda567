"""Bank statements from words on pages, with or without a row of heads.

A row that begins with a date is a transaction.  Its columns are found from the data: right edges of amounts that stand close together are one column, and
the column that ends most rows of several amounts is the balance.  What came in and what went out is told by a sign, else by what the balance did, else by the column, whose
side is voted by all rows where the balance did tell.  So heads are not needed, and an amount that is lost is recovered from the balance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.cells import strip_mark
from tallyframe.functions.dates import DAY, parse_date
from tallyframe.functions.money import parse_amount
from tallyframe.session import checkpointed, small

#: Right edges no further apart than this are one column.
EDGE = 12.0
_AMOUNT = r"^[+\-−(]{0,2}[$€£¥]?-?(?:\d{1,3}(?:[,']\d{3})+(?:\.\d{1,8})?|\d+\.\d{1,8})\)?-?$"


# fixed values: words without which no opening balance is named
OPENINGS = ["opening", "brought", "期初余额", "上期余额"]


def _token_rows(words: DataFrame, tolerance: float) -> DataFrame:
    """(doc_id, page, row, t): rows from the top; t are their words without blanks from left to right, as (x0, i, x1, text, value, word, sign, mark, counted); a word with blanks is cut, its parts placed by their letters.

    What a word says is told before it goes into its row, as plain columns: the value and sign of an amount that is counted, else a word, and among these a mark, Dr (-1) or Cr (1)."""
    page = Window.partitionBy("doc_id", "page")
    fresh = F.when(F.col("y0") - F.lag("y0").over(page.orderBy("y0", "x0")) <= tolerance, 0).otherwise(1)
    rows = words.where("text IS NOT NULL AND trim(text) <> ''").withColumn("_f", fresh).withColumn("row", F.sum("_f").over(page.orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select("doc_id", "page", "row", "x0", "x1", F.col("text").alias("_whole"), F.posexplode(F.split("text", " ")).alias("i", "text")).where("text <> ''")
    end = F.length(F.call_function("substring_index", F.col("_whole"), F.lit(" "), F.col("i") + 1))
    x1 = F.when(F.contains("_whole", F.lit(" ")), F.col("x0") + (F.col("x1") - F.col("x0")) * end / F.length("_whole")).otherwise(F.col("x1"))
    t, money = F.col("text"), F.col("money")
    rows = rows.withColumn("x1", x1.cast("double")).withColumn("money", t.rlike(_AMOUNT)).withColumn("value", F.when(money, F.abs(parse_amount(F.replace(t, F.lit("−"), F.lit("-")))["value"])))
    mark = F.when(t.rlike(r"^\W*[dD]\W*[rR]\W*\z"), -1).when(t.rlike(r"^\W*[cC]\W*[rR]\W*\z"), 1)
    said = {"word": F.when(~money, t), "sign": F.when(money, F.when(t.rlike(r"^\(|[-−]"), -1).when(t.startswith("+"), 1)), "mark": F.when(~money, mark), "counted": F.col("value").isNotNull()}
    # words go into the array of their row and are ordered there, so they are sorted once
    held = rows.groupBy("doc_id", "page", "row").agg(F.collect_list(F.struct("x0", "i", "x1", "text", "value", *[c.alias(k) for k, c in said.items()])).alias("t"))
    return held.withColumn("t", F.sort_array("t"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a filter on a plain column moves below it and computes it again, one on what comes out of an array does not."""
    return df.withColumn(name, F.explode(F.array(value)))


def dated_rows(words: DataFrame, *, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page, row, date, description, monies): rows that begin with a date; monies are (x1, raw, value, sign) from left to right."""
    return _dated(_token_rows(words, tolerance)).where("date IS NOT NULL").drop("opening")


def _dated(rows: DataFrame) -> DataFrame:
    """Token rows as dated rows, and among them those that name an opening balance, in `opening`; date is null where a row is not dated."""
    text = F.array_join("t.text", " ")
    # most rows have no date: only those that begin like one are read
    said = F.when(reduce(Column.__or__, [F.contains(F.lower("_text"), F.lit(w)) for w in OPENINGS]), F.regexp_extract("_text", r"(?i)(?:opening\s+balance|brought\s+forward|期初余额|上期余额)\s*[:：]?\s*(?:[A-Z]{3}\s*)?([($€£¥-]*\d[\d,.']*\)?(?:\s*(?:cr|dr)\b)?)", 1)).otherwise("")
    begun = F.struct(F.regexp_extract("_text", rf"^({DAY})(?!\S)", 1).alias("day"), said.alias("said"))
    rows = _once(_once(rows, "_text", text), "_begun", begun).where("_begun.day <> '' OR _begun.said <> ''").withColumn("_day", F.col("_begun.day"))
    marked = strip_mark(F.col("_begun.said"))
    amount = parse_amount(marked["text"])["value"]
    opening = F.when(F.col("_begun.said") != "", F.when(marked["mark"] == "dr", -F.abs(amount)).otherwise(amount))
    rows = _once(rows, "_read", F.struct(opening.alias("opening"), F.when(F.col("_day") != "", parse_date(F.col("_day"))["value"]).alias("d")))
    rows = rows.where("_read.d IS NOT NULL OR _read.opening IS NOT NULL").withColumns({"d": F.col("_read.d"), "opening": F.col("_read.opening")})
    after = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1)))
    rows = rows.withColumn("r", after(F.col("t"), F.size(F.split("_day", " ")))).drop("t")
    # letters between the amounts are marks (Cr, Dr), those before the first amount the description; null where there is none
    rows = rows.withColumn("_first", F.nullif(F.array_position("r.counted", True), F.lit(0)).cast("int"))
    described = F.array_join(F.when(F.col("_first").isNull(), F.col("r.word")).otherwise(F.slice("r.word", F.lit(1), F.col("_first") - 1)), " ")
    marks = F.when(F.col("_first").isNotNull(), after(F.col("r.mark"), F.col("_first")))
    monies = F.transform(F.filter("r", lambda x: x["counted"]), lambda x: F.struct(x["x1"].alias("x1"), x["text"].alias("raw"), x["value"].alias("value"), x["sign"].alias("sign")))
    told = F.col("d").isNotNull() & F.col("_first").isNotNull()
    mark = F.when(F.array_contains(marks, -1), -1).when(F.array_contains(marks, 1), 1)
    out = rows.select("doc_id", "page", "row", F.when(told, F.col("d")).alias("date"), F.nullif(F.trim(described), F.lit("")).alias("description"), monies.alias("monies"), mark.alias("mark"), "opening")
    return out.where("date IS NOT NULL OR opening IS NOT NULL")


def _columns(rows: DataFrame, edge: float) -> DataFrame:
    """(doc_id, columns, of_balance): the column of each right edge, by tenths of a point, and the column of the balance; columns are gaps in the sorted edges of a document."""
    last = F.size("monies") - 1
    flat = rows.select("doc_id", F.posexplode("monies.x1").alias("i", "x"), last.alias("last")).withColumn("x", F.round("x", 1))
    # edges are counted by tenths of a point first, so a column of any length is a few rows here
    edges = flat.groupBy("doc_id", "x").agg(F.count_if((F.col("last") > 0) & (F.col("i") == F.col("last"))).alias("ends"))
    order = Window.partitionBy("doc_id").orderBy("x")
    edges = edges.withColumn("_f", F.when(F.col("x") - F.lag("x").over(order) <= edge, 0).otherwise(1)).withColumn("column", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumn("ends", F.sum("ends").over(Window.partitionBy("doc_id", "column")))
    # the balance's column ends most of the rows that have several amounts
    ends = F.when(F.col("ends") > 0, F.struct("ends", "column"))
    return edges.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("x", "column"))).alias("columns"), F.max(ends)["column"].alias("of_balance"))


def transactions(words: DataFrame, openings: DataFrame | None = None, *, tolerance: float = 3.0, edge: float = EDGE) -> DataFrame:
    """(doc_id, page, row, date, description, income, expense, balance, how) of the rows that begin with a date and have an amount.

    openings(doc_id, opening) are balances before the first row, where they are known.  how is `sign`, `balance`, `column`, `recovered` (the amount is lost and comes from the balance) or `guess` (nothing tells; counted as income)."""
    return _transactions(checkpointed(dated_rows(words, tolerance=tolerance)), openings, edge)


def statements(words: DataFrame, *, tolerance: float = 3.0, edge: float = EDGE) -> tuple[DataFrame, DataFrame]:
    """transactions and opening_balances of the same words, which are read once for both."""
    read = checkpointed(_dated(_token_rows(words, tolerance)))
    openings = _openings(read)
    return _transactions(read.where("date IS NOT NULL").drop("opening"), openings, edge), openings


def _transactions(rows: DataFrame, openings: DataFrame | None, edge: float) -> DataFrame:
    """Of dated rows that are kept, as they are read twice: once for the columns of a document, and once with these."""
    n, column = F.size("monies"), lambda m: F.try_element_at("columns", F.round(m["x1"], 1))
    full = rows.join(_columns(rows, edge), "doc_id")
    last = F.try_element_at("monies", F.lit(-1))
    is_balance = F.col("of_balance").isNotNull() & ((n > 1) | (column(last) == F.col("of_balance")))
    full = full.withColumn("_last", is_balance).withColumn("balance", F.when(F.col("_last"), F.when(last["sign"] == -1, -last["value"]).otherwise(last["value"])))
    a = F.when(F.col("_last"), F.when(n > 1, F.try_element_at("monies", F.lit(-2)))).otherwise(last)
    full = full.withColumn("_a", a).withColumn("a", F.when(F.col("_a").isNotNull(), F.struct(F.col("_a.value").alias("value"), F.col("_a.sign").alias("sign"), column(F.col("_a")).alias("column"))))
    full = full.drop("monies", "columns", "of_balance", "_last", "_a")
    place = Window.partitionBy("doc_id").orderBy("page", "row")
    if openings is not None:
        full = full.join(openings.select("doc_id", F.col("opening").cast("decimal(28,6)").alias("opening")), "doc_id", "left")
    else:
        full = full.withColumn("opening", F.lit(None).cast("decimal(28,6)"))
    before = F.last("balance", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, -1))
    full = full.withColumn("delta", F.col("balance") - F.coalesce(before, "opening")).withColumn("amount", F.col("a.value"))
    agrees = F.when(F.col("delta") == F.col("amount"), 1).when(F.col("delta") == -F.col("amount"), -1).otherwise(0)
    votes = F.sum(agrees).over(Window.partitionBy("doc_id", "a.column"))
    sign = F.coalesce(F.col("a.sign"), F.col("mark"))
    moved = F.when(F.col("delta") > 0, 1).when(F.col("delta") < 0, -1)
    # a balance that moved by just the amount is certain; one that moved otherwise tells less than the column's other rows
    full = full.withColumn("votes", votes).withColumn("agrees", agrees)
    side = F.when(sign.isNotNull(), sign).when(F.col("agrees") != 0, F.col("agrees")).when(F.col("votes") > 0, 1).when(F.col("votes") < 0, -1).otherwise(moved)
    how = F.when(F.col("amount").isNull(), F.when(F.col("delta").isNotNull(), "recovered")).when(sign.isNotNull(), "sign").when(F.col("agrees") != 0, "balance").when(F.col("votes") != 0, "column").when(moved.isNotNull(), "balance").otherwise("guess")
    value = F.when(F.col("amount").isNull(), F.abs("delta")).otherwise(F.col("amount"))
    way = F.when(F.col("amount").isNull(), moved).otherwise(F.coalesce(side, F.lit(1)))
    return full.select("doc_id", "page", "row", "date", "description", F.when(way > 0, value).alias("income"), F.when(way < 0, value).alias("expense"), "balance", how.alias("how"))


def opening_balances(words: DataFrame, *, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, opening): the amount behind `opening balance`, `balance brought forward` or 期初余额 in the first such row."""
    return _openings(_dated(_token_rows(words, tolerance)))


def _openings(read: DataFrame) -> DataFrame:
    return small(read.where("opening IS NOT NULL").groupBy("doc_id").agg(F.min_by("opening", F.struct("page", "row")).alias("opening")))


def running_check(found: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """(doc_id, rows, agree): how many rows have a balance that follows from the one before and the row's own amount."""
    place = Window.partitionBy("doc_id").orderBy("page", "row")
    rows = found if openings is None else found.join(openings, "doc_id", "left")
    before = F.coalesce(F.lag("balance").over(place), F.col("opening") if openings is not None else F.lit(None).cast("decimal(28,6)"))
    zero = F.lit(0).cast("decimal(28,6)")
    same = before + F.coalesce("income", zero) - F.coalesce("expense", zero) == F.col("balance")
    return rows.withColumn("_s", same).groupBy("doc_id").agg(F.count("_s").alias("rows"), F.count(F.when(F.col("_s"), 1)).alias("agree"))
