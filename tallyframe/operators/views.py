"""Views over documents, statements, matches and rules: lists in their order, groups of one source, summaries, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.cells import category_key, grade
from tallyframe.functions.dates import excel_serial, parse_date
from tallyframe.functions.money import MONEY, total
from tallyframe.operators import accounts as A
from tallyframe.operators import fx, ledger

# fixed values: sources whose control postings name their document themselves
ENGINE_KINDS = ["invoice", "settlement", "closing", "reversal"]

# ---- lists in their order; a sort by ranges, so any size


def entries_in_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy("period", "entry_no")


def matches_in_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy(F.desc("match_score"), "id")


def rules_in_order(rules: DataFrame) -> DataFrame:
    """Those that wait for a decision first, then the newest."""
    return rules.orderBy(F.col("status") == "active", F.desc("confirmed_at"), "id")


def parties_in_order(parties: DataFrame) -> DataFrame:
    return parties.orderBy(F.lower("name"), "name")


def counted_parties_in_order(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("count"), "raw")


def statement_lines_in_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy("date", "stmt_hash", "index")


def statements_in_order(statements: DataFrame) -> DataFrame:
    return statements.orderBy(F.coalesce("period_end", "period_start"), "bank_name")


# ---- documents of one source


def segments(documents: DataFrame) -> DataFrame:
    """documents(source_hash, position): the place of each document in its source, from 0, and how many there are."""
    source = Window.partitionBy("source_hash")
    return documents.withColumns({"segment_index": F.row_number().over(source.orderBy("position", "hash")) - 1, "segment_total": F.count("*").over(source)})


def siblings(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(hash) -> (hash, sibling, segment_index): documents cut from the same source, itself included, in their order."""
    own = documents.join(asked.select("hash"), "hash", "left_semi").select("hash", "source_hash")
    return own.join(documents.select("source_hash", F.col("hash").alias("sibling"), "segment_index"), "source_hash").select("hash", "sibling", "segment_index").orderBy("hash", F.coalesce("segment_index", F.lit(0)))


def display(documents: DataFrame) -> DataFrame:
    """The short form of a document for lists: who, when, how much, how many lines and issues, and what a person has to do."""
    severe = F.size(F.filter("issues", lambda x: x["severity"].isin("error", "critical")))
    return documents.select(
        "hash", "doc_type", "status", "issuer", "number", F.date_format("date", "yyyy-MM-dd").alias("date"), "currency", F.col("total").cast("string").alias("total"), "category", F.size("lines").alias("n_lines"),
        F.size("issues").alias("n_issues"), severe.alias("n_severe"), (severe > 0).alias("needs_fix"), F.coalesce("segment_index", F.lit(0)).alias("segment_index"), F.coalesce("segment_total", F.lit(1)).alias("segment_total"),
    )


def count_documents(documents: DataFrame, status: str | None = None, doc_type: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("doc_type", doc_type)):
        documents = documents if value is None else documents.where(F.col(column) == value)
    return documents.agg(F.count("*").alias("n"))


# ---- lines of a document


def dominant_description(lines: Column) -> Column:
    """lines: array of struct(description, amount).  The description of the largest amount, of several the first; without amounts all descriptions."""
    priced = F.filter(lines, lambda x: x["amount"].isNotNull())
    best = F.array_max(F.transform(priced, lambda x: x["amount"]))
    first = F.get(F.filter(priced, lambda x: x["amount"] == best), F.lit(0))["description"]
    every = F.trim(F.array_join(F.transform(lines, lambda x: F.coalesce(x["description"], F.lit(""))), " "))
    return F.when(F.size(lines) <= 0, "").when(F.size(priced) > 0, F.coalesce(first, F.lit(""))).otherwise(every)


def sub_item_check(lines: DataFrame) -> DataFrame:
    """lines(amount, places, sub_amounts: array): the sum of a line's parts, and whether it is the line's amount within one unit of its last place (a hundredth at most)."""
    has = F.size("sub_amounts") > 0
    summed = F.aggregate("sub_amounts", F.lit(0).cast("decimal(28,3)"), lambda n, x: (n + F.coalesce(x, F.lit(0))).cast("decimal(28,3)"))
    near = F.when(F.greatest(F.col("places"), F.lit(2)) >= 3, F.lit("0.001")).otherwise(F.lit("0.01")).cast("decimal(4,3)")
    return lines.withColumns({"has_detail": has, "sub_sum": F.when(has, summed), "matched": has & F.coalesce(F.abs(summed - F.col("amount")) <= near, F.lit(False))})


def attach_schedules(lines: DataFrame, schedules: DataFrame) -> DataFrame:
    """schedules(hash, category, amount) to lines(hash, line_no, description): each goes to the first line of its document whose key holds its own or is held by it; null line_no: none."""
    key = category_key(F.col("category"))
    asked = schedules.select("hash", "category", key.alias("_k")).distinct()
    own = lines.select("hash", "line_no", category_key(F.col("description")).alias("_l")).where("_l <> ''")
    # a document has few lines and categories, and both sides meet by document
    met = asked.join(own, "hash").where((F.col("_k") != "") & (F.contains("_l", "_k") | F.contains("_k", "_l")))
    first = met.groupBy("hash", "category").agg(F.min("line_no").alias("line_no"))
    sums = schedules.groupBy("hash", "category").agg(total(F.col("amount")).alias("sub_sum"), F.count("*").alias("n_rows"))
    return sums.join(first, ["hash", "category"], "left")


def confidence(documents: DataFrame, required: list[str], key: list[str]) -> DataFrame:
    """documents(legibility, fields: map name -> struct(raw, confidence)): coverage of the required fields, the least confidence of the key fields (0 with one missing), and the grade of the least of all."""
    there = lambda k: F.coalesce(F.col("fields")[k]["raw"] != "", F.lit(False))
    found = sum((there(k).cast("int") for k in required), F.lit(0))
    coverage = (found / F.lit(max(1, len(required)))).cast("double")
    least = F.array_min(F.filter(F.array(*[F.when(there(k), F.col("fields")[k]["confidence"]) for k in key]), lambda x: x.isNotNull()))
    sure = F.when(found < len(required), 0.0).otherwise(F.coalesce(least, "legibility"))
    out = documents.withColumns({"coverage": coverage, "key_confidence": sure})
    return out.withColumn("grade", grade(F.round(F.least("legibility", "coverage", "key_confidence"), 6).cast("decimal(9,6)")))


def statement_confidence(statements: DataFrame) -> DataFrame:
    """statements(legibility, n_txns, has_header): complete with both, 0.7 without a header, else 0."""
    coverage = F.when((F.col("n_txns") > 0) & F.col("has_header"), 1.0).when(F.col("n_txns") > 0, 0.7).otherwise(0.0)
    out = statements.withColumn("coverage", coverage)
    return out.withColumns({"key_confidence": F.when(F.col("n_txns") > 0, F.col("legibility")).otherwise(0.0), "grade": grade(F.least("legibility", "coverage").cast("decimal(9,6)"))})


# ---- statement rows


def transactions(rows: DataFrame) -> DataFrame:
    """rows(expense, income, currency, header_currency): those with an amount, as amount, direction and currency; an expense goes before an income."""
    return rows.withColumns({"amount": F.coalesce("expense", "income"), "direction": F.when(F.col("expense").isNotNull(), "out").otherwise("in"), "currency": F.coalesce("currency", "header_currency")}).where("amount IS NOT NULL")


def day_first(rows: DataFrame, source: str = "source", raw: str = "raw") -> DataFrame:
    """(source, day_first): true if some first part is above 12 and no second one, false the other way round, else null."""
    parts = r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-]\d{2,4}\s*$"
    a, b = (F.coalesce(F.regexp_extract(F.col(raw), parts, k).try_cast("int") > 12, F.lit(False)) for k in (1, 2))
    seen = rows.groupBy(source).agg(F.coalesce(F.bool_or(a), F.lit(False)).alias("a"), F.coalesce(F.bool_or(b), F.lit(False)).alias("b"))
    return seen.select(source, F.when(F.col("a") & ~F.col("b"), True).when(F.col("b") & ~F.col("a"), False).alias("day_first"))


def dated(rows: DataFrame, source: str = "source", raw: str = "raw") -> DataFrame:
    """The rows whose date reads as one, day and month in the order of their source; titles, notes and totals go.  A serial day number is a date, too."""
    known = rows.join(day_first(rows, source, raw), source)
    read = F.coalesce(parse_date(F.col(raw), F.coalesce("day_first", F.lit(False)))["value"], excel_serial(F.col(raw)))
    return known.withColumn("date", read).where("date IS NOT NULL").drop("day_first")


def recovered_amounts(rows: DataFrame) -> DataFrame:
    """rows(stmt, idx, income, expense, balance): a row that has lost its amount takes the step of the balance, with recovered = true."""
    before = F.lag("balance").over(Window.partitionBy("stmt").orderBy("idx"))
    step = F.when(F.col("income").isNull() & F.col("expense").isNull(), F.col("balance") - before)
    return rows.withColumns({"income": F.coalesce("income", F.when(step > 0, step)), "expense": F.coalesce("expense", F.when(step < 0, -step)), "recovered": F.coalesce(step != 0, F.lit(False))})


def value_below(lines: DataFrame, label: str) -> DataFrame:
    """lines(doc, line_no, text): the text of the next line that is not blank, where a line is the label alone."""
    spoken = lines.where(F.trim("text") != "")
    after = F.lead("text").over(Window.partitionBy("doc").orderBy("line_no"))
    return spoken.withColumn("value", after).where(F.col("text").rlike(rf"(?i)^\s*{label}\s*[:：]?\s*$")).select("doc", "line_no", F.trim("value").alias("value"))


def open_statement_lines(rows: DataFrame, posted: DataFrame, confirmed: DataFrame) -> DataFrame:
    """rows(stmt_hash, index, expense, income) with a positive amount that are neither posted(stmt_hash, index) nor matched: confirmed(stmt_hash, index, kind) of kind reconciled."""
    out = F.coalesce(F.col("expense") > 0, F.lit(False))
    amount = F.when(out, F.col("expense")).otherwise(F.col("income"))
    live = rows.withColumns({"direction": F.when(out, "out").otherwise("in"), "amount": amount}).where("amount > 0")
    gone = posted.select("stmt_hash", "index").unionByName(confirmed.where("kind = 'reconciled'").select("stmt_hash", "index")).distinct()
    return live.join(gone, ["stmt_hash", "index"], "left_anti")


# ---- matches and rules


def match_members(matches: DataFrame, members: DataFrame) -> DataFrame:
    """Per match the invoices and transactions in it; members(match_id, kind, hash, index).  A match without members has empty lists."""
    item = lambda kind, value: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, value)))
    grouped = members.groupBy("match_id").agg(item("invoice", F.col("hash")).alias("invoices"), item("txn", F.struct("hash", "index")).alias("txns"))
    joined = matches.join(grouped, matches["id"] == grouped["match_id"], "left").drop("match_id")
    return joined.withColumns({"invoices": F.coalesce("invoices", F.array().cast("array<string>")), "txns": F.coalesce("txns", F.filter(F.array(F.struct(F.lit("").alias("hash"), F.lit(0).cast(members.schema["index"].dataType).alias("index"))), lambda x: F.lit(False)))})


def pool_summary(invoices: DataFrame, txns: DataFrame, need_fix: DataFrame) -> DataFrame:
    """One row: how many invoices and transactions may be matched, and how many documents of each kind have to be mended first."""
    kinds = need_fix.agg(F.count_if(F.col("doc_type") == "invoice").alias("fix_invoices"), F.count_if(F.col("doc_type") == "statement").alias("fix_statements"))
    return invoices.agg(F.count("*").alias("pool_invoices")).crossJoin(txns.agg(F.count("*").alias("pool_transactions"))).crossJoin(kinds)  # one row each


def class_pairs(seeds: DataFrame, learned: DataFrame) -> DataFrame:
    """Distinct (category, account): seeds(category, account, ord) in their order, then those that rules(rule_type, category, account) have learned; rank 0 marks a seed."""
    pairs = learned.where(F.col("rule_type").isin("classification", "content_class")).select("category", "account", F.lit(1 << 30).alias("ord"))
    both = seeds.select("category", "account", "ord").unionByName(pairs).where("coalesce(category, '') <> '' OR coalesce(account, '') <> ''")
    named = both.withColumns({"category": F.coalesce("category", F.lit("")), "account": F.coalesce("account", F.lit(""))})
    return named.groupBy("category", "account").agg(F.min("ord").alias("ord"))


def locators_for(documents: DataFrame, locators: DataFrame) -> DataFrame:
    """(hash, id): active locators that hold everywhere, for the document's issuer, or for its fingerprint; each once.  Three joins by key instead of one by alternatives."""
    live = locators.where("status = 'active'")
    everywhere = documents.select("hash").crossJoin(F.broadcast(live.where("scope = 'global'").select("id")))  # rules that people have confirmed, some dozens
    scoped = live.where("scope <> 'global'")
    by_issuer = documents.where("issuer <> ''").join(scoped.select("id", F.col("match_key").alias("issuer")), "issuer").select("hash", "id")
    by_print = documents.where("fingerprint <> ''").join(scoped.select("id", F.col("account").alias("fingerprint")), "fingerprint").select("hash", "id")
    return everywhere.union(by_issuer).union(by_print).distinct()


def multi_invoice_prior(rules: DataFrame) -> DataFrame:
    """(match_key, value): per fingerprint what the active rule confirmed most often says; of equally many the lower id."""
    live = rules.where("rule_type = 'multi_invoice' AND status = 'active'")
    return live.groupBy("match_key").agg(F.max_by("value", F.struct("confirm_count", -F.col("id"))).alias("value"))


# ---- before posting


def upload_guard(files: DataFrame, *, most_bytes: int, extensions: list[str], most_pages: int) -> DataFrame:
    """files(path, size, pages): why a file is refused (null: it is not)."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return files.withColumn("refused", F.when(~ending.isin(extensions), "extension").when(F.col("size") > most_bytes, "size").when(F.col("size") <= 0, "empty").when(F.col("pages") > most_pages, "pages"))


def canonical_account(lines: DataFrame, chart: DataFrame, account: str = "account") -> DataFrame:
    """The account as the chart writes it, by its code; others trimmed."""
    dim = F.broadcast(chart.select(F.col("code").alias("_code"), F.concat_ws(" ", "code", "name").alias("_full")))  # a chart has some dozens of rows
    joined = lines.join(dim, A.account_code(F.col(account)) == F.col("_code"), "left")
    return joined.withColumn(account, F.coalesce("_full", F.trim(account))).drop("_code", "_full")


def control_breaches(lines: DataFrame) -> DataFrame:
    """Entries of people that touch a control account without naming the party."""
    return lines.where(~F.col("source_kind").isin(ENGINE_KINDS) & A.control_side(F.col("account")).isNotNull() & (F.trim(F.coalesce("party", F.lit(""))) == "")).select("entry_id", "account").distinct()


def fx_accruals(invoices: DataFrame, rates: DataFrame, *, entry_day: str = "entry_day") -> tuple[DataFrame, DataFrame]:
    """Accrual lines in the functional currency at the rate in force on the day of entry, with stale_days; and the invoices without any rate, which are not posted."""
    rated = fx.rate_as_of(invoices, rates, date=entry_day)
    posted = rated.where("rate IS NOT NULL").withColumns({c: fx.to_functional(F.col(c), F.col("rate")).cast(MONEY) for c in ("total", "subtotal", "tax")})
    notes = posted.select(F.col("hash").alias("source_id"), F.col("rate_date"), fx.stale_days(F.col(entry_day), F.col("rate_date")).alias("stale_days"))
    return ledger.accruals(posted).join(notes, "source_id"), rated.where("rate IS NULL").select(invoices.columns)


def postable(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Approved invoices without an accrual, with the total that their entry would have."""
    done = lines.where("source_kind = 'invoice'").select(F.col("source_id").alias("hash")).distinct()
    fixed = invoices.where("lower(status) = 'approved'").join(done, "hash", "left_anti")
    amounts = ledger.repaired_amounts(F.col("total"), F.col("subtotal"), F.col("tax"))
    return fixed.withColumn("preview_total", amounts["total"])
