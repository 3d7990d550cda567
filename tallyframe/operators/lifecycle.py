"""States that people change: what may be matched, confirmed matches, periods, and postings that need a guard."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import MONEY, total
from tallyframe.functions.text import norm_key

# fixed values: issues that keep a document from being matched
HARD = ["TOTAL_MISMATCH", "LINE_SUM_MISMATCH", "TAX_RATE_CONFLICT", "AMOUNT_FORMAT", "DUPLICATE", "MISSING_TOTAL", "MISSING_INVOICE_NO"]


def block_reasons(parse_status: Column, doc_type: Column, n_txns: Column, missing: Column, codes: Column, critical: Column) -> Column:
    """Why a document cannot be matched, in order; a failed one has that reason alone, an empty array lets it through."""
    hard = F.array_distinct(F.array_intersect(codes, F.array(*map(F.lit, HARD))))
    listed = F.concat(F.when((doc_type == "statement") & (n_txns == 0), F.array(F.lit("statement empty"))).otherwise(F.array().cast("array<string>")), F.transform(missing, lambda m: F.concat(F.lit("missing "), m)), hard)
    fallback = F.when(critical & (F.size(listed) == 0), F.array(F.lit("critical"))).otherwise(listed)
    return F.when(parse_status == "failed", F.array(F.lit("failed"))).when((parse_status != "parsed") & (F.size(fallback) == 0), F.array(F.lit("not parsed"))).otherwise(fallback)


def pool(docs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """docs(hash, status, reasons) that are neither rejected, nor blocked, nor confirmed already."""
    return docs.where((F.coalesce("status", F.lit("Pending")) != "Rejected") & (F.size("reasons") == 0)).join(confirmed.select("hash").distinct(), "hash", "left_anti")


def match_key(members: Column) -> Column:
    """One text for a set of members, whatever their order."""
    return F.array_join(F.array_sort(F.array_distinct(members)), ",")


def new_proposals(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Proposals whose key is not there yet."""
    return proposed.join(known.select("match_key").distinct(), "match_key", "left_anti")


STATES = ["", "proposed", "confirmed", "rejected", "acknowledged"]
#: Action -> the state it needs and the one it gives.
ACTIONS = {"propose": ("", "proposed"), "confirm": ("proposed", "confirmed"), "reject": ("proposed", "rejected"), "ack": ("proposed", "acknowledged"), "unconfirm": ("confirmed", "proposed"), "unreject": ("rejected", "proposed"), "unack": ("acknowledged", "proposed")}


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(match_id, part, map, n): what the actions of a match in this range make of each state, as one digit for each state."""
    part, now, digits, n, out = TaskContext.get().partitionId(), None, list(range(len(STATES))), 0, []
    steps = {a: (STATES.index(need), STATES.index(gives)) for a, (need, gives) in ACTIONS.items()}

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], kind) for i, kind in ((0, kind_of[0]), (1, pa.int32()), (2, pa.string()), (3, pa.int64()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["match_id", "part", "map", "n"])

    kind_of = [None]
    for b in batches:
        kind_of[0] = b.schema.field(0).type
        for match, action in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if n and match != now:
                out.append((now, part, "".join(map(str, digits)), n))
                digits, n = list(range(len(STATES))), 0
                if len(out) >= 4096:
                    yield batch()
            now, n = match, n + 1
            need, gives = steps.get(action, (None, None))
            digits = [gives if d == need else d for d in digits]
    if n:
        out.append((now, part, "".join(map(str, digits)), n))
    if out:
        yield batch()


def match_states(events: DataFrame) -> DataFrame:
    """events(match_id, seq, action) -> the state that the last valid action left.

    An action that the state before it does not allow changes nothing.  Actions are dealt by ranges of (match, number), and each range is folded into a map of the five states to the
    five states; a match is composed of as many maps as ranges it lies in, so one of any number of actions neither fills a task nor an array."""
    kind = events.schema["match_id"].dataType.simpleString()
    ranged = events.select("match_id", "action", "seq").repartitionByRange("match_id", "seq").sortWithinPartitions("match_id", "seq", "action")
    maps = ranged.select("match_id", "action").mapInArrow(_maps, f"match_id {kind}, part int, map string, n bigint")
    whole = maps.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("m"), F.sum("n").cast("int").alias("n_actions"))
    last = F.aggregate("m", F.lit("0"), lambda s, x: F.substring(x["map"], s.cast("int") + 1, F.lit(1)))
    return whole.select("match_id", F.element_at(F.array(*map(F.lit, STATES)), last.cast("int") + 1).alias("state"), "n_actions")


def doubly_used(members: DataFrame) -> DataFrame:
    """members(match_id, member_key) of confirmed matches -> members that two of them hold."""
    return members.groupBy("member_key").agg(F.count_distinct("match_id").alias("n")).where("n > 1")


def match_counts(matches: DataFrame, categories: list[str]) -> DataFrame:
    """Proposed matches by category, and confirmed and rejected ones; those without any at 0."""
    label = F.when(F.col("state") == "proposed", F.col("category")).when(F.col("state").isin("confirmed", "rejected"), F.col("state"))
    counted = matches.groupBy(label.alias("label")).agg(F.count("*").alias("n")).where("label IS NOT NULL")
    known = matches.sparkSession.createDataFrame([(c,) for c in [*categories, "confirmed", "rejected"]], "label string")
    return known.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def confirmed_kinds(members: DataFrame) -> DataFrame:
    """members(match_id, member_key, kind invoice|txn) -> per transaction whether its match has an invoice."""
    has = F.max((F.col("kind") == "invoice").cast("int")).over(Window.partitionBy("match_id"))
    return members.withColumn("_i", has).where("kind = 'txn'").select("match_id", "member_key", F.when(F.col("_i") == 1, "reconciled").otherwise("no_invoice").alias("as"))


def matched_cash(members: DataFrame, txns: DataFrame) -> DataFrame:
    """Per confirmed invoice: cash of the transactions of its match, and the last day of these."""
    inv = members.where("kind = 'invoice'").select("match_id", F.col("member_key").alias("hash"))
    cash = members.where("kind = 'txn'").join(txns, members["member_key"] == txns["txn_key"]).groupBy("match_id").agg(total(F.col("amount")).alias("cash"), F.max("date").alias("paid_on"), F.count("*").alias("n_txns"))
    return inv.join(cash, "match_id").select("hash", "cash", "paid_on", "n_txns")


def search(invoices: DataFrame, needle: str, limit: int = 40) -> DataFrame:
    """Invoices whose number, vendor or amount holds the text, unmatched ones first; one row more than `limit` tells that there are more."""
    low = needle.lower()
    hit = F.contains(F.lower("invoice_no"), F.lit(low)) | F.contains(F.lower("vendor"), F.lit(low)) | F.contains(F.col("amount").cast("string"), F.lit(low))
    return invoices.where(hit).orderBy(F.col("matched"), "hash").limit(limit + 1)


def direction_of(own: list[str], issuer: Column, customer: Column) -> Column:
    """AR where one of one's own names is in the issuer's, AP where it is in the customer's, else AP."""
    has = lambda c: F.exists(F.array(*[norm_key(F.lit(o)) for o in own]), lambda o: (o != "") & F.contains(norm_key(F.coalesce(c, F.lit(""))), o)) if own else F.lit(False)
    return F.when(has(issuer), "AR").otherwise("AP")


def valid_manual(lines: DataFrame, chart: DataFrame) -> DataFrame:
    """lines(entry_id, account, debit, credit) -> per entry whether it may be posted: two lines or more, known accounts, one positive side each, balanced."""
    known = lines.join(F.broadcast(chart.select(F.col("code").alias("account"), F.lit(True).alias("_known"))), "account", "left")  # a chart has some dozens of rows
    one_side = ((F.col("debit") > 0) & (F.col("credit") == 0)) | ((F.col("credit") > 0) & (F.col("debit") == 0))
    checks = known.groupBy("entry_id").agg(F.count("*").alias("n"), F.bool_and(F.col("_known").isNotNull() & one_side).alias("ok"), (total(F.col("debit")) == total(F.col("credit"))).alias("balanced"))
    return checks.select("entry_id", ((F.col("n") >= 2) & F.col("ok") & F.col("balanced")).alias("valid"))


def into_closed_periods(lines: DataFrame, closed: DataFrame) -> DataFrame:
    """Entries dated into a closed period; closing entries themselves may be."""
    period = F.coalesce(F.date_format("entry_date", "yyyy-MM"), F.lit("0000-00"))
    return lines.where("source_kind <> 'closing'").withColumn("period", period).join(closed.select("period"), "period", "left_semi").select("entry_id", "period").distinct()


def periods(lines: DataFrame, closed: DataFrame) -> DataFrame:
    seen = lines.select(F.coalesce(F.date_format("entry_date", "yyyy-MM"), F.lit("0000-00")).alias("period")).distinct()
    marks = closed.select("period", F.lit("closed").alias("_s")).distinct()
    return seen.join(marks, "period", "left").select("period", F.coalesce("_s", F.lit("open")).alias("status"))


def statement_entries(txns: DataFrame, posted: DataFrame) -> DataFrame:
    """txns(txn_key, date, amount, incoming, counter) -> two lines each against the bank; refused: cash or control accounts as counter, and what is posted already."""
    free = txns.where(~F.col("counter").isin("1001", "1002", "1012", "1100", "2100") & (F.col("amount") > 0)).join(posted.select("txn_key").distinct(), "txn_key", "left_anti")
    amount, zero = F.col("amount").cast(MONEY), F.lit(0).cast(MONEY)
    line = lambda account, debit: F.struct(account.alias("account"), F.when(debit, amount).otherwise(zero).alias("debit"), F.when(debit, zero).otherwise(amount).alias("credit"))
    lines = F.array(line(F.lit("1002"), F.col("incoming")), line(F.col("counter"), ~F.col("incoming")))
    return free.select(F.concat(F.lit("stmt-"), "txn_key").alias("entry_id"), "date", F.explode(lines).alias("l")).select("entry_id", "date", "l.*")


def opening_lines(rows: DataFrame) -> DataFrame:
    """rows(n, account, party, debit, credit) -> lines against retained earnings, or what is wrong with a row.

    An amount on one side is needed, and a party for receivables and payables; if any row is wrong nothing is to be posted, so all rows come with their error, null where there is none."""
    debit, credit = F.coalesce("debit", F.lit(0)).cast(MONEY), F.coalesce("credit", F.lit(0)).cast(MONEY)
    error = F.when(F.coalesce("account", F.lit("")) == "", "no account").when((debit > 0) & (credit > 0), "both sides").when((debit <= 0) & (credit <= 0), "no amount").when(F.col("account").isin("1100", "2100") & (F.coalesce("party", F.lit("")) == ""), "no party")
    lines = F.array(F.struct(F.col("account").alias("account"), debit.alias("debit"), credit.alias("credit")), F.struct(F.lit("3200").alias("account"), credit.alias("debit"), debit.alias("credit")))
    return rows.select("n", "party", error.alias("error"), F.explode(F.when(error.isNull(), lines).otherwise(F.slice(lines, 1, 1))).alias("l")).select("n", "party", "error", "l.*")
