"""Readers of bank statement formats: text in, transactions out.

Each takes files(file, content) and returns file, idx, date, amount (signed), description and what else the format
has.  The parsing is done with SQL functions on the executors; nothing is read on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.money import parse_amount

# fixed values: canonical columns and the headers that stand for them
HEADERS = {
    "date": ["transactiondate", "date", "postingdate", "bookingdate", "txndate", "valuedate", "entrydate", "date(dd/mm/yyyy)", "dateposted", "receiptdate", "paymentdate", "datetime", "日期", "交易日期", "交易时间", "记账日期", "记账时间", "入账日期", "入账时间", "收款日期", "到账日期", "到账时间", "付款日期", "业务日期", "交易日", "时间"],
    "desc": ["counterpartyname", "description", "narrative", "details", "payee", "memo", "particulars", "narration", "transactiondetails", "remarks", "purpose", "receivedfrom", "payer", "paidby", "remitter", "sender", "beneficiary", "摘要", "摘要说明", "交易摘要", "用途", "备注", "交易描述", "交易类型", "付款方", "付款人", "汇款人", "对方户名", "对方账户", "对方名称", "收款方", "收款人", "对方"],
    "ref": ["bankreference", "reference", "ref", "endtoendid", "chequeno", "transactionref", "凭证号", "流水号"],
    "debit": ["debitamount", "debit", "withdrawal", "withdrawals", "paidout", "dr", "payments", "payment", "moneyout", "outflow", "amountdr", "charges", "charge", "fee", "fees", "支出", "支出金额", "借方", "借方金额", "付款", "付款金额", "取出", "转出", "手续费"],
    "credit": ["creditamount", "credit", "deposit", "deposits", "paidin", "cr", "receipts", "receipt", "moneyin", "inflow", "amountcr", "amountreceived", "received", "收入", "收入金额", "贷方", "贷方金额", "收款", "收款金额", "到账金额", "实收金额", "存入", "转入"],
    "signed": ["signedamount", "amount", "transactionamount", "amountsigned", "netamount", "net", "金额", "金额元", "发生额", "交易金额", "入账金额"],
    "direction": ["收支", "方向", "收支方向", "dc", "drcr", "收付", "借贷", "借贷标志", "借贷方向"],
    "balance": ["closingbalance", "balance", "runningbalance", "ledgerbalance", "bal", "balanceamount", "accountbalance", "availablebalance", "余额", "结余", "账户余额", "卡余额", "账面余额"],
    "opening": ["openingbalance", "broughtforward", "balancebf", "openingbal", "期初余额", "上期余额"],
    "account": ["statementaccountid", "accountid", "accountno", "accountnumber", "accountnum", "account", "iban", "acctno", "acct", "账号", "卡号", "账户", "账户号"],
    "account_name": ["statementaccountname", "accountname", "acctname", "户名", "账户名称", "账户名"],
    "currency": ["currency", "ccy", "curr", "currencycode", "币种", "货币"],
    "status": ["status", "state", "transactionstatus", "txnstatus", "状态", "交易状态"],
}


def header_key(h: str) -> str:
    return "".join(c for c in (h or "").strip().lower() if c not in " \t\n_./-()（）")


def canonical(df: DataFrame) -> DataFrame:
    """df with its columns renamed to canonical ones, where a header is known; the first synonym wins."""
    found = {header_key(c): c for c in df.columns}
    rename = {}
    for target, names in HEADERS.items():
        for n in names:
            if n in found and found[n] not in rename:
                rename[found[n]] = target
                break
    return df.select([F.col(f"`{c}`").alias(rename.get(c, c)) for c in df.columns])


def read_delimited(spark: SparkSession, path: str, *, encoding: str = "UTF-8", separators: tuple[str, ...] = (",", ";", "\t", "|")) -> DataFrame:
    """A statement with a header line, by the separator that yields the most known columns."""
    best = max(separators, key=lambda s: len(set(canonical(spark.read.csv(path, header=True, sep=s, encoding=encoding)).columns) & HEADERS.keys()))
    return canonical(spark.read.csv(path, header=True, sep=best, encoding=encoding))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes in an unknown encoding, which Spark's own decode has not got."""

    def one(data: bytes | None) -> str | None:
        for encoding in ("utf-8-sig", "gb18030", "utf-16"):
            try:
                return None if data is None else data.decode(encoding)
            except UnicodeDecodeError:
                continue
        return data.decode("latin-1")

    return content.map(one)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content, hash) of every file; UTF-8 with or without a mark, else GB 18030, else UTF-16, else Latin-1."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), decoded("content").alias("content"), F.sha2("content", 256).alias("hash"))


def _blocks(files: DataFrame, blocks: Column) -> DataFrame:
    return files.select("file", F.posexplode(blocks).alias("idx", "b"))


def _tag(block: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?i)<{name}>\s*([^<\r\n]*)", 1)), F.lit(""))


def mt940(files: DataFrame) -> DataFrame:
    """Statement lines with their narratives; account, currency and opening balance from the block they stand in."""
    statements = files.select("file", F.posexplode(F.filter(F.split("content", r"(?m)^:20:"), lambda x: F.contains(x, F.lit(":61:")))).alias("stmt", "s"))
    head = statements.select("file", "stmt", F.regexp_extract("s", r"(?m)^:25:(.*)$", 1).alias("account"), F.regexp_extract("s", r"(?m)^:60F:[CD]\d{6}([A-Z]{3,5})", 1).alias("currency"), F.posexplode(F.slice(F.split("s", r"(?m)^:61:"), 2, 2147483647)).alias("idx", "b"))
    pattern = r"^(\d{6})(?:\d{4})?(R?[CD])[A-Z]?(\d+,\d*)"
    sign = F.when(F.regexp_extract("b", pattern, 2).isin("C", "RD"), 1).otherwise(-1)
    amount = F.replace(F.regexp_extract("b", pattern, 3), F.lit(","), F.lit(".")).cast("decimal(18,2)") * sign
    return head.select("file", "stmt", "idx", "account", "currency", F.to_date(F.concat(F.lit("20"), F.regexp_extract("b", pattern, 1)), "yyyyMMdd").alias("date"), amount.cast("decimal(18,2)").alias("amount"), F.trim(F.regexp_extract("b", r"(?m)^:86:(.*)$", 1)).alias("description"))


def ofx(files: DataFrame) -> DataFrame:
    rows = _blocks(files, F.slice(F.split("content", "(?i)<STMTTRN>"), 2, 2147483647))
    return rows.select("file", "idx", F.to_date(F.substring(_tag(F.col("b"), "DTPOSTED"), 1, 8), "yyyyMMdd").alias("date"), _tag(F.col("b"), "TRNAMT").cast("decimal(18,2)").alias("amount"), F.concat_ws(" ", _tag(F.col("b"), "NAME"), _tag(F.col("b"), "MEMO")).alias("description"), _tag(F.col("b"), "FITID").alias("ref"))


def qif(files: DataFrame) -> DataFrame:
    rows = _blocks(files, F.filter(F.split("content", r"(?m)^\^\s*$"), lambda x: x.rlike(r"(?m)^T")))
    code = lambda c: F.nullif(F.trim(F.regexp_extract("b", rf"(?m)^{c}(.*)$", 1)), F.lit(""))
    return rows.select("file", "idx", F.to_date(code("D"), "MM/dd/yyyy").alias("date"), F.replace(code("T"), F.lit(","), F.lit("")).cast("decimal(18,2)").alias("amount"), F.concat_ws(" ", code("P"), code("M")).alias("description"), code("N").alias("ref"))


def camt(files: DataFrame) -> DataFrame:
    rows = _blocks(files, F.regexp_extract_all("content", F.lit(r"(?s)<Ntry>(.*?)</Ntry>"), F.lit(1)))
    sign = F.when(F.regexp_extract("b", r"<CdtDbtInd>(\w+)<", 1) == "CRDT", 1).otherwise(-1)
    return rows.select("file", "idx", F.regexp_extract("b", r"<Dt>(\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("date"), (F.regexp_extract("b", r"<Amt[^>]*>([\d.]+)<", 1).cast("decimal(18,2)") * sign).cast("decimal(18,2)").alias("amount"), F.regexp_extract("b", r"<Ustrd>([^<]*)<", 1).alias("description"), F.regexp_extract("b", r'<Amt[^>]*Ccy="([A-Z]{3,5})"', 1).alias("currency"))


def html_table(files: DataFrame) -> DataFrame:
    """Cells of every table row: (file, idx, cells); tags gone, the five entities of XML read."""
    rows = _blocks(files, F.regexp_extract_all("content", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)))
    plain = lambda c: F.trim(_entities(F.regexp_replace(c, r"<[^>]+>", "")))
    return rows.select("file", "idx", F.transform(F.regexp_extract_all("b", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), plain).alias("cells"))


def _entities(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def table_records(cells: DataFrame) -> DataFrame:
    """(file, idx, record map) of rows below the first one with a date column and one of amount, debit, credit or balance."""
    known = {n: t for t, names in HEADERS.items() for n in names}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    mapped = cells.withColumn("h", F.transform("cells", lambda c: F.try_element_at(table, F.regexp_replace(F.lower(c), r"[\s_./\-()（）]+", ""))))
    is_header = F.array_contains("h", "date") & F.arrays_overlap("h", F.array(*map(F.lit, ("debit", "credit", "signed", "balance"))))
    head = mapped.where(is_header).groupBy("file").agg(F.min_by(F.struct("idx", "h"), "idx").alias("head"))
    rows = mapped.drop("h").join(head, "file").where("idx > head.idx AND size(cells) = size(head.h)")
    pairs = F.filter(F.arrays_zip(F.col("head.h").alias("k"), F.col("cells").alias("v")), lambda p: p["k"].isNotNull())
    return rows.select("file", (F.col("idx") - F.col("head.idx") - 1).alias("idx"), F.map_from_entries(pairs).alias("record"))


def html_statement(files: DataFrame) -> DataFrame:
    r = table_records(html_table(files))
    amount = lambda k: parse_amount(F.col("record")[k])["value"]
    signed = F.coalesce(amount("signed"), F.coalesce(amount("credit"), F.lit(0)) - F.coalesce(amount("debit"), F.lit(0)))
    return r.select("file", "idx", F.col("record")["date"].try_cast("date").alias("date"), signed.cast("decimal(18,2)").alias("amount"), F.col("record")["desc"].alias("description"))


def fixed_width(files: DataFrame) -> DataFrame:
    """Lines of id, date, value date, currency, debit, credit, balance, counterparty, reference; neighbours may touch."""
    pattern = r"^(\S+?)\s*(\d{4}-\d{2}-\d{2})\s*(\d{4}-\d{2}-\d{2})\s*([A-Z]{3,5})\s*(-?[\d,]+\.\d{2})\s*(-?[\d,]+\.\d{2})\s*(-?[\d,]+\.\d{2})\s+(.*?)(?:\s{2,}(\S+))?\s*$"
    rows = files.select("file", F.posexplode(F.filter(F.split("content", r"\r?\n"), lambda x: x.rlike(pattern))).alias("idx", "b"))
    g = lambda i: F.regexp_extract("b", pattern, i)
    n = lambda i: F.replace(g(i), F.lit(","), F.lit("")).cast("decimal(18,2)")
    return rows.select("file", "idx", g(1).alias("id"), g(2).cast("date").alias("date"), g(4).alias("currency"), (n(6) - n(5)).cast("decimal(18,2)").alias("amount"), n(7).alias("balance"), F.trim(g(8)).alias("description"), F.nullif(g(9), F.lit("")).alias("ref"))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON list, of a member `transactions` or `entries`, or of one object per line."""
    df = spark.read.json(path, multiLine=not path.endswith(("ndjson", "jsonl")))
    for member in ("transactions", "entries"):
        if member in df.columns:
            df = df.select(F.explode(member).alias("r")).select("r.*")
    return canonical(df)

