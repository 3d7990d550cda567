"""Rules that people write as a sentence, read into columns: whose invoices, which field, which value, which account.  What a sentence does not say is named as missing, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: names of fields in sentences
FIELD_NAMES = {
    "issuer_address": ["开票方地址", "issuer address"], "issuer_email": ["开票方邮箱", "issuer email"], "issuer_phone": ["开票方电话", "issuer phone"], "customer_address": ["客户地址", "customer address"], "contact_email": ["客户邮箱", "customer email"], "contact_phone": ["客户电话", "customer phone"],
    "currency_settlement": ["结算币种", "settlement currency"], "subtotal": ["税前金额", "subtotal"], "payment_due": ["应付金额", "amount due"], "total_due": ["总金额", "total"], "invoice_date": ["发票日期", "invoice date"], "invoice_no": ["发票号", "invoice number"], "payment_due_date": ["到期日", "due date"],
    "bank_name": ["开户行", "bank name"], "bank_account_no": ["账号", "account number"], "issuer_name": ["开票方", "issuer"], "customer_name": ["客户", "customer"], "currency": ["币种", "currency"], "sales_tax": ["税额", "tax amount"], "tax_rate": ["税率", "tax rate"], "bank_swift": ["SWIFT"],
}
# fixed values: marks and words that set a value, pairs of quotes, words that a sentence begins with, and words on splitting a file
SETS, FILLS = "=＝:：是为", ["填为", "填成", "填入", "填进", "set to", "fill with"]
QUOTES = [("「", "」"), ("“", "”"), ('"', '"')]
OPENERS = ["以后", "今后", "之后", "往后", "接下来", "凡是", "所有"]
ONE, SEVERAL = ["单张", "当作一张", "合并", "one invoice"], ["多张", "拆开", "分开", "several invoices"]
SPLIT, NOT, MORE = ["拆", "split"], ["不", "别", "not "], ["多", "积极"]

_STOPS = "，,；;。\n"
_IS = rf"(?:\s*[{SETS}]\s*|\s+is\s+)"
_END = rf"(?=[{_STOPS}.]|$)"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def target(text: Column) -> Column:
    """The field that is named first, of names that begin together the longest; `issuer = X` says whose invoices, and names no field."""
    low = F.lower(F.regexp_replace(text, rf"(?i)(?:开票方|\bissuer){_IS}", " "))
    hits = [F.struct(F.locate(n.lower(), low).alias("at"), F.lit(-len(n)).alias("n"), F.lit(field).alias("field")) for field, names in FIELD_NAMES.items() for n in names]
    return F.array_min(F.filter(F.array(*hits), lambda h: h["at"] > 0))["field"]


def value(text: Column) -> Column:
    """What stands in quotes, else behind a word that fills something in."""
    quoted = [_first(text, rf"{a}([^{a}{b}]+){b}") for a, b in QUOTES]
    filled = [_first(text, rf"(?i){w}{_IS}?\s*(\S.*?)\s*{_END}") for w in FILLS]
    return F.coalesce(*quoted, *filled)


def issuer(text: Column) -> Column:
    """X of `issuer = X`, `X 的发票`, `X 家` and `invoices from X`, without the words that a sentence begins with."""
    said = _first(text, rf"(?i)(?:开票方|\bissuer){_IS}([^\s的{_STOPS}]+)")
    english = _first(text, rf"(?i)\binvoices? (?:from|of) (.+?)(?=\s+(?:always|go|goes|are|is|book|to|as|under)\b|[{_STOPS}.]|$)")
    # the last word before the mark
    before = F.when(F.contains(text, F.lit("的发票")), F.substring_index(text, "的发票", 1)).when(F.contains(text, F.lit("家")), F.substring_index(text, "家", 1))
    marked = F.try_element_at(F.split(F.trim(before), rf"[\s的{_STOPS}]+"), F.lit(-1))
    found = F.regexp_replace(F.trim(F.coalesce(said, english, marked)), rf"^(?:{'|'.join(OPENERS)})\s*|家$", "")
    return F.nullif(F.trim(found), F.lit(""))


def many(text: Column) -> Column:
    """single or multi: whether a file is one invoice or several.  A word for splitting counts as its opposite behind a word for not."""
    low = F.lower(text)
    at = F.greatest(*[F.locate(w, low) for w in SPLIT])
    denied = F.exists(F.array(*[F.locate(w, low) for w in NOT]), lambda n: (n > 0) & (n < at))
    return F.when(_any(low, ONE) | denied, "single").when(_any(low, SEVERAL) | ((at > 0) & (_any(low, MORE) | (F.locate("split", low) > 0))), "multi")


def read(rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """rules(id, rule_type, text, match_key), pairs(category, account) -> id, match_key, category, account, target, value, missing.

    A known account that the sentence names counts before a known category, the longer name before the shorter; then what it says behind `account =` and `category =`; then a number of four to six digits.  match_key is the sentence's issuer, else the rule's own."""
    text = F.trim(F.coalesce("text", F.lit("")))
    asked = rules.withColumn("_t", text)
    # pairs are a chart's accounts and what people have confirmed: some hundreds, sent to all rules
    named = asked.select("id", "_t").join(F.broadcast(pairs), F.contains(F.lower("_t"), F.lower("account")) | F.contains(F.lower("_t"), F.lower("category")))
    by_account = F.contains(F.lower("_t"), F.lower("account")) & (F.col("account") != "")
    order = F.struct(by_account.cast("int").alias("a"), F.length(F.when(by_account, F.col("account")).otherwise(F.col("category"))).alias("n"), "category", "account")
    best = named.where(by_account | (F.col("category") != "")).groupBy("id").agg(F.max(F.struct(order.alias("o"), by_account.alias("by_account"))).alias("b")).select("id", F.col("b.o.category").alias("_category"), F.when(F.col("b.by_account"), F.col("b.o.account")).alias("_account"))
    out = asked.join(best, "id", "left")
    account = F.coalesce("_account", _first(F.col("_t"), rf"(?i)(?:科目|\baccount){_IS}(.+?)\s*{_END}"), _first(F.col("_t"), r"(?<!\d)(\d{4,6})(?!\d)"))
    category = F.when(F.col("_account").isNotNull(), F.col("_category")).otherwise(F.coalesce(_first(F.col("_t"), rf"(?i)(?:分类|\bcategory){_IS}(.+?)\s*{_END}"), F.col("_category")))
    kind = F.col("rule_type")
    classes, default, locator, count = kind.isin("classification", "content_class"), kind == "field_default", kind == "field_locator", kind == "multi_invoice"
    out = out.select(
        "id", "rule_type", F.when(kind.isin("classification", "field_default"), F.coalesce(issuer(F.col("_t")), "match_key")).alias("match_key"), F.when(classes, category).alias("category"), F.when(classes, account).alias("account"), F.when(default | locator, target(F.col("_t"))).alias("target"),
        F.when(default | locator, value(F.col("_t"))).when(count, many(F.col("_t"))).when(kind == "classification", None).otherwise(F.nullif(F.col("_t"), F.lit(""))).alias("value"), F.col("_t").alias("note"),
    )
    lacks = [(kind.isin("classification", "field_default"), "match_key"), (classes, "category"), (classes, "account"), (default | locator, "target"), (default | locator | count, "value")]
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(when & F.col(c).isNull(), F.lit(c)) for when, c in lacks])))
