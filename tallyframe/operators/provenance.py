"""Fields with what they come from: sources in order of trust, values that people confirmed, and rules applied again to the documents that they touch.

A candidate is (doc_id, field, source, raw, value, confidence).  A field is an ordered fold of its candidates: a later source replaces only what is empty or unreadable, and what was
overruled stays named, so that any run can say which source won.  Rules are applied again incrementally: a feed of changed rules meets, by keys, only the documents that it
touches, and only those that change get a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.money import parse_amount
from tallyframe.functions.text import norm_key
from tallyframe.operators.pages import accepted

#: Sources, the most trusted first; what people entered is never replaced.
SOURCES = ["manual", "template", "learned_locator", "generic", "learned_default", "recovered"]
#: A value of a weaker source gives way to a learned one below this confidence.
SURE = 0.95

# fixed values: words that no name of a company begins with, and that no address holds
TITLES = ["invoice", "tax invoice", "proforma", "draft", "statement", "receipt", "bill to", "sold to", "ship to", "your invoice", "copy", "original", "void"]
NO_ADDRESS = ["date", "due", "terms", "invoice", "po number", "purchase order", "not for payment", "subtotal", "total due", "line items"]


def looks_like_a_name(s: Column) -> Column:
    """Two to 80 characters that begin with a letter, are no title of a document, no address and no way to reach someone."""
    low = F.lower(F.trim(s))
    title = F.exists(F.array(*map(F.lit, TITLES)), lambda t: (low == t) | low.startswith(F.concat(t, F.lit(" "))))
    return F.length(F.trim(s)).between(2, 80) & low.rlike(r"^[\p{L}]") & ~title & ~low.rlike(r"@|\b\d{4,}\b|\b(?:street|road|avenue|suite|floor|p\.?o\.? box)\b")


def looks_like_an_address(s: Column) -> Column:
    low = F.lower(s)
    return (F.length(F.trim(s)) > 0) & ~F.exists(F.array(*map(F.lit, NO_ADDRESS)), lambda w: F.rlike(low, F.concat(F.lit(r"\b"), w, F.lit(r"\b")))) & ~low.rlike(r"\d\.\d{2}\b|[$€£¥]")


def readable(names: tuple[str, ...] = ("issuer_name",), addresses: tuple[str, ...] = ("issuer_address", "customer_address")) -> Column:
    """Whether a candidate's value can stand: it is there, and a name or an address looks like one."""
    there = F.col("value").isNotNull() & (F.trim(F.coalesce("raw", F.lit(""))) != "")
    return F.coalesce(there & F.when(F.col("field").isin(*names), looks_like_a_name(F.col("raw"))).when(F.col("field").isin(*addresses), looks_like_an_address(F.col("raw"))).otherwise(True), F.lit(False))


def filled(candidates: DataFrame, *, sources: list[str] | None = None, fit: Column | None = None) -> DataFrame:
    """(doc_id, field, raw, value, source, confidence, overruled): the first readable candidate in the order of sources, else the first that has any text.

    Of one source the surest counts, of equally sure ones the least raw text.  overruled are the other sources that had a readable value of their own, in order."""
    order = sources or SOURCES
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    rows = candidates.withColumn("_r", F.when(rank > 0, rank).otherwise(len(order) + 1)).withColumn("_fit", readable() if fit is None else fit)
    rows = rows.where(F.col("_fit") | (F.trim(F.coalesce("raw", F.lit(""))) != ""))
    key = F.struct((~F.col("_fit")).alias("unfit"), "_r", (-F.col("confidence")).alias("c"), "raw")
    best = rows.groupBy("doc_id", "field").agg(F.min_by(F.struct("raw", "value", "source", "confidence"), key).alias("b"), F.array_sort(F.collect_set(F.when(F.col("_fit"), F.struct("_r", "source")))).alias("s"))
    others = F.filter(F.transform("s", lambda x: x["source"]), lambda x: x != F.col("b.source"))
    return best.select("doc_id", "field", "b.*", others.alias("overruled"))


def value_by_label(text: Column, label: Column) -> Column:
    """What stands behind a label on its line, else the line below it; letters of either case, blanks of any number."""
    quoted = F.regexp_replace(F.regexp_replace(F.trim(label), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    beside = F.call_function("regexp_extract", text, F.concat(F.lit(r"(?im)^.*?(?<![\p{L}\p{N}])"), quoted, F.lit(r"[ \t]*[:：#.]?[ \t]*(\S[^\n]*)$")), F.lit(1))
    below = F.call_function("regexp_extract", text, F.concat(F.lit(r"(?im)^.*?(?<![\p{L}\p{N}])"), quoted, F.lit(r"[ \t]*[:：#.]?[ \t]*\r?\n\s*(\S[^\n]*)$")), F.lit(1))
    return F.coalesce(F.nullif(F.trim(beside), F.lit("")), F.nullif(F.trim(below), F.lit("")))


def label_of(text: Column, value: Column) -> Column:
    """The words before a value on its line, without the colon: what a locator learns."""
    quoted = F.regexp_replace(F.trim(value), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    found = F.call_function("regexp_extract", text, F.concat(F.lit(r"(?m)(?:^|\s{2,}|[,;])[ \t]*([\p{L}][\p{L}\p{N} ./#&-]{0,38}?)[ \t]*[:：#]?[ \t]*(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])")), F.lit(1))
    return F.nullif(F.trim(found), F.lit(""))


def default_candidates(documents: DataFrame, defaults: DataFrame) -> DataFrame:
    """documents(doc_id, issuer, text), defaults(issuer, field, value, confirm_count) -> candidates whose value the document's own text holds.

    What was confirmed for an issuer is never filled in blindly.  Surer with each confirmation, up to 0.97."""
    told = documents.join(defaults, "issuer").where((F.col("issuer") != "") & (norm_key(F.col("value")) != "") & F.contains(norm_key(F.col("text")), norm_key(F.col("value"))))
    sure = F.least(F.lit(0.97), 0.88 + 0.02 * F.col("confirm_count"))
    return told.select("doc_id", "field", F.lit("learned_default").alias("source"), F.col("value").alias("raw"), "value", F.round(sure, 6).alias("confidence"))


def locator_candidates(documents: DataFrame, locators: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """documents(doc_id, issuer, fingerprint, text), locators(scope, match_key, field, label, confirm_count) -> candidates: what stands beside the learned label, if it is a value of the field's kind.

    scope is issuer, fingerprint or global; kinds names id, date, amount, code or name for each field.  Joins by key; rules that hold everywhere are few and go to all documents."""
    rules = locators.select("scope", "match_key", "field", "label", "confirm_count")
    by = lambda scope, c: documents.where(F.col(c) != "").join(rules.where(F.col("scope") == scope).withColumnRenamed("match_key", c), c).select("doc_id", "text", "field", "label", "confirm_count")
    every = documents.crossJoin(F.broadcast(rules.where("scope = 'global'").select("field", "label", "confirm_count"))).select("doc_id", "text", "field", "label", "confirm_count")
    met = by("issuer", "issuer").union(by("fingerprint", "fingerprint")).union(every)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("field")), F.lit("name"))
    raw = accepted(kind, value_by_label(F.col("text"), F.col("label")), F.lit(True))
    found = met.withColumn("raw", raw).where("raw IS NOT NULL")
    value = F.when(kind == "amount", parse_amount(F.col("raw"))["value"].cast("string")).otherwise(F.col("raw"))
    return found.select("doc_id", "field", F.lit("learned_locator").alias("source"), "raw", value.alias("value"), F.round(F.least(F.lit(0.95), 0.80 + 0.03 * F.col("confirm_count")), 6).alias("confidence"))


def touched(documents: DataFrame, changed: DataFrame) -> DataFrame:
    """The documents, neither approved nor locked, that a changed rule(scope, match_key) may say something about; each once."""
    open_ = documents.where("coalesce(status, '') <> 'Approved' AND NOT coalesce(locked, false)")
    keys = changed.select("scope", "match_key").distinct()
    by = lambda scope, c: open_.join(keys.where(F.col("scope") == scope).select(F.col("match_key").alias(c)), c, "left_semi").select("doc_id")
    every = open_.join(F.broadcast(keys.where("scope = 'global'").limit(1).select(F.lit(1).alias("_g"))), F.lit(True)).select("doc_id")
    return open_.join(by("issuer", "issuer").union(by("fingerprint", "fingerprint")).union(every).distinct(), "doc_id", "left_semi")


def reapplied(documents: DataFrame, candidates: DataFrame, present: DataFrame, rules: DataFrame, since: Column, *, kinds: dict[str, str], required: tuple[str, ...]) -> DataFrame:
    """New versions of the documents that changed rules change: (doc_id, rev, fields, changed, missing, least_confidence, needs_manual).

    documents(doc_id, issuer, fingerprint, text, status, locked, rev), candidates of extraction and of people, present(doc_id, field, value) as it stands, rules(kind default | locator, scope, match_key, field, value, label, confirm_count, status, at).
    Of the rules that are active all are applied to a document that one changed since then touches, so the result is that of a run over everything.  What people entered stays; a document whose values all stay as they are gets no version."""
    changed = rules.where(F.col("at") >= since)
    docs = touched(documents, changed)
    live = rules.where("status = 'active'")
    told = candidates.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "field", "source", "raw", "value", "confidence")
    defaults = default_candidates(docs.select("doc_id", "issuer", "text"), live.where("kind = 'default'").select(F.col("match_key").alias("issuer"), "field", "value", "confirm_count"))
    located = locator_candidates(docs.select("doc_id", "issuer", "fingerprint", "text"), live.where("kind = 'locator'"), kinds)
    # a generic value that is sure enough stays before a learned one
    told = told.withColumn("source", F.when((F.col("source") == "generic") & (F.col("confidence") >= SURE), "template").otherwise(F.col("source")))
    now = filled(told.unionByName(located).unionByName(defaults))
    entry = F.struct("field", F.struct("value", "source", "confidence").alias("f"))
    per_doc = now.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))
    old = present.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("old"))
    both = docs.select("doc_id", "rev").join(per_doc, "doc_id").join(old, "doc_id", "left")
    names = F.array_sort(F.array_union(F.map_keys("fields"), F.coalesce(F.map_keys("old"), F.array().cast("array<string>"))))
    differ = F.filter(names, lambda n: ~F.try_element_at("fields", n)["value"].eqNullSafe(F.try_element_at("old", n)))
    lacking = F.filter(F.array(*map(F.lit, required)), lambda n: F.try_element_at("fields", n)["value"].isNull())
    least = F.array_min(F.filter(F.transform(F.array(*map(F.lit, required)), lambda n: F.try_element_at("fields", n)["confidence"]), lambda c: c.isNotNull()))
    out = both.withColumn("changed", differ).where("size(changed) > 0").withColumn("missing", lacking)
    sure = F.when(F.size("missing") > 0, 0.0).otherwise(least)
    return out.select("doc_id", (F.col("rev") + 1).alias("rev"), "fields", "changed", "missing", sure.alias("least_confidence"), (F.size("missing") > 0).alias("needs_manual"))
