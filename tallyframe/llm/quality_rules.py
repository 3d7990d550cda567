"""Operator 7: quality rules, compiled from a table of thresholds into one Spark projection.

Measures are SQL expressions over the text and its words; a rule names a measure, its bounds and the number of
words from which it holds.  No user function, no shuffle.

Defined cases: a null or empty text has no words, counts of 0 and ratios null, and fails the base rule; a null
ratio breaks no rule; ties do not arise; repeated rows get a row each; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# fixed values: frequent function words of the languages served
STOP_WORDS = ["the", "of", "and", "to", "a", "in", "is", "that", "for", "with", "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "el", "los", "las", "y", "del", "por", "con", "se", "una"]


class Rule(NamedTuple):
    measure: str
    least: float | None = None
    most: float | None = None
    #: The rule holds for texts of so many words or more.
    from_words: int = 1


#: The thresholds; wide enough for lists, tables and prose of any language.
RULES = (
    Rule("mean_word_chars", least=1.5, most=40.0, from_words=10),
    Rule("symbol_ratio", most=0.3, from_words=10),
    Rule("upper_ratio", most=0.6, from_words=20),
    Rule("exclamation_ratio", most=0.3, from_words=20),
    Rule("stop_word_ratio", least=0.0005, from_words=400),
    Rule("dup_line_ratio", most=0.5, from_words=20),
    Rule("symbol_line_ratio", most=0.9, from_words=20),
    Rule("long_word_ratio", most=0.3, from_words=20),
)


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(id, counts and ratios) of every row, from stacked projections."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0)).alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]")).alias("_lines"))
    # windows of five words by the hashes of their words, in order
    base = base.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    window = F.expr("transform(sequence(0, size(_h) - 5), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4]))")
    base = base.withColumn("_w", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    stops = [*stop_words, *(w.capitalize() for w in stop_words)]
    base = base.withColumn("_p", _packed())
    near = F.expr(f"filter(_p, (x, k) -> (get(_p, k - 1) & {~_AT}L) = (x & {~_AT}L) OR (get(_p, k + 1) & {~_AT}L) = (x & {~_AT}L))")
    base = base.withColumn("_t", near)
    # a row of its own for each text: what is asked of the counts later is answered after them, and not by computing them again
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", rf"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated().cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("_text", r"[^!]+", "")).alias("n_exclamations"),
        F.size(F.filter("_words", lambda w: w.isin(stops))).alias("n_stop_words"),
        F.size("_lines").alias("n_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(rf"^[{SPACE}]*[{SYMBOLS}]"))).alias("n_symbol_lines"),
        F.size(F.filter("_words", lambda w: F.length(w) > 40)).alias("n_long_words"),
    )
    counted = base.select("_id", F.inline(F.array(counts)))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return counted.withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "upper_ratio": ratio("n_upper", "word_chars"),
            "exclamation_ratio": ratio("n_exclamations", "n_words"),
            "stop_word_ratio": ratio("n_stop_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "symbol_line_ratio": ratio("n_symbol_lines", "n_lines"),
            "long_word_ratio": ratio("n_long_words", "n_words"),
        }
    ).withColumnRenamed("_id", id_col)


_AT = (1 << 20) - 1


def _packed() -> Column:
    """Where some window hash repeats: the upper bits of each hash with the window's place below, sorted as plain
    longs.  Null without a repetition, and for texts with more windows than places."""
    return F.expr(f"CASE WHEN size(array_distinct(_w)) < size(_w) AND size(_w) <= {_AT} THEN sort_array(transform(_w, (h, i) -> (h & {~_AT}L) | i)) END")


def _repeated() -> Column:
    """Words inside windows that occur twice or more.

    Windows equal to a neighbour in sorted order are repeated; each adds to the count the words that the one before it
    does not cover.  Should upper bits agree where hashes differ, whole hashes are sorted instead."""
    covered = f"aggregate({{}}, struct(0 AS n, -{WINDOW} AS last), (acc, i) -> struct(acc.n + least({WINDOW}, i - acc.last) AS n, i AS last), acc -> acc.n)"
    places = f"sort_array(transform(_t, x -> cast(x & {_AT} AS int)))"
    unlike = f"exists(sequence(1, size(_t) - 1), k -> (_t[k] & {~_AT}L) = (_t[k - 1] & {~_AT}L) AND _w[cast(_t[k] & {_AT} AS int)] <> _w[cast(_t[k - 1] & {_AT} AS int)])"
    whole = "sort_array(transform(filter(transform(sequence(0, size(s) - 1), k -> struct(s[k].i AS i, (k > 0 AND s[greatest(k - 1, 0)].h = s[k].h) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = s[k].h) AS twice)), x -> x.twice), x -> x.i))"
    whole = f"transform(array(sort_array(transform(_w, (h, i) -> struct(h AS h, i AS i)))), s -> {whole})[0]"
    slow = f"CASE WHEN size(array_distinct(_w)) = size(_w) THEN 0 ELSE {covered.format(whole)} END"
    return F.expr(f"CASE WHEN _t IS NOT NULL AND size(_t) > 1 AND NOT {unlike} THEN {covered.format(places)} ELSE {slow} END")


def breaks(rule: Rule) -> Column:
    value, wrong = F.col(rule.measure), []
    if rule.least is not None:
        wrong.append(value < rule.least)
    if rule.most is not None:
        wrong.append(value > rule.most)
    return F.coalesce((F.col("n_words") >= rule.from_words) & reduce(Column.__or__, wrong), F.lit(False))


def judged(docs: DataFrame, rules: Iterable[Rule] = RULES, **options) -> DataFrame:
    """Counts, base_failed, the names of the broken rules, and kept."""
    rules = list(rules)
    out = measured(docs, **options)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = F.filter(F.array(*[F.when(breaks(r), F.lit(r.measure)) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return out.withColumns({"base_failed": base, "broken_rules": broken}).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
