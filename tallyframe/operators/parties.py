"""Master data of counterparties: names, roles, aliases, and who may be the same."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import jaccard, party_key
from tallyframe.session import checkpointed

SUGGEST, SAME, TOP = 0.62, 0.86, 5
ROLES = ["self", "vendor", "customer"]


def roles(kind: Column) -> Column:
    """The roles in a text as `self,vendor,customer`, in that order; `both` is vendor and customer."""
    said = F.transform(F.split(F.regexp_replace(F.coalesce(kind, F.lit("")), "[+，]", ","), ","), lambda x: F.lower(F.trim(x)))
    has = lambda r: F.array_contains(said, r) | (F.array_contains(said, "both") if r != "self" else F.lit(False))
    return F.array_join(F.array_compact(F.array(*[F.when(has(r), F.lit(r)) for r in ROLES])), ",")


def party_rollup(mentions: DataFrame) -> DataFrame:
    """mentions(name, role, ord): per key its first spelling, its roles, and how often it is named."""
    keyed = mentions.withColumn("norm", party_key(F.col("name"))).where("norm <> ''")
    out = keyed.groupBy("norm").agg(F.min_by("name", "ord").alias("name"), F.count("*").alias("n"), F.bool_or(F.col("role") == "vendor").alias("v"), F.bool_or(F.col("role") == "customer").alias("c"))
    return out.select("norm", "name", "n", F.when(F.col("v") & F.col("c"), "both").when(F.col("v"), "vendor").otherwise("customer").alias("role"))


def self_candidates(mentions: DataFrame, registered: DataFrame) -> DataFrame:
    """Names on both sides of documents that no party has: perhaps one's own company."""
    both = party_rollup(mentions).where("role = 'both'")
    return both.join(registered.select(party_key(F.col("name")).alias("norm")).distinct(), "norm", "left_anti").select("norm", "name", "n")


def resolve(names: DataFrame, parties: DataFrame, aliases: DataFrame) -> DataFrame:
    """names(name) with party_id: the party of that key (the least id of several), else that of an alias; active parties alone."""
    active = parties.where(F.coalesce("status", F.lit("active")) == "active").select("party_id", party_key(F.col("name")).alias("norm"))
    direct = active.groupBy("norm").agg(F.min("party_id").alias("_direct"))
    by_alias = aliases.select(party_key(F.col("alias")).alias("norm"), "party_id").join(active.select("party_id"), "party_id", "left_semi").groupBy("norm").agg(F.min("party_id").alias("_alias"))
    keyed = names.withColumn("norm", party_key(F.col("name")))
    return keyed.join(direct, "norm", "left").join(by_alias, "norm", "left").withColumn("party_id", F.coalesce("_direct", "_alias")).drop("_direct", "_alias")


def _prefixes(keys: DataFrame, key: str, counts: DataFrame, least: float) -> DataFrame:
    """keys with t: the rarest tokens of each, as many as an overlap of `least` cannot do without."""
    tokens = keys.select(key, F.explode(F.array_distinct(F.split(key, " "))).alias("t")).join(counts, "t", "left")
    ordered = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t"))).alias("ts"))  # the words of one name
    size = F.size("ts")
    return ordered.select(key, F.explode(F.slice("ts", F.lit(1), (size - F.ceil(size * least) + 1).cast("int"))).alias("x")).select(key, "x.t")


def _pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct keys a and b that may overlap by `least`: prefix filtering, which misses none.

    Tokens are ordered by rarity, so that frequent ones (`customer`) hardly ever bring names together."""
    counts = right.select(F.explode(F.array_distinct(F.split("b", " "))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return _prefixes(left, "a", counts, least).join(_prefixes(right, "b", counts, least), "t").select("a", "b").distinct()


def _keys(names: DataFrame, parties: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct keys asked (a), and keys of active parties, by name and by alias (party_id, b)."""
    left = names.select(party_key(F.col("name")).alias("a")).where("a <> ''").distinct()
    active = parties.where(F.coalesce("status", F.lit("active")) == "active") if "status" in parties.columns else parties
    right = active.select("party_id", party_key(F.col("name")).alias("b"))
    if aliases is not None:
        right = right.unionByName(aliases.select("party_id", party_key(F.col("alias")).alias("b")).join(active.select("party_id"), "party_id", "left_semi"))
    return left, right.where("b <> ''").distinct()


def _best(found: DataFrame, top: int) -> DataFrame:
    """found(a, party_id, b, score) -> the best `top` parties of each name; a party counts by the best of its keys (of equal ones the first)."""
    one = found.groupBy("a", "party_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("k")).select("a", "party_id", F.col("k.b").alias("b"), (-F.col("k.s")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "party_id"))
    ranked = one.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select(F.col("a").alias("norm"), "party_id", F.col("b").alias("party_norm"), "score", "rank", (F.col("score") >= SAME).alias("likely_same"))


def _overlapping(left: DataFrame, firsts: DataFrame, least: float) -> DataFrame:
    """(a, party_id, b, score) of the keys whose token sets overlap by `least` or more."""
    scored = _pairs(left, firsts.select("b"), least).withColumn("score", jaccard(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    return scored.join(firsts, "b").select("a", F.explode("ids").alias("party_id"), "b", "score")


def jaccard_candidates(names: DataFrame, parties: DataFrame, aliases: DataFrame | None = None, *, least: float = SUGGEST, top: int = TOP) -> DataFrame:
    """Per name the `top` parties whose token sets, by name or alias, overlap by `least` or more."""
    left, right = _keys(names, parties, aliases)
    firsts = _firsts(right, top)
    return _best(_overlapping(left, firsts, least), top)


#: Names asked that one pass over the parties carries, and columns that characters are counted in.
ASKED, COLUMNS = 4_000, 64


def _letters(keys: list[str]) -> np.ndarray:
    """How often each key has characters of each column; unlike characters may share one, which only raises the bound."""
    out = np.zeros((len(keys), COLUMNS), dtype=np.int32)
    for row, key in enumerate(keys):
        for c, n in Counter(key).items():
            out[row, ord(c) % COLUMNS] += n
    return out


def _firsts(right: DataFrame, top: int) -> DataFrame:
    """(b, ids): of each key the `top` least parties.  No other party of a key can be among the best `top` of a name by it, as these come before it."""
    rank = F.row_number().over(Window.partitionBy("b").orderBy("party_id"))
    return right.withColumn("_r", rank).where(F.col("_r") <= top).groupBy("b").agg(F.array_sort(F.collect_list("party_id")).alias("ids"))


def _alike(asked: list[str], firsts: DataFrame, least: float, top: int) -> DataFrame:
    """(a, party_id, b, score) of the names asked and the best `top` parties of each batch of firsts(b, ids), by a sequence ratio of `least` or more.

    The ratio is at most twice the shared characters by the sum of lengths.  Keys are taken from the highest bound down, and a name is done where
    the bound falls below the score of its `top`-th party so far."""
    letters, sizes = _letters(asked), np.array([len(a) for a in asked])
    slack = 1e-9  # a bound may not lose a ratio to rounding
    kind = firsts.schema["ids"].dataType.elementType.simpleString()

    def best(a: str, keys: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> list[tuple]:
        held: dict = {}
        floor = least
        for k in np.argsort(-bounds, kind="stable"):
            if bounds[k] < floor - slack:
                break
            ratio = difflib.SequenceMatcher(None, a, keys[k]).ratio()
            if ratio >= floor:
                for party in ids[k]:
                    held[party] = min(held.get(party, (0.0, "")), (-ratio, keys[k]))
                if len(held) >= top:
                    floor = -sorted(held.values())[top - 1][0]
        ranked = sorted((score, party, b) for party, (score, b) in held.items())[:top]
        return [(a, party, b, -score) for score, party, b in ranked]

    def run(batches):
        for pdf in batches:
            keys, ids = pdf["b"].to_numpy(), pdf["ids"].to_numpy()
            mine, lengths = _letters(keys), np.array([len(b) for b in keys])
            out = []
            for a, counts, size in zip(asked, letters, sizes, strict=True):
                near = np.flatnonzero(2 * np.minimum(lengths, size) >= (least - slack) * (lengths + size))
                bounds = 2 * np.minimum(mine[near], counts).sum(axis=1) / (lengths[near] + size)
                own = bounds >= least - slack
                out += best(a, keys[near[own]], ids[near[own]], bounds[own])
            yield pd.DataFrame(out, columns=["a", "party_id", "b", "score"]).astype({"a": object, "b": object, "score": float})

    return firsts.mapInPandas(run, f"a string, party_id {kind}, b string, score double")


def fuzzy_candidates(names: DataFrame, parties: DataFrame, aliases: DataFrame | None = None, *, least: float = SUGGEST, top: int = TOP, block: int = ASKED) -> DataFrame:
    """As jaccard_candidates, by the better of token overlap and sequence ratio (Ratcliff-Obershelp, which Spark has not).

    The names asked are a set of queries: blocks of about `block` of them go to all tasks, and every party key is held
    against every one, so none is missed.  Names and parties without a key have no row."""
    left, right = _keys(names, parties, aliases)
    # few keys with many parties would come to one task
    firsts = checkpointed(_firsts(right, top).repartition(right.sparkSession.sparkContext.defaultParallelism))
    left = checkpointed(left)
    blocks = -(-left.count() // block)
    found = _overlapping(left, firsts, least)
    for n in range(blocks):
        asked = [r.a for r in left.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == n).collect()]
        found = found.unionByName(_alike(asked, firsts, least, top))
    return _best(found, top)
