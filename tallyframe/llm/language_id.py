"""Operator 9: language ID as multilingual mixture inference.

Each language is a distribution over hashed byte trigrams of lower-case letters.  A document is a mixture of them:
EM estimates the proportions from the likelihoods of its trigrams, and languages leave the set one by one while the
penalised likelihood (a cost per language, growing with the log of the trigrams) does not fall.

Defined cases: a null text and one without a letter are `und` with score 0, as is every text when nothing could be
learned; equal proportions go to the language that comes first by name; repeated rows get a row each; further
columns are not carried.

Bounds: each language is learned from about `sample` documents at most; the model is a matrix of languages by CELLS.
It holds every value of the column; more than LANGUAGES of them are an error, as the matrix would not fit an executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import checkpointed, remainder, sliced

SAMPLE, CELLS, ROUNDS, PENALTY = 4_000, 1 << 15, 12, 4.0
#: Languages that a model can hold: a matrix of 256 KB for each.
LANGUAGES = 1_000
UNKNOWN = "und"
#: Bytes that no letter's encoding holds count as gaps.
_LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def cells(text: str) -> np.ndarray:
    """Hashed trigrams of the letters; those that span two gaps are left out."""
    data = _LETTERS[np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)]
    gap = data == 32
    keep = ~(gap[1:] & gap[:-1])
    data = data[np.concatenate(([True], keep))]
    if len(data) < 3:
        return np.empty(0, dtype=np.int64)
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Mixture:
    languages: list[str]
    #: chance[k, c]: of cell c in language k
    chance: np.ndarray

    @staticmethod
    def of_counts(counts: dict[str, np.ndarray]) -> Mixture:
        languages = sorted(counts)
        n = np.array([counts[k] for k in languages], dtype=np.float64).reshape(len(languages), CELLS)
        shared = n.sum(axis=0) + 0.01
        # what a language has not shown is guessed from all of them
        smooth = 0.02 * n.sum(axis=1, keepdims=True) * shared / shared.sum() + 1e-3
        n = n + smooth
        return Mixture(languages, n / n.sum(axis=1, keepdims=True))

    def infer(self, text: str) -> tuple[np.ndarray, list[int]]:
        """Proportions of all languages, and the languages chosen."""
        counts = np.bincount(cells(text), minlength=CELLS)
        at = np.flatnonzero(counts)
        k = len(self.languages)
        if not len(at):
            return np.full(k, 1 / k), list(range(k))
        c, p = counts[at].astype(np.float64), self.chance[:, at]
        n = c.sum()
        share, _ = _em(c, p, np.full(k, 1 / k), ROUNDS)
        cost = PENALTY * np.log(n + 1)
        chosen = _worth_a_look(c, p, share, cost)
        share, fit = _em(c, p[chosen], share[chosen] / share[chosen].sum(), ROUNDS)
        while len(chosen) > 1:
            # the least of the chosen has to earn its cost
            order = np.argsort(-share, kind="stable")[:-1]
            fewer = [chosen[i] for i in order]
            less, worse = _em(c, p[fewer], share[order] / share[order].sum(), ROUNDS)
            if fit - worse > cost:
                break
            chosen, share, fit = fewer, less, worse
        out = np.zeros(k)
        out[chosen] = share
        return out, chosen

    def predict(self, text: str | None) -> tuple[str, float, list[str]]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, []
        share, chosen = self.infer(text)
        best = int(np.argmax(share))
        return self.languages[best], float(np.clip(share[best], 0, 1)), [self.languages[i] for i in sorted(chosen)]


def _worth_a_look(c: np.ndarray, p: np.ndarray, share: np.ndarray, cost: float) -> list[int]:
    """The languages, by share, without the least ones that the penalty removes anyway.

    Leaving out a set with responsibilities r loses at most sum c (log(1 - share) - log(1 - r)) of likelihood, as the others
    may still be fitted again; a set that loses less than one language costs never pays."""
    order = np.argsort(share, kind="stable")
    told = np.cumsum(share[order, None] * p[order], axis=0)[:-1] / (share @ p)
    lost = c.sum() * np.log1p(-np.minimum(np.cumsum(share[order])[:-1], 1 - 1e-12)) - np.log1p(-np.minimum(told, 1 - 1e-12)) @ c
    out = int(np.argmax(lost > cost)) if (lost > cost).any() else len(lost)
    return order[out:][::-1].tolist()


def _em(c: np.ndarray, p: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    n = c.sum()
    for _ in range(rounds if len(share) > 1 else 0):
        mixed = share @ p
        new = share * (p @ (c / mixed)) / n
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(c @ np.log(share @ p))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Mixture:
    """Learns from text and non-null language of rows whose crc32(id) mod `modulus` is not `held_out`.

    Of a language with more rows than `sample` a hash of the id chooses."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("id", modulus) != held_out))
    parts = 1 << 20
    rates = rows.groupBy("lang").agg(F.least(F.lit(parts), F.lit(parts * sample) / F.count("*")).alias("rate"))
    rates = checkpointed(rates.select("lang", "rate"))
    n = rates.count()
    if n > LANGUAGES:
        raise ValueError(f"{n} values in {lang_col}; a model holds {LANGUAGES} at most")
    chosen = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("id"), F.lit(parts)) < F.col("rate")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in sliced(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + np.bincount(cells(text), minlength=CELLS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "cell", "n"])

    counted = chosen.mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows per language
    counts = {}
    for lang, own in counted.groupby("lang"):
        counts[lang] = np.zeros(CELLS)
        counts[lang][own["cell"].to_numpy()] = own["n"].to_numpy()
    return Mixture.of_counts(counts)


def predict(docs: DataFrame, model: Mixture, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held_out: int = 1) -> DataFrame:
    """Per document: id, held_out, lang_pred, score (its proportion), langs (the chosen set, by name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages by CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            arrays = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "lang_pred", "score", "langs"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, langs array<string>")
    apart = F.coalesce(remainder("id", modulus) == held_out, F.lit(False))
    return found.select(F.col("id").alias(id_col), apart.alias("held_out"), "lang_pred", "score", "langs")
