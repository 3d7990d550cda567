"""Operator 10: quality classifier, a generalised additive model with pairwise interactions.

Features are counted from the bytes and words of a text and cut into bins at quantiles of a labelled sample.  Cyclic
boosting visits feature after feature: a tree of few leaves over the bins is fitted to the gradient and added to that
feature's lookup table; then the pairs that tell most about what is left get tables of their own in the same way.
A score is the sum of the looked-up values, through a logistic function.

Defined cases: a null or empty text has features of 0; without labels of both kinds every score is the share of
label 1 in the sample (0.5 without any); a score at the threshold counts as 1; repeated rows get a row each;
further columns are not carried by score() and pass through select().

Bounds: the model is fitted on the features of about `sample` labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import labelled_sample, raw, remainder, sliced

SAMPLE, BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, LEAVES = 20_000, 32, 8, 6, 150, 0.1, 3
THRESHOLD = 0.7

FEATURES = ("bytes", "words", "mean_word", "longest_word", "distinct_words", "repeated_neighbours", "top_word", "upper", "digits", "marks", "symbols", "exclamations", "bars", "other_scripts", "lines", "distinct_lines", "mean_line", "ended_lines")

_CLASS = np.zeros(256, dtype=np.uint8)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"#*$%&<>@~^_=+[]{}\\/", b"!", b"|", bytes(range(128, 256)))):
    _CLASS[list(_set)] = _k + 1


def features(text: bytes | None) -> list[float]:
    """Logs of sizes, shares and means, in the order of FEATURES."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=8)[1:] / len(text)
    n, distinct = len(words), set(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:] if n > 1 else []))
    top = max(map(words.count, distinct)) if len(distinct) <= 8 else _top(words)
    # the share of distinct words falls with length; its log against the log of the length does so evenly
    return [
        np.log1p(len(text)), np.log1p(n), len(text) / n, np.log1p(max(map(len, words))), np.log(len(distinct)) / np.log(n + 1), same / n, top / n,
        *counts, np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
    ]


def _top(words: list[bytes]) -> int:
    seen: dict[bytes, int] = {}
    get = seen.get
    for w in words:
        seen[w] = get(w, 0) + 1
    return max(seen.values())


@dataclass
class Additive:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: float, h: float, ridge: float = 1.0) -> float:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A value per bin: the best binary splits of a run of bins, one after the other, up to so many leaves."""
    gc, hc = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    gain = lambda a, b: (gc[b] - gc[a]) ** 2 / (hc[b] - hc[a] + 1.0)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gains = gain(a, cut) + gain(cut, b) - gain(a, b)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], (a, b), int(cut[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(gc[b] - gc[a], hc[b] - hc[a])
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid of bins into four quarters: its gain, and a value per cell."""
    total = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    gc, hc = total(g), total(h)
    best, cell = 0.0, np.zeros(g.shape)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            quarters = []
            for a, b, c, d in ((0, i, 0, j), (0, i, j, None), (i, None, 0, j), (i, None, j, None)):
                b, d = g.shape[0] if b is None else b, g.shape[1] if d is None else d
                gs, hs = (m[b, d] - m[a, d] - m[b, c] + m[a, c] for m in (gc, hc))
                quarters.append((a, b, c, d, gs, hs))
            gain = sum(gs * gs / (hs + 1.0) for *_, gs, hs in quarters)
            if gain > best:
                best, cell = gain, np.zeros(g.shape)
                for a, b, c, d, gs, hs in quarters:
                    cell[a:b, c:d] = _leaf(gs, hs)
    return best, cell


def fit_additive(x: np.ndarray, y: np.ndarray, *, bins: int = BINS, pair_bins: int = PAIR_BINS, pairs: int = PAIRS, rounds: int = ROUNDS, rate: float = RATE, leaves: int = LEAVES) -> Additive:
    model = Additive()
    if not len(y):
        return model
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model.intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    columns = range(x.shape[1])
    model.edges = [_edges(x[:, j], bins) for j in columns]
    model.coarse = [_edges(x[:, j], pair_bins) for j in columns]
    fine = [np.searchsorted(model.edges[j], x[:, j], "right") for j in columns]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.full(len(y), model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in columns:
            g, h = gradient()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(fine[j], g, n), np.bincount(fine[j], h, n), leaves)
            model.tables[j] += step
            logit += step[fine[j]]
    rough = [np.searchsorted(model.coarse[j], x[:, j], "right") for j in columns]

    def grid(a: int, b: int, w: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(rough[a] * shape[1] + rough[b], w, shape[0] * shape[1]).reshape(shape)

    g, h = gradient()
    gains = sorted(((_cross(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in combinations(columns, 2)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(rounds // 3):
        for k, (a, b) in enumerate(model.pairs):
            g, h = gradient()
            step = rate * _cross(grid(a, b, g), grid(a, b, h))[1]
            model.pair_tables[k] += step
            logit += step[rough[a], rough[b]]
    return model


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array([features(t) for t in raw(batch.column(column))], dtype=np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", modulus: int = 4, held_out: int = 2, sample: int = SAMPLE) -> Additive:
    """Learns labels from rows whose crc32(id) mod `modulus` is not `held_out`, of about `sample` rows at most."""
    rows = labelled_sample(docs, labels, label, remainder("_id", modulus) != held_out, sample, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_rows(batch, 0).tolist(), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = rows.select("text", "_y").mapInArrow(run, "x array<double>, y int").toPandas()  # about `sample` rows of numbers
    got = got.sort_values("x", key=lambda c: c.map(tuple), ignore_index=True)  # sums in one order, whatever the partitions
    return fit_additive(np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES)), got["y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Additive, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(_rows(batch, 1)))], names=["id", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    scored = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    apart = F.coalesce(remainder("id", modulus) == held_out, F.lit(False))
    return scored.select(F.col("id").alias(id_col), apart.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def select(docs: DataFrame, model: Additive, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their own columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield batch.filter(pa.array(shared.value.scores(_rows(batch, batch.schema.get_field_index(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
