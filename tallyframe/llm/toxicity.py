"""Operator 1: toxicity by weak supervision.

Voters: entries of a fixed lexicon, disguised spellings of it, shouting patterns, and word stems that the labelled
sample ties to the label.  A generative label model over all voters (the annotation is one more, fallible voter) is
fitted by EM, silence counted as speech is: each voter's accuracy given the latent class, and the correlations of a
maximum spanning tree of conditional mutual information.  Its posterior labels train a linear (logistic) classifier on what the voters and
weaker stems find; the classifier alone scores documents.

Defined cases: a null or empty text has no votes and gets the score of the intercept; without labels the lexicon's
votes stand in for the annotation; ties at the threshold count as toxic; repeated rows get a row each; further
columns are not carried by score() and pass through reject().

Bounds: the model is fitted on about `sample` labelled rows and has at most `voters` + `features` stems; candidate
stems are counted over that whole sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import labelled_sample, remainder, sliced

SAMPLE, VOTERS, FEATURES = 20_000, 120, 200
#: Stems that are taken to the driver, the most telling first.
CANDIDATES = 5_000
STEM = range(3, 9)
#: Least log-likelihood ratio of a stem that votes.
EVIDENCE = 30.0
THRESHOLD = 0.5
#: Tokens, or stems and their counts, that a worker holds at once.
REMEMBERED = 100_000
#: Bytes of text that a worker holds as Python strings at once.
TEXT_BYTES = 1 << 20

# fixed values: common English insults
LEXICON = ("bastard", "clown", "coward", "creep", "cretin", "degenerate", "disgusting", "dumb", "dumbass", "filth", "filthy", "freak", "garbage", "idiot", "idiotic", "imbecile", "jerk", "liar", "loser", "moron", "moronic", "parasite", "pathetic", "pig", "retard", "scum", "scumbag", "shithead", "slut", "stupid", "subhuman", "trash", "useless", "vermin", "whore", "worthless")
_WORDS = frozenset(LEXICON)
_PUNCTUATION = "\"'()[]{}<>.,;:!?¡¿…«»“”‘’-_/\\|#&%+=~`^"
_DISGUISE = str.maketrans("013457@$!", "oieastasi")
PATTERNS = ("~plural", "~disguised", "~masked", "~drawn_out")
WHOLE = ("~shouting", "~exclaiming")


def _collapsed(word: str) -> str:
    return "".join(c for i, c in enumerate(word) if i < 2 or not c == word[i - 1] == word[i - 2])


def votes_of(token: str, stems: dict[str, int] | frozenset) -> list[str]:
    """What one lower-case token says."""
    word = token.strip(_PUNCTUATION)
    if not word:
        return []
    said = [word] if word in _WORDS else []
    if not said:
        plain = word.translate(_DISGUISE)
        if word[-1] == "s" and word[:-1] in _WORDS:
            said.append("~plural")
        elif plain != word and plain in _WORDS:
            said.append("~disguised")
        elif "*" in word and any(len(x) == len(word) and all(a in ("*", b) for a, b in zip(word, x, strict=True)) for x in LEXICON) and word.strip("*"):
            said.append("~masked")
        elif len(word) > 4 and (short := _collapsed(word)) != word and (short in _WORDS or "".join(c for i, c in enumerate(short) if not i or c != short[i - 1]) in _WORDS):
            said.append("~drawn_out")
    return said + [s for n in STEM if n <= len(word) and (s := word[:n] + "…") in stems]


def whole_votes(text: str) -> list[str]:
    words = text.split()
    shouted = sum(map(str.isupper, words))
    return ["~shouting"] * (shouted >= 4 and shouted > 0.7 * len(words)) + ["~exclaiming"] * ("!!!" in text)


class Reader:
    """Counts of votes per text; remembers what tokens say."""

    def __init__(self, names: list[str]):
        self.at = {n: i for i, n in enumerate(names)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[Counter, int]:
        if not text:
            return Counter(), 0
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, tokens, found = self.known, text.lower().split(), []
        for token in tokens:
            said = known.get(token)
            if said is None:
                said = known[token] = tuple(self.at[v] for v in votes_of(token, self.at) if v in self.at)
            if said:
                found += said
        return Counter(found + [self.at[v] for v in whole_votes(text) if v in self.at]), len(tokens)


def stems(sample: DataFrame, limit: int) -> list[tuple[str, float, float]]:
    """(stem, log-likelihood ratio, share of toxic) of the stems most tied to the label; counted per document, summed per partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad = Counter(), Counter()
        for batch in sliced(batches, "text"):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {t.strip(_PUNCTUATION) for t in (text or "").lower().split()}
                own = {w[:k] for w in words for k in STEM if k <= len(w)}
                n.update(own)
                if y:
                    bad.update(own)
            if len(n) > REMEMBERED:
                yield _counts(n, bad)
                n, bad = Counter(), Counter()
        yield _counts(n, bad)

    total, positive = sample.agg(F.count("*"), F.sum("_y")).first()
    if not total or not positive or positive == total:
        return []
    counted = sample.mapInArrow(run, "stem string, n bigint, bad bigint").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    base = F.lit(positive / total)
    share = F.col("bad") / F.col("n")
    term = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(0.0)
    ratio = 2 * (term(F.col("bad"), share, base) + term(F.col("n") - F.col("bad"), 1 - share, 1 - base))
    best = counted.where((F.col("n") >= 3) & (share > base)).select("stem", ratio.alias("g"), share.alias("p")).where("g > 6").orderBy(F.desc("g"), "stem").limit(limit)
    return [(r["stem"], r["g"], r["p"]) for r in best.collect()]


def _counts(n: Counter, bad: Counter) -> pa.RecordBatch:
    keys = list(n)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], names=["stem", "n", "bad"])


def _unlike(found: list[tuple[str, float, float]]) -> list[tuple[str, float, float]]:
    """Without stems that begin a better one or go on from it, as they tell the same."""
    taken: set[str] = set()
    begun: set[str] = set()
    out = []
    for stem, g, p in found:
        if stem not in begun and not any(stem[:n] in taken for n in STEM):
            out.append((stem, g, p))
            taken.add(stem)
            begun.update(stem[:n] for n in STEM if n <= len(stem))
    return out


class LabelModel:
    """A latent class with voters that fire or not; each depends on the class and on at most one other voter.

    Silence counts in the likelihood as speech does.  Both steps of EM serve that one likelihood, with a weak Beta
    prior at each voter's own rate, and under the bound that a voter fires no less often in its class; so its value
    (`trace`, once per round) never falls while the voters' tree stays the same.  The last `free` voters are bound by
    nothing and stand outside the tree: an annotation, if there is one, is such a voter."""

    def __init__(self, rounds: int = 15, smooth: float = 1.0):
        self.rounds, self.smooth = rounds, smooth

    def fit(self, votes: np.ndarray, start: np.ndarray, prior: float | None = None, free: int = 2) -> np.ndarray:
        """votes: 0/1, rows by voters; start: first guess of the posterior.  The posterior of class 1.

        prior is the share of class 1, by default that of the last voter: speech alone does not tell it."""
        votes = votes.astype(np.float64)
        self.free = free
        self.parent = np.full(votes.shape[1], -1)
        self.usual = (votes.sum(axis=0) + 0.5) / (len(votes) + 1)
        share = (votes[:, -1].sum() + 1) / (len(votes) + 2) if prior is None else prior
        self.prior = float(np.clip(share, 1e-4, 1 - 1e-4))
        self.trace: list[float] = []
        q = start
        for k in range(self.rounds):
            if k == self.rounds // 3:
                self.parent = self._tree(votes, q, free)
                self.trace = []
            self._estimate(votes, q)
            q = self.posterior(votes)
            self.trace.append(self.likelihood(votes))
        return q

    def _estimate(self, votes: np.ndarray, q: np.ndarray) -> None:
        """chance[y, u, j]: that voter j fires given class y and its parent's vote u."""
        up = np.where(self.parent >= 0, votes[:, self.parent], 0.0)
        fired, seen = np.empty((2, 2, votes.shape[1])), np.empty((2, 2, votes.shape[1]))
        for y, w in enumerate((1 - q, q)):
            for u, at in enumerate((1 - up, up)):
                fired[y, u] = w @ (at * votes) + self.smooth * self.usual
                seen[y, u] = w @ at + self.smooth
        self.chance = fired / seen
        # where the bound is broken, its best values are those of both classes together
        pooled = fired.sum(axis=0) / seen.sum(axis=0)
        wrong = self.chance[1] < self.chance[0]
        wrong[:, votes.shape[1] - self.free :] = False
        self.chance = np.clip(np.where(wrong[None], pooled[None], self.chance), 1e-6, 1 - 1e-6)

    def _joint(self, votes: np.ndarray) -> np.ndarray:
        """Log chances of class and votes, for both classes."""
        up = votes[:, self.parent] * (self.parent >= 0)
        out = []
        for y in (0, 1):
            on, off = np.log(self.chance[y]), np.log1p(-self.chance[y])
            # one product per value of the parent, as most votes are silence
            base = off[0].sum() + votes @ (on[0] - off[0])
            more = up @ (off[1] - off[0]) + (up * votes) @ (on[1] - off[1] - on[0] + off[0])
            out.append(base + more + np.log(self.prior if y else 1 - self.prior))
        return np.array(out)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = self._joint(votes)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))

    def likelihood(self, votes: np.ndarray) -> float:
        """Of the votes, with the prior on the chances; what both steps raise."""
        told = np.logaddexp(*self._joint(votes)).sum()
        return float(told + self.smooth * (self.usual * np.log(self.chance) + (1 - self.usual) * np.log1p(-self.chance)).sum())

    @staticmethod
    def _tree(votes: np.ndarray, q: np.ndarray, free: int) -> np.ndarray:
        """Parents in a maximum spanning forest of the voters' mutual information given the class."""
        j = votes.shape[1]
        info = np.zeros((j, j))
        for w in (1 - q, q):
            n = w.sum() + 1e-9
            both = (votes * w[:, None]).T @ votes / n
            one = np.diag(both)
            for joint, a, b in ((both, one[:, None], one[None, :]), (one[:, None] - both, one[:, None], 1 - one[None, :]), (one[None, :] - both, 1 - one[:, None], one[None, :]), (1 - one[:, None] - one[None, :] + both, 1 - one[:, None], 1 - one[None, :])):
                joint, expect = np.clip(joint, 1e-12, 1), np.clip(a * b, 1e-12, 1)
                info += n / len(q) * joint * np.log(joint / expect)
        np.fill_diagonal(info, 0)
        parent, inside = np.full(j, -1), np.zeros(j, bool)
        best, link = np.full(j, -1.0), np.full(j, -1)
        for _ in range(j):
            k = int(np.argmax(np.where(inside, -2, best)))
            inside[k] = True
            if link[k] >= 0 and best[k] > 4 / len(q):
                parent[k] = link[k]
            closer = ~inside & (info[k] > best)
            best[closer], link[closer] = info[k][closer], k
        parent[j - free :] = -1
        parent[parent >= j - free] = -1
        return parent


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 20) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the intercept last and not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Model:
    names: list[str]
    #: Whether a name votes, or is a feature of the classifier alone.
    votes: np.ndarray
    weights: np.ndarray
    accuracy: dict[str, tuple[float, float]]
    correlated: list[tuple[str, str]]

    def rows(self, texts: list[str | None], read: Reader) -> np.ndarray:
        x = np.zeros((len(texts), len(self.names) + 2), dtype=np.float32)
        for i, text in enumerate(texts):
            found, n = read(text)
            if found:
                x[i, list(found)] = 1
                hits = sum(c for k, c in found.items() if self.votes[k])
                x[i, -2:] = np.log1p(hits), np.log1p(1000 * hits / n)
        return x

    def scores(self, texts: list[str | None], read: Reader) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.rows(texts, read) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", modulus: int = 5, held_out: int = 0, sample: int = SAMPLE, voters: int = VOTERS, features: int = FEATURES, annotated: bool = True) -> Model:
    """Learns labels from rows whose crc32(id) mod `modulus` is not `held_out`, of about `sample` rows at most.

    With annotated=False the label itself is no voter: it chooses the stems and the balance of the classes alone."""
    rows = labelled_sample(docs, labels, label, remainder("_id", modulus) != held_out, sample, id_col, text_col)
    found = _unlike(stems(rows, CANDIDATES))
    voting = [s for s, g, p in found if g >= EVIDENCE and p >= 0.5][:voters]
    others = [s for s, _, _ in found if s not in set(voting)][:features]
    names = [*LEXICON, *PATTERNS, *WHOLE, *(s + "…" for s in voting + others)]
    votes = np.arange(len(names)) < len(names) - len(others)
    model = Model(names, votes, np.zeros(len(names) + 3), {}, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(names)
        for batch in sliced(batches, "text"):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, n = read(text)
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([n], pa.int64()), pa.array([list(seen.items())], pa.map_(pa.int32(), pa.int32()))], names=["y", "n", "seen"])

    got = rows.mapInArrow(run, "y int, n bigint, seen map<int,int>").toPandas()  # about `sample` rows of hits
    x, y = np.zeros((len(got), len(names) + 2)), got["y"].to_numpy(dtype=float)
    for i, (n, seen) in enumerate(zip(got["n"], got["seen"], strict=True)):
        seen = dict(seen)
        if seen:
            x[i, list(seen)] = 1
            hits = sum(c for k, c in seen.items() if votes[k])
            x[i, -2:] = np.log1p(hits), np.log1p(1000 * hits / max(1, n))
    # rows come in the order of their tasks: sorted, the sums below are the same to the last digit in every run
    order = np.lexsort(np.vstack([x.T, y]))
    x, y = x[order], y[order]
    if not len(y) or y.min() == y.max():  # nothing to learn from: any vote counts
        model.weights[: len(names)] = np.where(votes, 4.0, 0.0)
        model.weights[-1] = -3.0
        return model
    fired = x[:, : len(names)][:, votes]
    # EM begins where the voters point; the annotation is one more, fallible voter and nothing else
    start = np.where(fired.any(axis=1), 0.9, 0.1)
    fired = np.column_stack([fired, y]) if annotated else fired
    label_model = LabelModel()
    posterior = label_model.fit(fired, start, float(y.mean()), free=int(annotated))
    own = [n for n, v in zip(names, votes, strict=True) if v] + ["(annotation)"] * annotated
    model.accuracy = {n: (float(label_model.chance[0, 0, i]), float(label_model.chance[1, 0, i])) for i, n in enumerate(own)}
    model.correlated = [(own[i], own[p]) for i, p in enumerate(label_model.parent) if p >= 0]
    model.weights = logistic(x, posterior)
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOTERS + FEATURES names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        read = Reader(model.names)
        for batch in sliced(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist(), read).astype(float), pa.float64())], names=["id", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    scored = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    apart = F.coalesce(remainder("id", modulus) == held_out, F.lit(False))
    return scored.select(F.col("id").alias(id_col), apart.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their own columns, that the classifier does not call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        read = Reader(model.names)
        for batch in sliced(batches, text_col, TEXT_BYTES):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array(model.scores(texts, read) < threshold))

    return docs.mapInArrow(run, docs.schema)
