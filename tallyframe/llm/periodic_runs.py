"""Operator 11: periodic runs of words, found by masks of repeated k-grams and Main-Lorentz on what survives them.

A run is a stretch of words with smallest period q, at least max(least, 2 q) long, that no neighbouring word extends.  A run
and itself moved by q overlap in at least ceil(least / 2) words, so every word of a run lies in a k-gram of that many
words which the document holds twice.  Words outside such k-grams are masked; what is left falls into segments, and k-grams
that a segment holds once are masked again.  Only the segments are searched, by halves: a run that crosses the middle
has a whole period to the left or to the right of it, so every candidate period is tried there by how far the words agree
forwards and backwards.  Agreement is read from ranks of substrings of 1, 2, 4, ... words, which are exact; the masks use hashes,
whose collisions only let more words survive.  All segments of a slice of documents are halved together in arrays.

Defined cases: a null or wordless text has no words and no runs, and its collapsed text is empty; repeated rows get a row each; further
columns are not carried.  Work on one document grows as n log n, and nothing crosses documents, so there is no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm.common import raw, sliced

LEAST = 12
#: Rounds of masking within segments; fewer leave more words to the search and change no result.
ROUNDS = 4
#: Candidate periods that are looked at together.
CHUNK = 1 << 20

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def overlap(least: int) -> int:
    """Words that a run shares with itself moved by its period, at least."""
    return (least + 1) // 2


def _stretches(mask: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of true words, cut where documents meet; those of `least` words and more."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    begin = np.flatnonzero(mask & np.concatenate(([True], ~mask[:-1] | fresh[1:])))
    end = np.flatnonzero(mask & np.concatenate((~mask[1:] | fresh[1:], [True]))) + 1
    long = end - begin >= least
    return begin[long], end[long]


def _covered(hashes: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their part holds at least twice; part numbers the words, -1 for none."""
    n = len(hashes) - k + 1
    if n < 2:
        return np.zeros(len(hashes), bool)
    odd = np.random.default_rng(11).integers(1, 1 << 63, k + 1, dtype=np.uint64) | np.uint64(1)
    grams = part[:n].astype(np.uint64) * odd[k]
    for j in range(k):
        grams += hashes[j : j + n] * odd[j]
    at = np.flatnonzero((part[:n] == part[k - 1 :]) & (part[:n] >= 0))
    grams = grams[at] ^ (grams[at] >> np.uint64(32))
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[at[twice]] += 1
    edges[at[twice] + k] -= 1  # no place is named twice, so plain indexing adds up
    return np.cumsum(edges[:-1]) > 0


def segments(words: list[bytes], doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the segments that may hold runs."""
    k = overlap(least)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    begin, end = _stretches(_covered(hashes, doc, k), doc, least)
    for _ in range(ROUNDS):
        left = int((end - begin).sum())
        if not left:
            break
        at = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)])
        part = np.repeat(np.arange(len(begin)), end - begin)
        b, e = _stretches(_covered(hashes[at], part, k), part, least)
        begin, end = at[b], at[e - 1] + 1 if len(e) else e
        if int((end - begin).sum()) == left:
            break
    return begin, end


def _ranks(ids: np.ndarray, longest: int) -> np.ndarray:
    """Row j: equal numbers for equal substrings of 2^j ids.  The last id is unique, so substrings cut short by the end equal no other."""
    rows = [ids.astype(np.int32)]
    while 1 << len(rows) <= longest:
        half, now = 1 << (len(rows) - 1), rows[-1].astype(np.int64)
        pairs = now * (int(now.max()) + 2)
        pairs[: len(now) - half] += now[half:] + 1
        rows.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
    return np.stack(rows)


def _forwards(ranks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many ids from a on equal those from b on."""
    n = np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        n += (ranks[j][a + n] == ranks[j][b + n]).astype(np.int64) << j
    return n


def _backwards(ranks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many ids up to a, itself included, equal those up to b; a is before b."""
    n = np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        x, y = a - n - (1 << j) + 1, b - n - (1 << j) + 1
        n += ((x >= 0) & (ranks[j][np.maximum(x, 0)] == ranks[j][np.maximum(y, 0)])).astype(np.int64) << j
    return n


def _crossing(ranks: np.ndarray, mid: np.ndarray, q: np.ndarray, right: bool, least: int) -> np.ndarray:
    """(start, end, q) of the repetitions that cross mid with a period to its right or left; one column for each."""
    a, b = (mid, mid + q) if right else (mid - q, mid)
    need = np.maximum(q, least - q)  # words that agree, forwards and backwards together; one side has half of them
    level = np.minimum(np.frexp((need + 1) // 2)[1] - 1, len(ranks) - 1)
    back = a - (1 << level)
    may = (ranks[level, a] == ranks[level, b]) | ((back >= 0) & (ranks[level, np.maximum(back, 0)] == ranks[level, np.maximum(back + q, 0)]))
    a, b, q, need = a[may], b[may], q[may], need[may]
    f, g = _forwards(ranks, a, b), _backwards(ranks, a - 1, b - 1)
    good = f + g >= need
    return np.stack([a[good] - g[good], b[good] + f[good], q[good]])


def repetitions(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """Runs (start, end, period), a column each, of the segments of ids; the ids around each segment are found nowhere else."""
    found = [np.empty((3, 0), np.int64)]
    ranks = _ranks(ids, int((end - begin).max(initial=1)))
    low, high = begin, end
    while len(low):
        mid = (low + high) // 2
        for right, most in ((False, mid - low), (True, high - mid)):
            ends = np.cumsum(most)
            cut = 0
            while cut < len(most):  # some nodes at a time, so that the arrays stay small
                upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + CHUNK, "right")))
                size = most[cut:upto]
                q = np.arange(1, size.sum() + 1) - np.repeat(np.cumsum(size) - size, size)
                found.append(_crossing(ranks, np.repeat(mid[cut:upto], size), q, right, least))
                cut = upto
        low, high = np.concatenate((low, mid)), np.concatenate((mid, high))
        large = high - low >= least
        low, high = low[large], high[large]
    all_found = np.concatenate(found, axis=1)
    all_found = all_found[:, np.lexsort((all_found[2], all_found[1], all_found[0]))]
    # the same stretch has its smallest period first; others are multiples of it
    first = np.concatenate(([True], (all_found[:2, 1:] != all_found[:2, :-1]).any(axis=0)))[: all_found.shape[1]]
    return all_found[:, first]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    words = [w for t in texts for w in t]
    doc, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    begin, end = segments(words, doc, least)
    if not len(begin):
        return out
    # segments one after the other, with an id of its own before and after each
    known: dict[bytes, int] = {}
    ids, starts = [-1], []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        starts.append(len(ids))
        ids += [known.setdefault(w, len(known)) for w in words[a:b]]
        ids.append(-1)
    own = np.array(ids, np.int64)
    own[own < 0] = len(known) + np.arange(len(starts) + 1)
    at = np.array(starts, np.int64)
    start, stop, period = repetitions(own, at, at + (end - begin), least)
    segment = np.searchsorted(at, start, "right") - 1
    of = doc[begin[segment]]
    place = begin[segment] + start - at[segment] - first[of]
    order = np.lexsort((period, place, of))
    for d, s, n, q in zip(of[order].tolist(), place[order].tolist(), (stop - start)[order].tolist(), period[order].tolist(), strict=True):
        out[d].append((s, n, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[at:a] if a > at else []
        at = max(at, b)
    return b" ".join(kept + words[at:])


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail in one document of ten, chosen by crc32 of the id; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of each text, and the text without their repetitions, words joined by one space.

    rewrite(id, words) may change the words that are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in sliced(batches, "text"):
            texts = [t.split() if t else [] for t in raw(batch.column(1))]
            if rewrite is not None:
                texts = [rewrite(i, t) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            found = runs_of(texts, least)
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            rest = pa.array([collapsed(t, r) for t, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, kind), rest], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
