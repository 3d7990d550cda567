"""Operator 6 with a similarity: classes of documents whose sets of shingles have that Jaccard similarity or more.

SimHash with its covering masks comes first: pairs within the radius are candidates, and those whose whole sets are
similar enough become links.  A fingerprint alone can't reach such a bound (most pairs of 0.8 differ in 5 to 13 of 64
bits, beyond any radius that covering masks serve), so what it leaves is found by a prefix filter, and pairs that are
in one class already are not looked at again.  No pair is missed.  Shingles have one order for all documents, those that a sample finds frequent last.  Of two sets
that similar, the first shingle they share stands among the first of either (at 0.8: a fifth, and one); only these prefixes meet,
and what sizes and places rule out is dropped.  Pairs that met are held against each other by sketches, which
rule out no similar pair, and those left are checked on their whole sets.  In a key of many
documents each is first paired with a few of them; after a round only keys that still hold several components go on,
and there those outside the largest component alone meet more.  So a group of copies costs its size, not its square, and no pair is left untried that could
join two components.

Defined cases: words as in simhash; a text of up to five words is one shingle; null and wordless texts are one class;
sets are told apart by 64 bits of hash.  The sample decides the order alone, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import checkpointed, raw, sliced
from tallyframe.operators.components import connected_components
from tallyframe.llm import simhash
from tallyframe.llm.simhash import FEW
from tallyframe.session import BROADCAST_ROWS, release

SHINGLE, SEED, SIMILARITY = 5, 42, 0.8
#: One document in so many tells which shingles are frequent, from so many documents on; the broadcast holds MOST of them.
SAMPLE, OFTEN, MOST = 8, 4, 200_000
#: Documents of a key that all meet at once; in larger keys each meets WIDTH others in the first round, and MORE times as many in each that follows.
SMALL, WIDTH, MORE = 16, 2, 8


def hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, repeats included."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.int64)
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(found))
    spans = zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([hashed(joined[a:b], SEED) for a, b in spans], dtype=np.uint64).view(np.int64)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    return np.unique(hashes(text, shingle))


def bound(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction; whole numbers keep the bound exact."""
    if not 0 < similarity <= 1:
        raise ValueError(f"a similarity is above 0 and at most 1, not {similarity}")
    exact = Fraction(similarity).limit_denominator(1000)
    return exact.numerator, exact.denominator


def signature(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), SEED)).view(np.int64))


def similar(x: np.ndarray, y: np.ndarray, of: tuple[int, int]) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and of[1] * shared >= of[0] * (len(x) + len(y) - shared)


def _frequent(rows: DataFrame, shingle: int) -> np.ndarray:
    """The most frequent shingles of a sample, the least frequent of them first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [shingles(t, shingle) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["h"])

    seen = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n"))
    top = seen.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(MOST).select("h").collect()
    return np.array([r[0] for r in reversed(top)], dtype=np.int64)


def prefix(own: np.ndarray, known: np.ndarray, rank: np.ndarray, of: tuple[int, int]) -> np.ndarray:
    """The shingles of which two similar sets share one; known(sorted) have their rank, all others come before them."""
    level = np.zeros(len(own), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        level = np.where(known[at] == own, rank[at], 0)
    n = len(own)
    return own[np.lexsort((own, level))][: n - -(-of[0] * n // of[1]) + 1]


def _prefixes(rows: DataFrame, shingle: int, of: tuple[int, int]) -> DataFrame:
    """(h, fp, n_at): each set's prefix once per task, with the set's size and the place in its order, in one number to spare the shuffle."""
    often = _frequent(rows, shingle)
    order = np.argsort(often)
    ranked = rows.sparkSession.sparkContext.broadcast((often[order], order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = ranked.value
        seen = set()
        for batch in sliced(batches, "text"):
            out = [np.empty((3, 0), np.int64)]
            for text in raw(batch.column(1)):
                own = shingles(text, shingle)
                fp = signature(own)
                if len(own) and fp not in seen:
                    seen.add(fp)
                    first = prefix(own, known, rank, of)
                    out.append(np.stack([first, np.full(len(first), fp), (len(own) << 32) + np.arange(len(first))]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=["h", "fp", "n_at"])

    return rows.mapInArrow(run, "h bigint, fp bigint, n_at bigint")


def _meet(rows: np.ndarray, width: int, of: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (h, fp, n, at, class) of whole keys, sorted -> pairs of fp that may be similar, and the rows of keys to go on with.

    Rows outside the class that holds most of a key meet the `width` rows after them, around the key in the order of fp.
    A key is done once they have met all others, or once it is of one class; rows of one class need not meet."""
    rows = rows[:, np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))] if rows.shape[1] else rows
    pairs = [np.empty((2, 0), np.int64)]
    if rows.shape[1]:
        n = rows.shape[1]
        start = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        size = np.diff(np.concatenate((start, [n])))
        key = np.repeat(np.arange(len(start)), size)
        by_class = np.lexsort((rows[4], key))
        head = np.concatenate(([True], (rows[4, by_class][1:] != rows[4, by_class][:-1]) | (key[by_class][1:] != key[by_class][:-1])))
        run = np.cumsum(head) - 1
        members = np.empty(n, np.int64)
        members[by_class] = np.bincount(run)[run]
        most = np.maximum.reduceat(members, start)
        major = np.maximum.reduceat(np.where(members == most[key], rows[4], np.iinfo(np.int64).min), start)
        leads = rows[4] != major[key]
        until = np.where(size <= SMALL, size - 1, np.minimum(width, size - 1))[key]
        place = np.arange(n) - start[key]
        leaders = np.flatnonzero(leads)
        for d in range(1, int(until[leaders].max(initial=0)) + 1):
            leaders = leaders[until[leaders] >= d]
            a, b = rows[:, leaders], rows[:, start[key[leaders]] + (place[leaders] + d) % size[key[leaders]]]
            fits = (a[4] != b[4]) & (of[1] * np.minimum(a[2], b[2]) >= of[0] * np.maximum(a[2], b[2]))
            fits &= sum(of) * np.minimum(a[2] - a[3], b[2] - b[3]) >= of[0] * (a[2] + b[2])
            pairs.append(np.stack([a[1, fits], b[1, fits]]))
        rows = rows[:, ((size - 1 > np.where(size <= SMALL, size, width)) & (size > most))[key]]
    return np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1), rows


def _met(rows: DataFrame, width: int, of: tuple[int, int], *, dealt: bool = False, later: bool = False) -> DataFrame:
    """rows(h, fp, n_at), later with class -> (a, b) of the pairs that met, and (h, fp, n_at) of the keys to go on with (later: one row that there are some).

    dealt rows lie by key already, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(whole: np.ndarray) -> pa.RecordBatch:
            pairs, left = _meet(whole, width, of)
            left = left[:, :1] if later else left
            of_pair, of_row = pa.nulls(pairs.shape[1], pa.int64()), pa.nulls(left.shape[1], pa.int64())
            columns = [(c, of_row) for c in pairs] + [(of_pair, c) for c in (*left[:2], (left[2] << 32) + left[3])]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, pa.int64()) for x in c]) for c in columns], names=["a", "b", "h", "fp", "n_at"])

        parts: list[np.ndarray] = []
        for batch in batches:
            h, fp, n_at, own_class = (np.asarray(batch.column(min(i, batch.num_columns - 1))) for i in range(4))
            now = np.stack([h, fp, n_at >> 32, n_at & 0xFFFFFFFF, own_class if batch.num_columns == 4 else fp])
            if not now.shape[1]:
                continue
            cut = int(np.searchsorted(now[0], now[0, -1]))  # the last key may go on in the next batch
            if parts and (cut or parts[-1][0, -1] != now[0, 0]):
                yield out(np.concatenate([*parts, now[:, :cut]], axis=1))
                parts = []
            elif cut:
                yield out(now[:, :cut])
            parts.append(now[:, cut:])
        if parts:
            yield out(np.concatenate(parts, axis=1))

    by_key = rows if dealt else rows.repartition("h").sortWithinPartitions("h", "fp")
    return by_key.mapInArrow(run, "a bigint, b bigint, h bigint, fp bigint, n_at bigint")


def sketch(own: np.ndarray) -> bytes:
    """The set's size, then a bit for each hash by its last places; a power of two of them, over four to a hash."""
    places = 8 << max(0, (len(own) - 1).bit_length() - 1)
    bits = np.zeros(places, bool)
    bits[own & (places - 1)] = True
    return len(own).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(x: memoryview, y: memoryview, of: tuple[int, int]) -> bool:
    """False only for sketches of sets that are not similar: a bit that one of them has stands for a hash that the other lacks."""
    n = sum(int.from_bytes(s[:8], "little") for s in (x, y))
    a, b = sorted((np.frombuffer(s[8:], np.uint8) for s in (x, y)), key=len)
    folded = np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)
    apart = int(np.bitwise_count(a ^ folded).sum())
    return of[1] * (n - apart) >= of[0] * (n + apart)


def _compared(rows: DataFrame, first: DataFrame, pairs: DataFrame, shingle: int, form: Callable[[np.ndarray], bytes], good: Callable[[memoryview, memoryview], bool]) -> DataFrame:
    """The pairs(a, b) whose sets, each brought together in a form of its own, are good; first(fp, id) names a row for each set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [shingles(t, shingle) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([signature(x) for x in found], pa.int64()), pa.array([form(x) for x in found], pa.binary())], names=["fp", "own"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)  # views, one pair at a time
            yield batch.select([0, 1]).filter(pa.array([good(*(memoryview(c.as_buffer()) for c in pair)) for pair in both], pa.bool_()))

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    ids = checkpointed(first.join(nodes, "fp", "left_semi").select(F.col("id").alias("need")).distinct())
    n = ids.count()
    if not n:
        return pairs
    need = F.broadcast(ids) if n <= FEW else ids
    found = checkpointed(rows.join(need, rows["id"].eqNullSafe(need["need"]), "left_semi").mapInArrow(sets, "fp bigint, own binary").dropDuplicates(["fp"]))
    side = lambda c: found.select(F.col("fp").alias(c), F.col("own").alias(f"own_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "own_a", "own_b")
    return checkpointed(both.mapInArrow(check, "a bigint, b bigint"))


def _checked(rows: DataFrame, first: DataFrame, pairs: DataFrame, shingle: int, of: tuple[int, int]) -> DataFrame:
    """The pairs(a, b) whose whole sets are similar.  Most of those that met are not, and sketches of a tenth of the size tell so; whole sets move for the others alone."""
    left = _compared(rows, first, pairs, shingle, sketch, lambda x, y: may_be_similar(x, y, of))
    return _compared(rows, first, left, shingle, np.ndarray.tobytes, lambda x, y: similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), of))


def components(rows: DataFrame, own: DataFrame, near: DataFrame, shingle: int, of: tuple[int, int]) -> DataFrame:
    """rows(id, text), own(id, fp), near(a, b) of first candidates -> (node, component) of all that similar pairs connect."""
    first = checkpointed(own.groupBy("fp").agg(F.min("id").alias("id")))  # copies are one row from here on
    parts = checkpointed(connected_components(_checked(rows, first, near, shingle, of)))
    release(rows.sparkSession)
    met, width = checkpointed(_met(_prefixes(rows, shingle, of), WIDTH, of)), WIDTH
    # keys to go on with; the rows of a key lie together, in order, in one partition of what is kept, so later rounds don't deal them again
    left = met.where("h IS NOT NULL").select("h", "fp", "n_at")
    while True:
        few = parts.count() <= BROADCAST_ROWS
        known = F.broadcast(parts) if few else parts
        pairs = met.where("a IS NOT NULL").select("a", "b").distinct()
        for c in "ab":
            pairs = pairs.join(known.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
        apart = checkpointed(pairs.where("of_a IS NULL OR of_b IS NULL OR of_a <> of_b").select("a", "b"))
        good = _checked(rows, first, apart, shingle, of)
        if good.take(1):  # the classes so far are stars, so few steps bring the new links in
            parts = checkpointed(connected_components(good.union(parts.select("node", "component"))))
        if not met.where("h IS NOT NULL").take(1):
            return parts
        few = parts.count() <= BROADCAST_ROWS
        named = (F.broadcast(parts) if few else parts).select(F.col("node").alias("fp"), "component")
        classed = left.join(named, "fp", "left").select("h", "fp", "n_at", F.coalesce("component", "fp").alias("class"))
        width *= MORE
        met = checkpointed(_met(classed, width, of, dealt=few, later=True))
        del pairs, apart, good, named, classed, known
        release(rows.sparkSession)


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = simhash.RADIUS, crowd: int = simhash.CROWD) -> DataFrame:
    """(id, fp, component, keeps) of every row, as simhash.classes_of gives them; fp is the hash of the row's set."""
    of = bound(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [hashes(t, shingle) for t in raw(batch.column(1))]
            both = ([signature(np.unique(h)) for h in found], [simhash.majority(h.view(np.uint64)) for h in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in both)], names=["id", "fp", "bits"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    own = checkpointed(rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint, bits bigint"))
    # sets of the same bits meet the least of them; bits within the radius meet by their least sets
    first = checkpointed(own.groupBy("bits").agg(F.min("fp").alias("first")))
    same = own.select("fp", "bits").distinct().join(first, "bits").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    named = lambda c: first.select(F.col("bits").alias(c), F.col("first").alias(f"of_{c}"))
    near = simhash.links(first.select(F.col("bits").alias("fp")), radius=radius, crowd=crowd).join(named("a"), "a").join(named("b"), "b")
    near = checkpointed(near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).union(same).distinct())
    own = own.select("id", "fp")
    return simhash.classes_of(own, components(rows, own, near, shingle, of))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, **options) -> DataFrame:
    """The documents with their own columns, one of each class, as simhash.deduplicate keeps them."""
    named = near_copies(docs, id_col=id_col, text_col=text_col, similarity=similarity, shingle=shingle, **options)
    return simhash.keep_first(docs, named, lambda t: signature(shingles(t, shingle)), id_col, text_col)
