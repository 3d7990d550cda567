"""Operator 13: substring dedup by difference-cover anchors.

A window of `width` words goes if its words also start anywhere else.  Windows are hashed only from places that a difference cover
allows: of the places modulo a period, so few that for any two of them some shift of less than the period brings both onto the cover.
So two equal windows share an anchor, a shorter run of words (width - period + 1) that begins at a cover place in both.  Only
windows around an anchor that occurs twice are extended to their whole width, hashed, and compared.

Both steps ask which hashes occur twice among all documents, and ask it alike.  A task packs the hashes of many documents by
buckets, each hash once, so a passage that any number of documents hold comes to its bucket once a task; buckets are compared in one sorted array
each, and what occurs twice goes back to the task's batch and from there to the documents, a bit for each hash.  No pairs are formed, and texts
do not move: the bits are joined to the documents, by a broadcast where they are few.

Words are told apart by 64 bits of hash; windows by 64 bits and their bucket, which comes from a second hash.  A document's marks depend on its text
alone, so they are kept by the text's digest, and copies share them.

Defined cases: a null or wordless text has no words and loses none, and its kept text is empty; a text of under `width` words loses none; every row counts as a document
of its own, those that repeat an id or a text too, so both of two equal texts of `width` words go; rows with a null id are treated like any other; further
columns pass through deduplicate_substrings and are not carried by cut.  Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import checkpointed, raw, sliced

WIDTH = 35
#: Hashes that a task packs at once, and that a bucket has about.
BATCH, BUCKET = 1 << 21, 1 << 21
#: Documents with marks, and bytes of marks, that are broadcast at most.
ROWS, BYTES = 1_000_000, 64 << 20
KEY = 16


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of places, such that every difference modulo the period is one of two of them."""
    size = 1
    while size * (size - 1) < period - 1:
        size += 1
    while True:
        for rest in itertools.combinations(range(1, period), size - 1):
            places = (0, *rest)
            if len({(a - b) % period for a in places for b in places}) == period:
                return places
        size += 1


class Plan:
    """What anchors a width of words has."""

    def __init__(self, width: int):
        if width < 2:
            raise ValueError(f"a window has two words at least, not {width}")
        self.width, self.period = width, max(1, 3 * width // 5)
        self.anchor = width - self.period + 1
        self.cover = np.array(difference_cover(self.period))
        self.weights = np.random.default_rng(13).integers(1, 1 << 63, (2, width), dtype=np.uint64) | np.uint64(1)

    def anchors(self, n: int) -> np.ndarray:
        """Where anchors begin in a text of n words."""
        if n < self.width:
            return np.empty(0, np.int64)
        at = np.add.outer(np.arange(0, n, self.period), self.cover).ravel()
        return at[at + self.anchor <= n]

    def windows(self, n: int, again: np.ndarray) -> np.ndarray:
        """Where windows begin that hold one of the anchors named."""
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, np.maximum(again - self.period + 1, 0), 1)
        np.add.at(edges, again + 1, -1)
        return np.flatnonzero(np.cumsum(edges[: max(0, n - self.width + 1)]) > 0)

    def hashes(self, words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the `size` words from each place on."""
        out = np.zeros((2, len(at)), np.uint64)
        for j in range(size):
            word = words[at + j]
            out[0] += word * self.weights[0, j]
            out[1] += word * self.weights[1, j]
        return out[0], out[1] >> np.uint64(24)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def places(data: bytes | None, n: int) -> np.ndarray:
    """Where the first n bits are set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(data or b"", np.uint8), count=n, bitorder="little")) if data else np.empty(0, np.int64)


def _packed(batch: int, keys: list[bytes], counts: list[int], first: np.ndarray, second: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (deal, batch, keys, counts, hashes, refs): one for each bucket, and one, dealt by the batch, that says whose the hashes are.

    A hash that the batch holds twice is sent once, with -1 for a ref, and its places go with the batch's own row."""
    bucket = (second % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((first, bucket))
    h, b = first[order], bucket[order]
    head = np.concatenate(([True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])))[: len(h)]
    twice = ~head | ~np.concatenate((head[1:], [True]))[: len(h)]
    refs = np.where(twice, -1, order)[head].astype(np.int32)
    h, b = h[head], b[head]
    cuts = np.flatnonzero(np.diff(b)) + 1
    starts, ends = np.concatenate(([0], cuts)) if len(b) else cuts, np.concatenate((cuts, [len(b)])) if len(b) else cuts
    own = [None] * len(starts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([-1 - batch, *b[starts].tolist()], pa.int64()), pa.array([batch] * (1 + len(starts)), pa.int64()), pa.array([b"".join(keys), *own], pa.binary()), pa.array([np.array(counts, np.int32).tobytes(), *own], pa.binary()),
            pa.array([None, *(h[s:e].tobytes() for s, e in zip(starts, ends, strict=True))], pa.binary()), pa.array([order[twice].astype(np.int32).tobytes(), *(refs[s:e].tobytes() for s, e in zip(starts, ends, strict=True))], pa.binary()),
        ],
        names=["deal", "batch", "keys", "counts", "hashes", "refs"],
    )


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """The rows that have one value of a column, which they are sorted by."""
    now: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if now and now[0][column] != row[column]:
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, keys, counts, refs): of each bucket the refs of hashes that occur in more than one batch."""
    for group in _groups(batches, "deal"):
        out = group
        if group[0]["keys"] is None:
            hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in group])
            refs = np.concatenate([np.frombuffer(r["refs"], np.int32) for r in group])
            of = np.repeat(np.arange(len(group)), [len(r["refs"]) // 4 for r in group])
            order = np.argsort(hashes)
            same = hashes[order][1:] == hashes[order][:-1]
            again = np.zeros(len(hashes), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            again &= refs >= 0
            out = [{"batch": r["batch"], "keys": None, "counts": None, "refs": mine.tobytes()} for k, r in enumerate(group) if len(mine := refs[again & (of == k)])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in (("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("refs", pa.binary()))], names=["batch", "keys", "counts", "refs"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, marks): a bit for each hash of a document, of documents that have one that occurs twice."""
    for group in _groups(batches, "batch"):
        own = [r for r in group if r["keys"] is not None]
        if len(own) != 1:
            raise RuntimeError("a batch of documents was not read again as it was at first")
        counts = np.frombuffer(own[0]["counts"], np.int32)
        again = np.zeros(int(counts.sum()), bool)
        for r in group:
            again[np.frombuffer(r["refs"], np.int32)] = True
        ends = np.cumsum(counts, dtype=np.int64)
        held = np.concatenate(([0], np.cumsum(again)))
        with_marks = np.flatnonzero(held[ends] > held[ends - counts])
        keys = [own[0]["keys"][k * KEY : (k + 1) * KEY] for k in with_marks.tolist()]
        marks = [bits(again[ends[k] - counts[k] : ends[k]]) for k in with_marks.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(marks, pa.binary())], names=["key", "marks"])


Hashed = Callable[[list[bytes], bytes | None], tuple[np.ndarray, np.ndarray]]


def occurring_twice(rows: DataFrame, hashed: Hashed, buckets: int) -> DataFrame:
    """rows(key, text, marks) -> (key, marks) of texts with a hash that occurs twice, as hashed(words, marks) gives them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys, counts, parts = [], [], [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
        total = 0

        def packed() -> Iterator[pa.RecordBatch]:
            return _packed((part << 32) + number, keys, counts, *(np.concatenate(x) for x in zip(*parts, strict=True)), buckets)

        for batch in sliced(batches, "text"):
            for key, text, marks in zip(raw(batch.column(0)), raw(batch.column(1)), raw(batch.column(2)), strict=True):
                pair = hashed(text.split(), marks)
                if len(pair[0]):
                    keys.append(key)
                    counts.append(len(pair[0]))
                    parts.append(pair)
                    total += len(pair[0])
                if total >= BATCH:
                    yield from packed()
                    number, keys, counts, parts, total = number + 1, [], [], parts[:1], 0
        if total:
            yield from packed()

    # in a partition's own order of texts a batch is the same whenever it is read
    read = rows.where("text IS NOT NULL").select("key", "text", "marks").sortWithinPartitions("key")
    packed = read.mapInArrow(emit, "deal bigint, batch bigint, keys binary, counts binary, hashes binary, refs binary")
    again = packed.repartition("deal").sortWithinPartitions("deal").mapInArrow(_repeated, "batch bigint, keys binary, counts binary, refs binary")
    found = again.repartition("batch").sortWithinPartitions("batch").mapInArrow(_marked, "key binary, marks binary")
    return checkpointed(found.groupBy("key").agg(F.max("marks").alias("marks")))  # copies have the same marks


def _small(marks: DataFrame, *columns: str) -> DataFrame:
    """marks, with a hint to broadcast them where rows and bytes allow it."""
    rows, size = marks.agg(F.count("*"), F.coalesce(F.sum(sum(F.octet_length(c) for c in columns)), F.lit(0))).first()
    return F.broadcast(marks) if rows <= ROWS and size <= BYTES else marks


def cut(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: the words that no repeated window covers, joined by one space."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return _cut(rows, width, buckets).mapInArrow(_keep(Plan(width), False), f"id {kind}, n_words bigint, n_removed bigint, kept string")


def deduplicate_substrings(docs: DataFrame, *, text_col: str = "text", width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """The documents with their own columns; texts that lose words have the others joined by one space."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = docs.toDF(*names).select(F.struct(*(c for c in names if c != names[docs.columns.index(text_col)])).alias("id"), F.col(names[docs.columns.index(text_col)]).alias("text"))
    out = _cut(whole, width, buckets).mapInArrow(_keep(Plan(width), True), f"id {whole.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string")
    return out.select([F.col("kept").alias(c) if c == text_col else F.col(f"id.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])


def _cut(rows: DataFrame, width: int, buckets: int | None) -> DataFrame:
    """rows(id, text) -> (id, text, marks, of_windows)."""
    plan = Plan(width)
    spark = rows.sparkSession
    keyed = rows.select("id", "text", F.unhex(F.md5("text")).alias("key"))
    if buckets is None:  # some for each task of a shuffle, and so many that a bucket fits its task
        words = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6
        buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), words // BUCKET)

    def anchors(words: list[bytes], marks: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < plan.width:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return plan.hashes(word_hashes(words), plan.anchors(len(words)), plan.anchor)

    def windows(words: list[bytes], marks: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        at = plan.anchors(len(words))
        return plan.hashes(word_hashes(words), plan.windows(len(words), at[places(marks, len(at))]), plan.width)

    of_anchors = occurring_twice(keyed.withColumn("marks", F.lit(None).cast("binary")), anchors, buckets)
    near = keyed.select("key", "text").join(_small(of_anchors, "marks"), "key")
    of_windows = occurring_twice(near, windows, buckets).select("key", F.col("marks").alias("of_windows"))
    both = checkpointed(of_anchors.join(of_windows, "key"))
    return keyed.join(_small(both, "marks", "of_windows"), "key", "left").select("id", "text", "marks", "of_windows")


def _keep(plan: Plan, as_it_was: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, n_words, n_removed, kept); as_it_was leaves texts alone that lose no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, marks, of_windows in zip(*(raw(batch.column(c)) for c in ("text", "marks", "of_windows")), strict=True):
                words = text.split() if text else []
                n = len(words)
                left = words
                if of_windows is not None:
                    at = plan.anchors(n)
                    begin = plan.windows(n, at[places(marks, len(at))])
                    begin = begin[places(of_windows, len(begin))]
                    edges = np.zeros(n + 1, np.int64)
                    edges[begin] += 1
                    edges[begin + plan.width] -= 1
                    left = list(itertools.compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))
                n_words.append(n)
                n_removed.append(n - len(left))
                kept.append(text if as_it_was and len(left) == n else b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run
