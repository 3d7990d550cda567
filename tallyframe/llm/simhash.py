"""Operator 6: SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints of 64 bits are taken per document; equal ones are merged.  Each fingerprint goes to 2^(radius+1)-1
tables; table v keeps the bits i with <m(i), v> = 1 over GF(2), m a fixed map of bits to nonzero vectors.  The
vectors of up to `radius` differing bits span less than the whole space, so some v is orthogonal to all of them:
in that table the two fingerprints have the same key.  No pair within the radius is missed.  Inside a key all
fingerprints are compared and a spanning forest of their links is written (at most one edge each, never all
pairs).  Keys are counted first; the fingerprints of a crowded key are dealt again over all tasks, by covering masks
over the bits that the key leaves open.  A key of that second deal leaves about 15 bits open, which bounds its group
whatever the table's size.

Defined cases: a null or wordless text has fingerprint 0 and links like any other; a text of fewer words than a
shingle is one shingle; rows with a null id take part, and a class of null ids alone has component null; repeated
rows are kept; an empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import checkpointed, raw, sliced, unused
from tallyframe.operators.components import connected_components

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Fingerprints that are compared with each other at once.
BLOCK = 1024
#: Fingerprints of one key that a task takes; keys with more are dealt again.
CROWD = 8192
#: Crowded keys that are broadcast; more of them are joined by a shuffle.
FEW = 100_000
#: Rows of one fingerprint that a join deals by the fingerprint alone; more are dealt over tasks.
HOT = 1_000
SALTS = 64
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint.  bytes.lower and bytes.split know ASCII alone, as the definition asks."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    if len(found) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(found), seed)).astype(np.int64))
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(found) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([hashed(joined[a:b], seed) for a, b in spans], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0].astype(np.int64))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, shingle, seed) for t in raw(batch.column(1))], pa.int64())], names=["id", "fp"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def covering_masks(radius: int, bits: list[int] | None = None) -> list[int]:
    """The bits that each table keeps, as 64-bit masks; two words that differ in at most `radius` of `bits` agree under one of them."""
    bits = list(range(BITS)) if bits is None else bits
    vectors = (1 << (radius + 1)) - 1
    m = {bit: k % vectors + 1 for k, bit in enumerate(bits)}
    return [sum(1 << b for b in bits if bin(m[b] & v).count("1") % 2) for v in range(1, vectors + 1)]


def _forest(words: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (as positions) that connect what is connected within the radius; blocks bound the memory."""
    n = len(words)
    label, edges = np.arange(n), []
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            near = np.bitwise_count(words[i : i + BLOCK, None] ^ words[None, j : j + BLOCK]) <= radius
            if i == j:
                near = np.triu(near, 1)
            for a in np.flatnonzero(near.any(axis=1)):
                others = np.flatnonzero(near[a]) + j
                others = others[label[others] != label[a + i]]
                # one link to each class that is not yet joined
                for b in others[np.unique(label[others], return_index=True)[1]]:
                    edges.append((int(a + i), int(b)))
                    label[label == label[b]] = label[a + i]
    return edges


def _links(words: np.ndarray, open_bits: list[int], radius: int) -> list[tuple[int, int]]:
    if len(words) <= BLOCK or len(open_bits) <= 2 * radius:
        return _forest(words, radius)
    edges = set()
    for mask in covering_masks(radius, open_bits):
        keys = words & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        left = [b for b in open_bits if not mask >> b & 1]
        for part in np.split(order, cuts):
            if 1 < len(part) < len(words):
                edges.update((int(part[a]), int(part[b])) for a, b in _links(words[part], left, radius))
            elif len(part) == len(words):
                edges.update((int(part[a]), int(part[b])) for a, b in _forest(words[part], radius))
    return list(edges)


def _dealt(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp): each fingerprint once for each mask."""
    at = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return distinct.select("fp", at.alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _open(mask: int) -> list[int]:
    return [b for b in range(BITS) if not mask >> b & 1]


def links(distinct: DataFrame, *, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """distinct(fp) -> (a, b): links of at most `radius` bits that connect all that such links connect."""
    masks = covering_masks(radius)
    tables = _dealt(distinct, masks)
    crowded = checkpointed(tables.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("mask", "key"))
    n = crowded.count()
    if n:
        keys = F.broadcast(crowded) if n <= FEW else crowded
        finer = [(_signed(m), _signed(m | x)) for m in masks for x in covering_masks(radius, _open(m))]  # the square of the number of tables
        deal = F.broadcast(distinct.sparkSession.createDataFrame(finer, "mask bigint, finer bigint"))
        again = tables.join(keys, ["mask", "key"], "left_semi").join(deal, "mask").select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp")
        tables = tables.join(keys, ["mask", "key"], "left_anti").union(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.empty((0, 3), dtype=np.int64)
        batch = None
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            rows = np.concatenate([tail, rows])
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last key may go on in the next batch
            tail = rows[cut:]
            yield _edges(rows[:cut], radius)
        if batch is not None:
            yield _edges(tail, radius)

    dealt = tables.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _edges(rows: np.ndarray, radius: int) -> pa.RecordBatch:
    edges: list[tuple[int, int]] = []
    if len(rows) > 1:
        cuts = np.concatenate(([0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1, [len(rows)]))
        sizes = np.diff(cuts)
        pairs = cuts[:-1][sizes == 2]
        a, b = rows[pairs, 2], rows[pairs + 1, 2] if len(pairs) else rows[:0, 2]
        near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius if len(pairs) else np.zeros(0, bool)
        edges += zip(a[near].tolist(), b[near].tolist(), strict=True)
        for k in np.flatnonzero(sizes > 2):
            fps = np.ascontiguousarray(rows[cuts[k] : cuts[k + 1], 2])
            edges += [(int(fps[i]), int(fps[j])) for i, j in _links(fps.view(np.uint64), _open(int(rows[cuts[k], 0])), radius)]
    first, second = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, crowd: int = CROWD, **options) -> DataFrame:
    """(id, fp, component): of every row, the fingerprint and the least id of those reachable by links."""
    own = checkpointed(fingerprints(docs, id_col=id_col, text_col=text_col, **options))
    named = classes_of(own, connected_components(links(own.select("fp").distinct(), radius=radius, crowd=crowd)))
    return named.select(F.col("id").alias(id_col), "fp", "component")


def classes_of(own: DataFrame, parts: DataFrame) -> DataFrame:
    """own(id, fp) and the components of linked fp -> (id, fp, component, keeps): keeps is the fp of the class's row of least id (of several the least fp).

    Copies share their fp, so own is dealt by id and fp, and a class's name by fp alone: no group of copies lies in one task."""
    by_fp = own.groupBy("fp").agg(F.min("id").alias("first"))
    # only fingerprints with a link are in parts
    linked = parts.withColumnRenamed("node", "fp").join(by_fp, "fp")
    # nulls would come first in a struct, yet a null id is the last to name a class
    order = F.struct(F.col("first").isNull().alias("none"), "first", "fp")
    least = linked.groupBy("component").agg(F.min(order).alias("least"))
    named = linked.join(least, "component").select("fp", "least")
    of = by_fp.join(named, "fp", "left").select("fp", F.coalesce("least.first", "first").alias("component"), F.coalesce("least.fp", "fp").alias("keeps"))
    return _salted(own, of)


def _salted(own: DataFrame, of: DataFrame) -> DataFrame:
    """own joined with of by fp.  An fp of more than HOT rows is dealt over tasks by a hash of the id, and its line of `of` to each."""
    hot = checkpointed(own.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("fp"))
    n = hot.count()
    if not n:
        return own.join(of, "fp").select("id", "fp", "component", "keeps")
    few = F.broadcast(hot) if n <= FEW else hot
    cold = own.join(few, "fp", "left_anti").join(of, "fp").select("id", "fp", "component", "keeps")
    lines = of.join(few, "fp", "left_semi")
    if n <= FEW:  # at most FEW lines: each is brought to the rows, which stay where they are
        warm = own.join(few, "fp", "left_semi").join(F.broadcast(lines), "fp")
    else:
        warm = own.join(few, "fp", "left_semi").withColumn("s", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(lines.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["fp", "s"])
    return cold.union(warm.select("id", "fp", "component", "keeps"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, crowd: int = CROWD, similarity: float | None = None, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The documents with their own columns, one of each class: the row with the least id.

    Classes are links of `radius` bits; with a similarity they are links of that Jaccard similarity between the sets of
    shingles, for which fingerprints give the first candidates (see near_copies).  Rows that repeat an id are documents
    of their own: each is in the class of its own text, and two of unlike texts both stay.  Of several rows of a class
    with its least id one stays, by the least fingerprint and then the least hash of the text.  Rows with a null id stay
    if their class has no other id, and then one of them."""
    if similarity is not None:
        from tallyframe.llm import near_copies

        return near_copies.deduplicate(docs, id_col=id_col, text_col=text_col, similarity=similarity, shingle=shingle, radius=radius, crowd=crowd)
    own = checkpointed(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed))
    named = classes_of(own, connected_components(links(own.select("fp").distinct(), radius=radius, crowd=crowd)))
    return keep_first(docs, named, lambda t: fingerprint(t, shingle, seed), id_col, text_col)


def keep_first(docs: DataFrame, classes: DataFrame, of_text: Callable[[bytes | None], int], id_col: str, text_col: str) -> DataFrame:
    """The documents that stand for their class; classes(id, fp, component, keeps) has a line for each row, and of_text gives a text's fp.

    An id of one row alone stays or goes as a whole, by an anti join with the ids that go (broadcast while they are few).
    Only rows that repeat an id need their fp again; where there are none, the documents are read once."""
    key, own = unused(docs, "_gone", "_fp")
    stays = F.col("id").eqNullSafe(F.col("component")) & (F.col("fp") == F.col("keeps"))
    by_id = checkpointed(classes.groupBy("id").agg(F.count("*").alias("n"), F.count_if(stays).alias("kept")).where("n > 1 OR kept = 0").select("id", "n", "kept"))
    once, several, wanted = by_id.agg(F.count_if(F.expr("n = 1")), F.count_if(F.expr("n > 1")), F.count_if(F.expr("n > 1 AND kept > 0"))).first()
    gone = by_id.select(F.col("id").alias(key))
    gone = F.broadcast(gone) if once + several <= FEW else gone
    out = docs.join(gone, docs[id_col].eqNullSafe(gone[key]), "left_anti")
    if not wanted:
        return out
    ids = by_id.where("n > 1 AND kept > 0").select(F.col("id").alias(key))
    again = docs.join(F.broadcast(ids) if wanted <= FEW else ids, docs[id_col].eqNullSafe(F.col(key)), "left_semi")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([of_text(t) for t in raw(batch.column(at))], pa.int64())], names=[*batch.schema.names, own])

    read = again.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    keep = classes.where(stays).join(F.broadcast(ids) if wanted <= FEW else ids, F.col("id").eqNullSafe(F.col(key)), "left_semi").select(F.col("id").alias(key), "fp").distinct()
    rows = read.join(keep, read[id_col].eqNullSafe(keep[key]) & (read[own] == keep["fp"]), "left_semi")
    # partial minima first, so a null id of a third of the rows is no group in one task
    one = rows.groupBy(F.col(id_col).alias(key), own).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text_col)).alias("row"))
    return out.union(one.select("row.*"))
