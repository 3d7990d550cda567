"""Operator 12: a Merkle manifest of a dataset, with proofs and their verification.

Every row is a leaf, the sha256 (as hex text) of its coded fields.  Leaves of one source stand in the order of their ids and are hashed in
runs of `fanout`, level by level, until one node is left; these nodes, in the order of sources, give the root in the same way.

Leaves are numbered by ranges of (source, id), so no task sorts a source.  Aligned blocks of fanout^2 leaves are one row
each from then on, a contiguous matrix of 64-byte digests: a level is a reshape by the fanout and a hash of each
row, and the siblings of leaf i on level l are found from i // fanout^l.  The roots of the blocks are the leaves of the tree above, which is
built in the same way from blocks of fanout^3, until every source is one block.  What stands above a block comes back to it as one
path, so a leaf's proof is put together where its block lies.

Defined cases: a null field counts as '-'; rows with a null source form a source of their own, before all others; rows with a null id stand
first in their source; rows that repeat an id stand in the order of their leaf digests, and equal rows get the places of either; an
empty table has no root and gives no rows; further columns are neither hashed nor carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import checkpointed, raw
from tallyframe.session import small

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block of leaves, and of a block of the trees above.
LOW, HIGH = 2, 3
DIGEST = 64

#: The way from a node to the top: its place in each run, and the digests of the others there.
_PATH = "array<struct<place: int, siblings: string>>"
_ARROW_PATH = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def coded(field: Column) -> Column:
    """Byte count, colon and value, so that no two rows run together alike; '-' for a null."""
    s = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def levels_of(n: int, fanout: int) -> int:
    """How many times n nodes are hashed until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def matrix(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.uint8).reshape(-1, DIGEST)


def tower(leaves: np.ndarray, levels: int, fanout: int) -> list[np.ndarray]:
    """The digests of each level, a row each; the last level is the block's root."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        whole = len(below) - len(below) % fanout
        runs = [r.tobytes() for r in below[:whole].reshape(-1, fanout * DIGEST)] + [below[whole:].tobytes()] * (whole < len(below))
        out.append(matrix(b"".join(map(sha, runs))))
    return out


def siblings(level: np.ndarray, fanout: int) -> list[bytes]:
    """For each node of a level the digests of the others in its run, from left to right."""
    out: list[bytes] = []
    whole = len(level) - len(level) % fanout
    for part, size in ((level[:whole], fanout), (level[whole:], len(level) - whole)):
        if len(part):
            others = np.array([[j for j in range(size) if j != i] for i in range(size)], dtype=np.intp).reshape(size, size - 1)
            out += [r.tobytes() for r in part.reshape(-1, size, DIGEST)[:, others].reshape(len(part), -1)]
    return out


def way(beside: list[list[bytes]], i: int, fanout: int) -> list[tuple[int, bytes]]:
    """Place and siblings of node i on each level of its block; beside has the siblings of every node of a level."""
    return [((node := i // fanout**k) % fanout, rows[node]) for k, rows in enumerate(beside)]


def folded(leaf: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The last node, from a leaf and its way."""
    for place, others in steps:
        leaf = sha(others[: place * DIGEST] + leaf + others[place * DIGEST :])
    return leaf


def _steps(way_of: list[tuple[int, bytes]]) -> list[dict]:
    return [{"place": p, "siblings": s.decode()} for p, s in way_of]


def numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with at, their place from 0 among those of their key, and n, how many these are; rows are dealt by ranges of key and order."""
    ranged = checkpointed(rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)).withColumn("_at", F.monotonically_increasing_id())
    placed = ranged.withColumn("_part", F.shiftright("_at", 33))
    ranges = placed.groupBy("_part", *key).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    of_key = Window.partitionBy(*key)
    before = F.coalesce(F.sum("_size").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_{c}") for c in key), (F.col("_first") - before).alias("_start"), F.sum("_size").over(of_key).alias("n"))
    same = F.col("_part") == F.col("_p")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(small(ranges), same).select(*rows.columns, (F.col("_at") - F.col("_start")).alias("at"), "n")


def _packed(nodes: DataFrame, levels: int, fanout: int, extra: list[str]) -> DataFrame:
    """nodes(source, at, n, digest, *extra) -> (source, block, n, digests, root, *extra): a row for each aligned block, its nodes in order."""
    kept = {c: nodes.schema[c].dataType.simpleString() for c in extra}
    schema = "source string, block bigint, n bigint, digests string, root string" + "".join(f", {c} array<{t}>" for c, t in kept.items())

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n = table.column("n")[0].as_py()
        digests = b"".join(raw(pa.concat_arrays(table.column("digest").chunks)))
        root = tower(matrix(digests), min(levels, levels_of(n, fanout)), fanout)[-1]
        columns = [table.column("source").slice(0, 1), table.column("block").slice(0, 1), pa.array([n], pa.int64()), pa.array([digests.decode()]), pa.array([root.tobytes().decode()])]
        columns += [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), pa.concat_arrays(table.column(c).chunks)) for c in extra]
        return pa.Table.from_arrays(columns, names=["source", "block", "n", "digests", "root", *extra])

    dealt = nodes.withColumn("block", F.expr(f"at div {fanout**levels}"))
    return checkpointed(dealt.groupBy("source", "block").applyInArrow(pack, schema))


def _ways(batch: pa.RecordBatch, columns: list[str], levels: int, fanout: int) -> Iterator[tuple]:
    """For each row of packed blocks the named columns, and the ways of its nodes within the block."""
    for n, digests, *rest in zip(*(batch.column(c).to_pylist() for c in ["n", "digests", *columns]), strict=True):
        beside = [siblings(level, fanout) for level in tower(matrix(digests.encode()), min(levels, levels_of(n, fanout)), fanout)[:-1]]
        yield *rest, [way(beside, i, fanout) for i in range(len(digests) // DIGEST)]


def _joined(blocks: DataFrame, above: DataFrame) -> DataFrame:
    above = above.select(F.col("source").alias("_source"), F.col("at").alias("_at"), "path", "top")
    return blocks.drop("root").join(above, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_at")))


def _above(blocks: DataFrame, levels: int, fanout: int) -> DataFrame:
    """blocks(source, block, n, root) -> (source, at, path, top): the runs on the way from each block's root to the last node of its source."""
    nodes = blocks.select("source", F.col("block").alias("at"), F.expr(f"(n + {fanout**levels - 1}) div {fanout**levels}").alias("n"), F.col("root").alias("digest"))
    if not nodes.where("n > 1").take(1):
        return nodes.select("source", "at", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top"))
    packed = _packed(nodes, HIGH, fanout, [])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, block, path, top, out in _ways(batch, ["source", "block", "path", "top"], HIGH, fanout):
                at = block * fanout**HIGH + np.arange(len(out))
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(out), pa.string()), pa.array(at), pa.array([_steps(w) + path for w in out], _ARROW_PATH), pa.array([top] * len(out), pa.string())], names=["source", "at", "path", "top"])

    both = _joined(packed, _above(packed, HIGH, fanout)).select("source", "block", "n", "digests", "path", "top")
    return both.mapInArrow(paths, f"source string, at bigint, path {_PATH}, top string")


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", found: Column | None = None, fanout: int = FANOUT, with_paths: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; with_paths adds path, the runs on the way to the root.

    found is the text that a row has when it is verified (null: the row's own text).  Its leaf is folded with the row's siblings into folded_root,
    and the row is verified if that is the root.  Every proof is folded, those of unchanged rows too."""
    other = F.lit(None).cast("string") if found is None else F.when(found.isNotNull(), F.concat(*(coded(found if c == text_col else docs[c]) for c in fields)))
    named = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), F.concat(*(coded(docs[c]) for c in fields)).alias("_row"), other.alias("_found"))
    # from here on texts are not read again
    leaves = checkpointed(named.select("id", "source", F.sha2("_row", 256).alias("digest"), F.sha2("_found", 256).alias("other")))
    leaves = numbered(leaves.withColumn("_row", F.monotonically_increasing_id()), ["source"], ["id", "digest", "_row"]).drop("_row")
    blocks = _packed(leaves, LOW, fanout, ["id", "other"])
    above = _above(blocks, LOW, fanout)
    # the last nodes of the sources are the leaves of one more tree
    tops = numbered(above.where("at = 0").select("source", F.col("top").alias("digest")).withColumn("one", F.lit(0)), ["one"], ["source"])
    tops = _packed(tops.select(F.lit(None).cast("string").alias("source"), "at", "n", "digest", F.col("source").alias("of")), LOW, fanout, ["of"])
    last = _joined(tops, _above(tops, LOW, fanout)).select("n", "digests", "of", "path", "top")

    def root_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, path, top, out in _ways(batch, ["of", "path", "top"], LOW, fanout):
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array([_steps(w) + path for w in out], _ARROW_PATH), pa.array([top] * len(of), pa.string())], names=["_of", "to_root", "root"])

    roots = small(last.mapInArrow(root_paths, f"_of string, to_root {_PATH}, root string"))
    ready = _joined(blocks, above).join(roots, F.col("source").eqNullSafe(F.col("_of"))).select("n", "digests", "id", "other", "top", "root", F.concat("path", "to_root").alias("path"))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for k, (digests, others, top, root, path, out) in enumerate(_ways(batch, ["digests", "other", "top", "root", "path"], LOW, fanout)):
                size, upper = len(out), [(p["place"], p["siblings"].encode()) for p in path]
                leaves = [digests[i * DIGEST : (i + 1) * DIGEST] for i in range(size)]
                ways = [w + upper for w in out]
                proofs = [sha(b"".join(s for _, s in w)).decode() for w in ways]
                tops = [folded((o or leaf).encode(), w).decode() for o, leaf, w in zip(others, leaves, ways, strict=True)]
                columns = [ids[k].values, pa.array(leaves), pa.array([top] * size), pa.array([root] * size), pa.array(proofs), pa.array(tops), pa.array([t == root for t in tops])]
                columns += [pa.array([_steps(w) for w in ways], _ARROW_PATH)] if with_paths else []
                yield pa.RecordBatch.from_arrays(columns, names=_OUT + ["path"] * with_paths)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", path {_PATH}" if with_paths else "")
    return ready.mapInArrow(prove, schema)


_OUT = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered_fifth(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text with A-Z in lower case where 5 divides the crc32 of the id, null elsewhere: what the query verifies."""
    return F.when(F.crc32(docs[id_col].cast("string")) % 5 == 0, F.translate(docs[text_col], _UPPER, _UPPER.lower()))
