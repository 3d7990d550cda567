"""Operator 8: benchmark decontamination.

A set of hashed benchmark word windows is broadcast; every document's windows are looked up in it, each hit is
verified word by word, and the covered words (or the documents) are removed.

Defined cases: a null or wordless text has no words and no hits; an item without words never occurs; an item of
fewer than `width` words is one window; an item with a null id marks words as hit but is not listed; repeated
documents get a row each; further columns pass through untouched.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import checkpointed, raw, sliced

WIDTH = 10
#: Benchmark text that one broadcast index covers.  A larger benchmark is handled in blocks of this size.
BLOCK_BYTES = 4 << 20

#: A-Z to a-z; other ASCII but letters and digits to a space; bytes of other characters stay.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class WindowIndex:
    """The windows of one block of benchmark items, by length: sorted hashes and where each window begins."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        ids: list[int] = []
        self.item_ids: list[str | None] = []
        starts: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            found = words(text)
            if not found:
                continue
            item, at, size = len(self.item_ids), len(ids), min(width, len(found))
            self.item_ids.append(item_id)
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
            starts.setdefault(size, []).extend((at + i, item) for i in range(len(found) - size + 1))
        self.ids = np.array(ids, dtype=np.uint64)
        self.weights = np.random.default_rng(8).integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)
        self.tables = {}
        for size, pairs in starts.items():
            begin, item = np.array(pairs, dtype=np.int64).T
            hashed = self._hash(self.ids[begin[:, None] + np.arange(size)])
            order = np.argsort(hashed, kind="stable")
            self.tables[size] = (hashed[order], begin[order], item[order])

    def _hash(self, windows: np.ndarray) -> np.ndarray:
        return (windows * self.weights[: windows.shape[1]]).sum(axis=1, dtype=np.uint64)

    def hits(self, found: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Which words are covered (None: none), and the items whose windows occur."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in found], dtype=np.uint64)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        covered, items = None, set()
        for size, (hashed, begin, item) in self.tables.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            windows = ids[at[:, None] + np.arange(size)]
            mine = self._hash(windows)
            low, high = np.searchsorted(hashed, mine, "left"), np.searchsorted(hashed, mine, "right")
            for k in np.flatnonzero(high > low):
                for j in range(low[k], high[k]):
                    if np.array_equal(windows[k], self.ids[begin[j] : begin[j] + size]):
                        if covered is None:
                            covered = np.zeros(len(ids) + 1, dtype=np.int64)
                        covered[at[k]] += 1
                        covered[at[k] + size] -= 1
                        items.add(int(item[j]))
        return (None if covered is None else np.cumsum(covered[:-1]) > 0), items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """Items that repeat are taken once, so a block holds about block_bytes, or one item that is larger."""
    total = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    n = max(1, math.ceil(total / block_bytes))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) for b in range(n)]


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """The documents, which have no columns of these names, with _n_words, _hits (ranges of covered words) and _items (ids of items that occur, sorted).

    With cut the covered words, and what stands between them, are taken out of the text in the same pass; a null text stays null.
    A benchmark of over block_bytes is taken block by block over all documents; each block's index is broadcast alone."""
    spark = docs.sparkSession
    out = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_hits": F.array().cast(_RANGES), "_items": F.array().cast("array<string>")})
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    for k, block in enumerate(blocks):
        rows = [(r["item"], r["text"].encode()) for r in block.collect()]  # at most about block_bytes
        shared = spark.sparkContext.broadcast(WindowIndex(rows, width))

        def look(batches: Iterator[pa.RecordBatch], shared=shared, last=k == len(blocks) - 1) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in sliced(batches, text_col):
                columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
                counts, ranges, names = [], columns["_hits"].to_pylist(), columns["_items"].to_pylist()
                texts = raw(columns[text_col])
                for row, text in enumerate(texts):
                    found = words(text)
                    counts.append(len(found))
                    covered, items = index.hits(found)
                    if covered is not None:
                        for r in ranges[row]:
                            covered[r["start"] : r["end"]] = True
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
                        ranges[row] = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                        names[row] = sorted({*names[row], *(x for i in items if (x := index.item_ids[i]) is not None)})
                new = {"_n_words": counts, "_hits": ranges, "_items": names}
                if cut and last and any(ranges):
                    new[text_col] = [without(t, r) if r else t for t, r in zip(texts, ranges, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], type=f.type) if f.name in new else columns[f.name] for f in batch.schema], schema=batch.schema)

        out = out.mapInArrow(look, out.schema)
        if k < len(blocks) - 1:
            out = checkpointed(out)
    return out


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: counts of words, covered words and items, a digest of the items' ids, and the verdict."""
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return scanned.select(
        F.col(id_col),
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


_SPAN = re.compile(rb"[^ ]+")


def without(data: bytes, ranges: list[dict]) -> bytes:
    """The text without the words of the ranges and what stands between them."""
    at = [m.span() for m in _SPAN.finditer(data.translate(_TO_WORDS))]
    kept, last = [], 0
    for r in ranges:
        kept.append(data[last : at[r["start"]][0]])
        last = at[r["end"] - 1][1]
    return b"".join([*kept, data[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", remove: str = "documents", **options) -> DataFrame:
    """The documents, with their own columns, without what the benchmark covers.

    remove="documents" drops documents with a hit; remove="spans" cuts the covered words, and the punctuation between them, out of the text."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    # own columns under plain names, so that none clashes with those of the scan
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    scanned = scan(docs.toDF(*names), benchmark, text_col=text, cut=remove == "spans", **options)
    kept = scanned.where(F.size("_hits") == 0) if remove == "documents" else scanned
    return kept.select(names).toDF(*docs.columns)


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
