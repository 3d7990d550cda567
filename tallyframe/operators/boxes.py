"""Where a value stands on its pages: the words whose texts, run together, are the value.

Words of a document meet the values looked for in it, and only there.  The words are run together once, block by block; prefix sums of a rolling hash
give the hash of every stretch of a length in one subtraction, so all values of one length are looked for in one pass, and what has the right hash is compared letter by
letter.  So a document costs its letters times the different lengths asked for; values and stretches are not paired."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a value at most; a larger step down ends a block; shorter values are not looked for; height of a block of lines.
WINDOW, LINE_GAP, LEAST, BLOCK_HEIGHT = 24, 28.0, 2, 100.0
#: Letters of a document and values that are searched one by one, without hashes; documents taken from Arrow at a time.
SHORT, FEW, TOGETHER = 4096, 16, 500
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

Box = tuple[int, float, float, float, float]


def _plain(text: str | None) -> str:
    return "".join((text or "").split())


class Page:
    """The words of a document in reading order, run together."""

    def __init__(self, words: list[tuple]):
        kept = sorted(((w, p) for w in words if (p := _plain(w[5]))), key=lambda x: (x[0][0], round(x[0][2], 1), x[0][1]))
        self.boxes = words = [w for w, _ in kept]
        parts, starts, ends, at, low = [], [], [], 0, 0.0
        for k, ((page, _, y0, _, _, _), text) in enumerate(kept):
            if k and (page != words[k - 1][0] or y0 - low > LINE_GAP):
                parts.append("\0")  # no value goes over it
                at, low = at + 1, y0
            low = max(low, y0) if k else y0
            starts.append(at)
            parts.append(text)
            at += len(text)
            ends.append(at)
        self.text, self.starts, self.ends = "".join(parts), starts, ends

    def run_together(self) -> None:
        """The prefix sums of the rolling hash."""
        letters = np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        powers = np.full(len(letters), _BASE, np.uint64)
        inverses = np.full(len(letters), _INVERSE, np.uint64)
        if len(letters):
            powers[0] = inverses[0] = 1
        self.powers, self.inverses = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverses, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * self.powers, dtype=np.uint64)))

    def hash_of(self, value: str) -> int:
        letters = np.frombuffer(value.encode("utf-32-le"), np.uint32).astype(np.uint64)
        return int((letters * np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(letters) - 1, _BASE, np.uint64), dtype=np.uint64)))).sum(dtype=np.uint64))

    def places(self, values: set[str]) -> dict[str, list[int]]:
        """Where each value begins."""
        found: dict[str, list[int]] = {v: [] for v in values}
        if len(self.text) <= SHORT and len(values) <= FEW:
            for v, own in found.items():
                at = self.text.find(v)
                while at >= 0:
                    own.append(at)
                    at = self.text.find(v, at + 1)
            return found
        self.run_together()
        by_length: dict[int, list[str]] = {}
        for v in values:
            by_length.setdefault(len(v), []).append(v)
        for n, own in by_length.items():
            if n > len(self.text):
                continue
            hashes = (self.sums[n:] - self.sums[:-n]) * self.inverses[: len(self.text) - n + 1]
            wanted = np.array([self.hash_of(v) for v in own], np.uint64)
            known = set(own)
            for at in np.flatnonzero(np.isin(hashes, wanted)).tolist():
                if (v := self.text[at : at + n]) in known:
                    found[v].append(at)
        return found

    def best(self, value: str, places: list[int]) -> tuple[Box, str] | None:
        """The first stretch of whole words that is the value, else the smallest that holds it."""
        held: list[tuple[float, int, Box]] = []
        for at in places:
            i, j = bisect_right(self.starts, at) - 1, bisect_right(self.ends, at + len(value) - 1)
            if j - i >= WINDOW:
                continue
            box = self.around(range(i, j + 1))
            if self.starts[i] == at and self.ends[j] == at + len(value):
                return box, "exact"
            held.append(((box[3] - box[1]) * (box[4] - box[2]), at, box))
        return (min(held)[2], "inside") if held else None

    def around(self, members) -> Box:
        own = [self.boxes[k] for k in members]
        return own[0][0], min(w[1] for w in own), min(w[2] for w in own), max(w[3] for w in own), max(w[4] for w in own)


def _block(parts: list[Box]) -> Box:
    """Around the parts that stand closest together, on the page that has most of them."""
    pages = [b[0] for b in parts]
    page = max(dict.fromkeys(pages), key=pages.count)
    own = sorted((b for b in parts if b[0] == page), key=lambda b: b[2])
    groups = [[own[i]] + [b for b in own[i + 1 :] if b[4] - own[i][2] <= BLOCK_HEIGHT] for i in range(len(own))]
    group = min(groups, key=lambda g: (-len(g), g[-1][4] - g[0][2]))
    return page, min(b[1] for b in group), min(b[2] for b in group), max(b[3] for b in group), max(b[4] for b in group)


def pieces(value: str) -> list[str]:
    """The parts of an address or the like, in which another column may stand between the lines."""
    own = [_plain(p) for p in value.split(",")]
    return [p for p in own if len(p) >= 3]


def find(words: list[tuple], values: list[str | None]) -> list[tuple[Box, str] | None]:
    page = Page(words)
    plain = [_plain(v) for v in values]
    parts = [pieces(v) if v else [] for v in values]
    places = page.places({p for p in [*plain, *(x for own in parts for x in own)] if len(p) >= LEAST})
    out: list[tuple[Box, str] | None] = []
    for value, own in zip(plain, parts, strict=True):
        hit = page.best(value, places[value]) if len(value) >= LEAST else None
        if hit is None and len(own) >= 2:
            boxes = [b[0] for p in own if (b := page.best(p, places[p]))]
            hit = (_block(boxes), "block") if len(boxes) >= 2 else None
        out.append(hit)
    return out


def locate(words: DataFrame, values: DataFrame) -> DataFrame:
    """values(doc_id, id, text) -> (doc_id, id, page, x0, y0, x1, y1, how) of those that are found.

    how is exact (whole words), inside (a part of the words in the box) or block (two or more of its parts, divided by commas, stand close together).  Blanks do not count; a value goes over lines that
    follow each other, never over pages, and has WINDOW words at most.  The words of one document come to one task."""
    kinds = {c: values.schema[c].dataType.simpleString() for c in ("doc_id", "id")}
    names = ["doc_id", "id", "page", "x0", "y0", "x1", "y1", "how"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, held, asked = (batch.column(c) for c in ("doc_id", "w", "q"))
        own = list(zip(*(held.flatten().field(i).to_pylist() for i in range(6)), strict=True))
        ids, texts = (asked.flatten().field(i) for i in range(2))
        texts = texts.to_pylist()
        kept: list[tuple] = []
        at_w, at_q = ([o - of[0] for o in of] for of in (held.offsets.to_pylist(), asked.offsets.to_pylist()))
        for k in range(len(docs)):
            hits = find(own[at_w[k] : at_w[k + 1]], texts[at_q[k] : at_q[k + 1]])
            kept += [(k, at_q[k] + i, *box, how) for i, hit in enumerate(hits) if hit is not None for box, how in [hit]]
        doc, at = (pa.array([r[i] for r in kept], pa.int64()) for i in range(2))
        plain = [pa.array([r[i + 2] for r in kept], kind) for i, kind in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string()))]
        return pa.RecordBatch.from_arrays([docs.take(doc), ids.take(at), *plain], names=names)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield run(batch.slice(at, TOGETHER))

    # a document is one row with its words and one with its values, so a call takes many documents
    numbers = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    held = words.select("doc_id", F.struct(F.col("page").cast("int").alias("page"), *numbers, "text").alias("w")).groupBy("doc_id").agg(F.collect_list("w").alias("w"))
    asked = values.select(F.col("doc_id").alias("_doc"), F.struct("id", "text").alias("q")).groupBy("_doc").agg(F.collect_list("q").alias("q"))
    met = asked.join(held, F.col("_doc") == F.col("doc_id")).select(F.col("_doc").alias("doc_id"), "w", "q")
    return met.mapInArrow(every, f"doc_id {kinds['doc_id']}, id {kinds['id']}, page int, x0 double, y0 double, x1 double, y1 double, how string")


def locate_items(words: DataFrame, items: DataFrame) -> DataFrame:
    """items(doc_id, item, description, amount) -> (doc_id, item, page, x0, y0, x1, y1): around description and amount; around the amount's whole row where the description is not found."""
    asked = items.select("doc_id", F.explode(F.array(F.struct("item", F.lit("d").alias("what"), F.col("description").alias("text")), F.struct("item", F.lit("a").alias("what"), F.col("amount").alias("text")))).alias("q"))
    kind = items.schema["item"].dataType
    named_by = F.concat("q.what", F.col("q.item").cast("string"))
    found = locate(words, asked.select("doc_id", named_by.alias("id"), "q.text")).select("doc_id", F.expr("substring(id, 2)").cast(kind).alias("item"), F.substring("id", 1, 1).alias("what"), "page", "x0", "y0", "x1", "y1")
    box = F.struct("page", "x0", "y0", "x1", "y1")
    both = found.groupBy("doc_id", "item").agg(F.max(F.when(F.col("what") == "d", box)).alias("d"), F.max(F.when(F.col("what") == "a", box)).alias("a"))
    alone = both.where("d IS NULL").select("doc_id", "item", F.col("a.page").alias("_page"), ((F.col("a.y0") + F.col("a.y1")) / 2).alias("_y"))
    row = words.join(alone.withColumnRenamed("doc_id", "_doc"), (F.col("doc_id") == F.col("_doc")) & (F.col("page") == F.col("_page")) & (F.col("_y") >= F.col("y0")) & (F.col("_y") <= F.col("y1")))
    wide = row.groupBy("doc_id", "item").agg(F.max("page").cast("int").alias("page"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    same = F.col("a").isNotNull() & (F.col("a.page") == F.col("d.page"))
    edge = lambda f, c: F.when(same, f(F.col(f"d.{c}"), F.col(f"a.{c}"))).otherwise(F.col(f"d.{c}")).alias(c)
    named = both.where("d IS NOT NULL").select("doc_id", "item", F.col("d.page").alias("page"), edge(F.least, "x0"), edge(F.least, "y0"), edge(F.greatest, "x1"), edge(F.greatest, "y1"))
    return named.unionByName(wide)
