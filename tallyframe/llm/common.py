"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import checkpointed  # noqa: F401  (the text operators take it from here)

#: Text bytes that a Python worker handles at once; longer documents come alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def raw(column: pa.Array) -> list:
    """Strings as bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `limit` bytes of text or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= limit:
            yield batch
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, _y): documents whose label may be learned from; about `bound` of them at most.

    Labels of one id are merged (the largest counts); null ids and labels are left out.  When more than `bound`
    ids are labelled, a hash of the id chooses, the same ids each time.  The ids are at most about `bound`, so
    they are broadcast and the documents stay where they are.  Of equal texts one is kept, so that copies do not count
    as evidence, with the label that most of them have (1 of equally many).  Should ids repeat in docs with unlike texts,
    a hash of the text brings the rows down to the bound, too.  The sample is checkpointed, as a fit reads it more than once."""
    ids = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    ids = ids.where(learn)
    n = ids.count()
    if n > bound:
        cells = 1 << 20
        ids = ids.where(F.pmod(F.xxhash64("_id"), F.lit(cells)) < int(cells * bound / n))
    rows = docs.select(docs[id_col].alias("_doc"), docs[text_col].alias("text")).join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("text", "_y")
    once = rows.groupBy(F.xxhash64("text").alias("_h")).agg(F.min("text").alias("text"), (F.avg("_y") >= 0.5).cast("int").alias("_y"))
    once = checkpointed(once)
    n = once.count()
    if n > 2 * bound:
        once = once.where(F.pmod(F.xxhash64("_h"), F.lit(1 << 20)) < int((1 << 20) * bound / n))
    return once.select("text", "_y")
