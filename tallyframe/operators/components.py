"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import checkpointed, release


#: Edges that one task joins by itself; more go through rounds over all tasks.
FEW = 250_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges, by a forest whose roots are the least nodes."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(n) for n in nodes], kind)], names=["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b), any order, repeats and loops allowed -> (node, component), the least node of each component.

    Only nodes with an edge to another one are returned.  Every step is a minimum for each node and a join with it,
    so no neighbourhood is gathered; each round is checkpointed, and rounds end when the edges stay the same.  Up to FEW edges
    are joined in one task instead, as a round over all tasks costs more than they do."""
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    if state[0] <= FEW:
        kind = now.schema["a"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node's smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        then = checkpointed(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        state, last = _state(then), state
        now = then
        if state == last:
            break
        del both, least, large, small, then
        release(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and a checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
