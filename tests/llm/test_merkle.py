"""Operator 12 against a plain tree, on every shape a tree may have, on odd rows, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tallyframe.llm import merkle
from tallyframe.llm.queries import ORACLES, QUERIES


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    fields = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes, fanout):
    """The last node, and for each the (place, others) on its way."""
    level, at, ways = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for w, a in zip(ways, at):
            run = level[a - a % fanout : a - a % fanout + fanout]
            w.append((a % fanout, run[: a % fanout] + run[a % fanout + 1 :]))
        level = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        at = [a // fanout for a in at]
    return level[0], ways


def fold(node, way):
    for place, others in way:
        node = sha("".join(others[:place] + [node] + others[place:]))
    return node


def plain(rows, fanout=16):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by_source[s], key=lambda r: (r.doc_id is not None, r.doc_id, leaf(r, r.text)))
        trees[s] = own, *climb([leaf(r, r.text) for r in own], fanout)
    root, tops = climb([trees[s][1] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        own, subroot, ways = trees[s]
        for r, way in zip(own, ways):
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if changed else r.text
            again = fold(leaf(r, text), way + top)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, sha("".join("".join(o) for _, o in way + top)), again, again == root))
    return out


key = lambda r: tuple((x is not None, x) for x in r)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def check(docs, fanout=16):
    out = merkle.manifest(docs, found=merkle.lowered_fifth(docs), fanout=fanout).collect()
    assert sorted(map(tuple, out), key=key) == sorted(plain(docs.collect(), fanout), key=key)
    return out


def test_query_matches_plain_tree_and_sql(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, small).collect()), key=key)
    assert out == sorted(plain(docs.collect()), key=key)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(duck.execute(ORACLES["op12_merkle_manifest"]).fetchall(), key=key) == out
    assert {r[6] for r in out} == {True, False}


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, None: 1}, {"b": 16, "a": 17, "": 1}, {"a": 257, "ä": 256, "Z": 255}])
def test_shapes(spark, sizes):
    rng = random.Random(12)
    rows = [(i * 7 % 1009, rng.choice(["Text A", "b", None, ""]), "en", s, i) for s, n in sizes.items() for i in range(n)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_tall_trees_of_small_runs(spark):
    # runs of two: blocks of 4 leaves, of 8 nodes above, and more than one block of those
    rows = [(i, f"T{i}", None, "one" if i % 3 else f"s{i}", i) for i in range(130)]
    check(spark.createDataFrame(rows, SCHEMA), fanout=2)


def test_paths_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(60)], SCHEMA)
    for r in merkle.manifest(docs, with_paths=True).collect():
        assert r.verified and r.folded_root == r.root
        assert fold(r.leaf, [(p.place, [p.siblings[k : k + 64] for k in range(0, len(p.siblings), 64)]) for p in r.path]) == r.root
        assert sha("".join(p.siblings for p in r.path)) == r.proof_sha256


def test_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "id", "score").selectExpr("*", "CASE WHEN doc_id > 4 THEN 's' END AS source", "CAST(NULL AS bigint) AS n_chars", "1 AS digest", "2 AS at", "'x' AS root")
    out = check(docs)
    assert len(out) == docs.count() and len(set(r.root for r in out)) == 1
    assert merkle.manifest(docs.where("doc_id < 0")).count() == 0
    assert not [r for r in out if not r.verified and r.id is None]


def test_a_change_is_found_by_one_row(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(50)], SCHEMA)
    out = merkle.manifest(docs, found=F.when(F.col("doc_id") == 31, F.lit("t31 "))).where("NOT verified").collect()
    assert [r.id for r in out] == [31]
