"""Operator 13 against all windows, in whole and in small batches, on odd rows, and against its SQL."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyframe.llm import substring_dedup
from tallyframe.llm.queries import ORACLES, QUERIES


def brute(texts, width=35):
    """(n_words, n_removed, kept) of each text."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {p for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for p in range(k, k + width)}
        out.append((len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return out


def texts_with_passages(rng, width, n):
    passages = [[f"p{k}x{i}" for i in range(rng.choice([width - 1, width, width + 1, 3 * width]))] for k in range(12)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            own = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(2 * width))]
            p = rng.choice(passages)
            a, b = sorted(rng.choices(range(len(p) + 1), k=2))
            words += own + (p if rng.random() < 0.6 else p[a:b])
        out.append(" ".join(words))
    return out + rng.sample(out, 5) + ["a " * (2 * width), "a b c " * width, " ".join(f"only{i}" for i in range(width))]


@pytest.mark.parametrize("period", range(1, 32))
def test_any_two_places_meet_on_the_cover(period):
    cover = set(substring_dedup.difference_cover(period))
    assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))
    assert period != 21 or len(cover) == 5


@pytest.mark.parametrize(("width", "batch"), [(35, 1 << 20), (35, 40), (7, 100), (2, 1 << 20), (12, 1)])
def test_matches_all_windows(spark, monkeypatch, width, batch):
    monkeypatch.setattr(substring_dedup, "BATCH", batch)
    texts = texts_with_passages(random.Random(width), width, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    out = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.cut(docs, width=width, buckets=5).collect()}
    assert out == dict(enumerate(brute(texts, width)))
    assert sum(r[1] for r in out.values()) > 0 and any(0 < r[1] < r[0] for r in out.values())


def test_marks_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BYTES", 0)
    texts = texts_with_passages(random.Random(1), 35, 40)
    out = substring_dedup.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in out} == dict(enumerate(brute(texts)))


def test_windows_hold_their_anchors():
    plan = substring_dedup.Plan(35)
    for n in (35, 36, 90):
        for p in plan.anchors(n).tolist():
            assert plan.windows(n, np.array([p])).tolist() == [i for i in range(n - 34) if i <= p and p + plan.anchor <= i + 35]


def test_query_matches_brute_force_and_sql(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    plain = {r.doc_id: (a, b, hashlib.sha256(k.encode()).hexdigest()) for r, (a, b, k) in zip(rows, brute([r.text for r in rows]))}
    out = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_substring_dedup"](spark, small).collect()}
    assert out == plain and any(v[1] for v in out.values())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert {r[0]: r[1:] for r in duck.execute(ORACLES["op13_substring_dedup"]).fetchall()} == plain


def test_odd_rows(odd, none):
    out = substring_dedup.deduplicate_substrings(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))  # nothing repeats 35 words
    twice = substring_dedup.deduplicate_substrings(odd.union(odd.where("doc_id = 5")))
    assert [r.text for r in twice.where("doc_id = 5").collect()] == ["", ""]
    assert substring_dedup.cut(odd, width=11).where("id = 7 AND n_removed > 0").count() == 0  # nine words each
    assert [r.kept for r in substring_dedup.cut(odd, width=9).where("id = 7").collect()] == ["", ""]
    assert substring_dedup.cut(none).count() == 0 and substring_dedup.deduplicate_substrings(none).count() == 0
    assert {r.n_words for r in substring_dedup.cut(odd).where("id IN (2, 3, 4)").collect()} == {0}
