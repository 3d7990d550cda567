"""Operator 11 against every start and period tried in turn, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np

from tallyframe.llm import periodic_runs
from tallyframe.llm.queries import QUERIES


def brute_runs(words, least=12):
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)  # periods ascend, so the smallest is kept
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return ["01"[bin(i).count("1") % 2] for i in range(n)]


def cases():
    rng = random.Random(11)
    yield []
    yield ["x"] * 11
    yield ["x"] * 12
    yield ["x"] * 400
    yield fibonacci(377)
    yield thue_morse(256)
    yield ["a", "b"] * 30 + ["c"] + ["a", "b"] * 30
    for k in range(300):
        size = rng.choice([1, 2, 3, 5, 30])
        words = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            part = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(1, 25))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (part * rng.randrange(2, 6))[: rng.randrange(6, 90)]
        yield words


def test_runs_match_brute_force():
    texts = [[w.encode() for w in words] for words in cases()]
    for together in (texts, texts[:1], texts[5:6]):
        assert periodic_runs.runs_of(together) == [brute_runs(t) for t in together]
    for least in (2, 5, 13):
        some = texts[:60]
        assert periodic_runs.runs_of(some, least) == [brute_runs(t, least) for t in some]


def test_small_chunks_change_nothing(monkeypatch):
    texts = [[w.encode() for w in words] for words in cases()]
    whole = periodic_runs.runs_of(texts)
    monkeypatch.setattr(periodic_runs, "CHUNK", 7)
    monkeypatch.setattr(periodic_runs, "ROUNDS", 0)
    assert periodic_runs.runs_of(texts) == whole


def test_overlap_is_the_least_there_is():
    for least in range(2, 40):
        assert periodic_runs.overlap(least) == min(max(least, 2 * q) - q for q in range(1, 100))


def test_masks_keep_every_run():
    words = [w.encode() for words in cases() for w in words]
    doc = np.zeros(len(words), np.int64)
    begin, end = periodic_runs.segments(words, doc, 12)
    for s, n, _ in periodic_runs.runs_of([words])[0]:
        assert ((begin <= s) & (s + n <= end)).any()


def plain(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_matches_brute_force(spark, small):
    rows = [r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r.text or "") < 4000]
    out = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, small).collect()}
    assert len(rows) > 150
    assert {r.doc_id: out[r.doc_id] for r in rows} == {r.doc_id: plain(r.doc_id, r.text) for r in rows}
    assert sum(v[0] > 0 for v in out.values()) > len(out) // 15


def test_odd_rows(odd, none):
    out = periodic_runs.find_runs(odd)
    assert out.columns == ["id", "n_words", "runs", "collapsed"] and out.count() == odd.count()
    by_id = {r.id: r for r in out.collect()}
    assert by_id[2].n_words == by_id[3].n_words == by_id[4].n_words == 0 and by_id[2].collapsed == "" and by_id[2].runs == []
    assert by_id[None].collapsed == "a text without an id stays what it is"
    assert by_id[5].n_words == 60_000 and by_id[5].runs == []
    assert periodic_runs.find_runs(none).count() == 0


def test_long_periodic_text(spark):
    text = "one two three " * 100_000
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 3)] and row.collapsed == "one two three"
