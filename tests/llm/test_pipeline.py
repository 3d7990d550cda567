"""The pipeline against a plain version of its stages, on the smallest tables."""

import re

import pytest

from tallyframe.llm import decontamination, toxicity
from tallyframe.llm.queries import ORACLES, QUERIES

from test_near_copies import brute
from test_text_operators import TIKTOKEN, brute_hits, brute_lines

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_matches_plain_version(spark, small):
    out = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, small).collect()}
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(docs, labels)
    read = toxicity.Reader(model.names)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rows = [(i, t) for i, t in rows if model.scores([t], read)[0] < toxicity.THRESHOLD]
    cut = brute_lines(rows)
    kept = [i for i in cut if i in brute(list(cut.items()))]  # five words, similarity 0.8, all pairs
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = [i for i in kept if not brute_hits_any(cut[i], items)]
    assert out == {i: TIKTOKEN.encode_ordinary(cut[i]) for i in kept}
    assert 0 < len(out) < docs.count()


def brute_hits_any(text, items):
    """brute_hits is slow on long texts: only items that share a window's first word are tried."""
    words = set(decontamination.words(text.encode()))
    near = [(i, t) for i, t in items if any(w in words for w in decontamination.words(t.encode()))]
    joined = b" " + b" ".join(decontamination.words(text.encode())) + b" "
    hit = any(b" " + b" ".join(own[k : k + 10]) + b" " in joined for _, t in near if (own := decontamination.words(t.encode())) for k in range(max(1, len(own) - 9)))
    if len(text) < 300:
        assert hit == brute_hits(text, near)[4]
    return hit
