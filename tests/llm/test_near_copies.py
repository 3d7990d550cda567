"""The pipeline's near-dedup stage against all pairs."""

import random

import numpy as np

from tallyframe.llm import near_copies, simhash


def brute(rows, similarity=0.8):
    """The ids that stay."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    label = [i for i, _ in rows]
    for x in range(len(rows)):
        for y in range(x):
            shared = len(sets[x] & sets[y])
            if sets[x] == sets[y] or shared and 10 * shared >= round(10 * similarity) * (len(sets[x]) + len(sets[y]) - shared):
                a, b = sorted((label[x], label[y]))
                label = [a if c == b else c for c in label]
    return {i for (i, _), c in zip(rows, label, strict=True) if i == c}


def texts():
    """Groups of copies with more and more words changed, a passage that many share, and short and empty texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([40, 200]))]
        for n in range(9):
            copy = list(base)
            for at in rng.sample(range(len(copy)), n * len(copy) // 200):
                copy[at] = word()
            out.append(" ".join(copy))
    hot = [word() for _ in range(100)]
    for k in range(60):
        out.append(" ".join([*hot[:50], word(), *hot[50:]]))
        out.append(" ".join([*passage, *[word() for _ in range(20 + k % 20)]]))
    rng.shuffle(out)
    return [*enumerate([*out, "", None, "one two", "ONE  two", "one two three"])]


def test_stage_catches_what_all_pairs_catch(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = {r.doc_id for r in near_copies.deduplicate(docs).collect()}
    assert out == brute(rows)
    assert 20 < len(out) < 150


def test_pipeline_stage_drops_a_copy_beyond_four_bits(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id IN (1, 177)")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect()] == [1]


def test_other_similarities_and_shingles(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    fewer = {r.doc_id for r in simhash.deduplicate(docs, similarity=0.5, shingle=5).collect()}
    assert fewer == brute(rows, 0.5) and fewer < brute(rows)


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    rng = random.Random(9)
    say = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    a, b, c = say(), say(), say()
    rows = [(5, a), (5, b), (3, b), (5, a), (None, c), (None, c), (None, a), (8, c + " end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, near_copies.deduplicate(docs).collect())) == sorted([(5, a), (3, b), (8, c + " end")])
    alone = docs.where("doc_id IS NULL OR doc_id = 5")
    got = sorted(map(tuple, near_copies.deduplicate(alone).collect()), key=str)
    assert got == sorted([(5, a), (5, b), (None, c)], key=str)


def test_rows_with_odd_ids(odd, none):
    out = near_copies.deduplicate(odd)
    assert out.columns == odd.columns and sorted(r.doc_id or -1 for r in out.collect()) == [-1, 1, 2, 5, 6, 7, 9]
    assert near_copies.deduplicate(none).count() == 0


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    of, ruled_out = near_copies.bound(0.8), 0
    for n in (0, 1, 2, 3, 4, 5, 8, 9, 60, 64, 65, 700, 5000):
        base = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        for share in (1.0, 0.95, 0.9, 0.85, 0.8, 0.6, 0.3, 0.0):
            kept = base[: round(len(base) * share)]
            other = np.unique(np.concatenate([kept, rng.integers(-(1 << 63), 1 << 63, (len(base) - len(kept)) // 2)]))
            may = near_copies.may_be_similar(memoryview(near_copies.sketch(base)), memoryview(near_copies.sketch(other)), of)
            assert may or not near_copies.similar(base, other, of)
            ruled_out += n >= 60 and share <= 0.6 and not may
    assert ruled_out == 5 * 3  # all unlike ones of the five larger sizes
