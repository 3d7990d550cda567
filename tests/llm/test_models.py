"""Operators 1, 3, 6, 9, 10: brute force, held-out accuracy, odd rows."""

import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import chat_format, common, language_id, quality_model, simhash, toxicity
from tallyframe.operators import components


@pytest.fixture(scope="module")
def corpus(spark):
    base = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


# ---- 1


def test_toxicity_learns_planted_stems(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("aeioubdfgklmnprst"), 6))
    docs, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = [word() for _ in range(30)]
        if bad:
            words[int(rng.integers(30))] = "zorq" + word()
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, toxic int")
    model = toxicity.fit(d, y)
    out = toxicity.score(d, model).join(y, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in out) / len(out) > 0.97
    assert model.accuracy and all(0 <= r.score <= 1 for r in out)
    assert toxicity.reject(d, model).columns == d.columns


def test_toxicity_voters():
    said = lambda t: toxicity.votes_of(t, frozenset())
    assert said("idiot!") == ["idiot"] and said("idiots") == ["~plural"] and said("1d10t") == ["~disguised"]
    assert said("id*ot") == ["~masked"] and said("stuuupid") == ["~drawn_out"] and said("river") == [] and said("***") == []


def test_label_model_finds_accuracy_and_correlation():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    fire = lambda p, q: rng.random(4000) < np.where(y, p, q)
    a, b, c = fire(0.6, 0.02), fire(0.5, 0.05), fire(0.3, 0.3)
    twin = np.where(rng.random(4000) < 0.95, a, fire(0.5, 0.1))
    votes = np.column_stack([a, twin, b, c])
    annotated = np.where(rng.random(4000) < 0.9, y, ~y)
    model = toxicity.LabelModel()
    q = model.fit(np.column_stack([votes, ~votes.any(axis=1), annotated]), 0.05 + 0.9 * annotated)
    assert ((q > 0.5) == y).mean() > 0.88
    assert model.parent[0] == 1 or model.parent[1] == 0  # the twins are linked
    assert model.chance[1, 0, 2] / model.chance[0, 0, 2] > 3 > model.chance[1, 0, 3] / model.chance[0, 0, 3]


def test_toxicity_odd_rows(odd, none, labels, spark):
    model = toxicity.fit(odd, labels)
    out = toxicity.score(odd, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.score is not None and r.held_out is not None for r in rows)
    blank = toxicity.fit(odd, labels.where("toxic > 5"))
    scores = {r.doc_id: r.score for r in toxicity.score(odd, blank).collect()}
    assert scores[6] > 0.5 > scores[1] and scores[2] == scores[3] == scores[4]
    assert toxicity.score(none, model).count() == 0 and toxicity.fit(none, labels).names


def test_label_model_likelihood_never_falls():
    rng = np.random.default_rng(4)
    y = rng.random(1500) < 0.2
    votes = np.column_stack([rng.random(1500) < np.where(y, rng.uniform(0.1, 0.7), rng.uniform(0, 0.1)) for _ in range(12)] + [rng.random(1500) < 0.1])
    for free in (0, 1):
        model = toxicity.LabelModel(rounds=30)
        q = model.fit(votes, np.where(votes.any(axis=1), 0.8, 0.1), prior=0.2, free=free)
        assert len(model.trace) == 20 and all(b >= a - 1e-8 for a, b in zip(model.trace, model.trace[1:], strict=False))
        assert ((q > 0.5) == y).mean() > 0.85


def test_label_model_posterior_is_the_plain_product():
    rng = np.random.default_rng(5)
    votes = (rng.random((40, 5)) < 0.4).astype(float)
    model = toxicity.LabelModel(rounds=9)
    q = model.fit(votes, np.full(40, 0.4), prior=0.4, free=0)
    for row, found in zip(votes, q, strict=True):
        both = []
        for cls, share in ((0, 0.6), (1, 0.4)):
            p = share
            for j, v in enumerate(row):
                parent = model.parent[j]
                c = model.chance[cls, int(row[parent]) if parent >= 0 else 0, j]
                p *= c if v else 1 - c
            both.append(p)
        assert abs(both[1] / sum(both) - found) < 1e-9


def test_toxicity_without_the_annotation_as_a_voter(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, annotated=False)
    assert "(annotation)" not in model.accuracy
    out = toxicity.score(docs, model).where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.95


def plain_crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.mark.parametrize(("module", "modulus", "apart"), [(toxicity, 5, 0), (language_id, 3, 1), (quality_model, 4, 2)])
def test_held_out_is_the_remainder_of_crc32(corpus, spark, module, modulus, apart):
    docs, labels = corpus
    model = {toxicity: lambda: toxicity.fit(docs.limit(0), labels), language_id: lambda: language_id.fit(docs.limit(0)), quality_model: lambda: quality_model.fit(docs.limit(0), labels)}[module]()
    found = (module.predict if module is language_id else module.score)(docs, model).select("doc_id", "held_out").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (plain_crc(r.doc_id) % modulus == apart) for r in found)


def test_held_out_labels_are_not_learned(corpus):
    """The model is the same whatever the labels and languages of the rows apart."""
    docs, labels = corpus
    apart = lambda m, k: F.crc32(F.col("doc_id").cast("string")) % m == k
    a = quality_model.fit(docs, labels)
    b = quality_model.fit(docs, labels.withColumn("quality", F.when(apart(4, 2), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs, labels.withColumn("toxic", F.when(apart(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert a.names == b.names and np.allclose(a.weights, b.weights)
    a = language_id.fit(docs)
    b = language_id.fit(docs.withColumn("lang", F.when(apart(3, 1), "xx").otherwise(F.col("lang"))))
    assert a.languages == b.languages and (a.chance == b.chance).all()


def test_labelled_sample_is_one_and_bounded(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(500)] + [(20, "same"), (21, "same"), (22, "same"), (30, "tied"), (31, "tied")], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(20, 0), (21, 1), (22, 0), (30, 0), (31, 1)], "doc_id int, toxic int")
    every = F.lit(True)
    whole = {r.text: r["_y"] for r in common.labelled_sample(docs, labels, "toxic", every, 1000).collect()}
    assert len(whole) == 502 and whole["same"] == 0 and whole["tied"] == 1
    few = [sorted(r.text for r in common.labelled_sample(docs.repartition(n), labels, "toxic", every, 60).collect()) for n in (1, 5)]
    assert few[0] == few[1] and 20 < len(few[0]) <= 120


# ---- 3


def test_utterances():
    assert chat_format.utterances("Human", "hi\n### Assistant: ok\nmore\n<|user|>\nx\nQ: y\n[system] z") == [(1, "hi"), (2, "ok\nmore"), (1, "x"), (1, "y"), (0, "z")]
    assert chat_format.utterances(None, "User: a") == [(1, "a")]
    assert chat_format.utterances("who", None) == [(chat_format.UNMARKED, "")]


def brute_roles(rows, model):
    """rows: (conv, turn, role, text, tie) in order -> roles per conversation."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        said = [u for r in rows if r[0] == conv for u in chat_format.utterances(r[2], r[3])]
        emission = model.emission(np.array([m for m, _ in said]), np.array([chat_format.feature(t) for _, t in said]))
        out[conv] = [chat_format.ROLES[s] for s in model.decode(emission)]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_chats_recover_hidden_roles(spark, hot):
    chats = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    truth = {(r.conv_id, r.turn): r.role for r in chats.collect()}
    hidden = chats.withColumn("role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) < 3, None).otherwise(F.col("role")))
    if hot:  # one conversation over several partitions
        hidden = hidden.withColumn("turn", F.col("conv_id") * 100 + F.col("turn")).withColumn("conv_id", F.when(F.col("conv_id") < 60, F.lit(7)).otherwise(F.col("conv_id")))
    model = chat_format._learn(chat_format._parsed(hidden, "conv_id", "turn", "role", "text"))
    out = chat_format.format_chats(hidden).orderBy("conv_id", "turn_no").collect()
    rows = [(r.conv_id, r.turn, r.role, r.text, r.tie) for r in hidden.withColumn("tie", F.xxhash64("role", "text")).orderBy("conv_id", "turn", "tie").collect()]
    expected = brute_roles(rows, model)
    got = {}
    for r in out:
        assert r.turn_no == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append(r.role)
    assert got == expected
    if not hot:
        right = [truth[conv, turn] == got[conv][turn] for (conv, turn, role, _, _) in rows if role is None]
        assert np.mean(right) > 0.95


def test_chats_odd_rows(spark):
    rows = [(1, 1, None, None, "a"), (1, 1, None, None, "a"), (None, None, "bot", "x\n\n", "a"), (None, 2, "", "", "a"), (2, None, "nobody", "Q: why?\nA: so", "a")]
    chats = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, part string")
    out = chat_format.format_chats(chats)
    assert out.columns == ["conv_id", "turn_no", "role", "marked", "text", "rendered"]
    got = out.orderBy("conv_id", "turn_no").collect()
    assert len(got) == 6 and [r.role for r in got if r.conv_id == 2] == ["user", "assistant"]
    assert got[-1].rendered == "<|assistant|>\nso\n<|end|>"
    assert chat_format.format_chats(chats.where("turn > 9")).count() == 0


def test_equal_rows_of_several_utterances_follow_each_other(spark):
    rows = [(1, 1, None, "User: a\nAssistant: b")] * 3
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)).orderBy("turn_no").collect()
    assert [(r.role, r.text) for r in out] == [("user", "a"), ("assistant", "b")] * 3


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    model = chat_format.Model(rng.integers(0, 9, (4, 4)).astype(float), rng.integers(0, 9, 4).astype(float), rng.integers(0, 9, (4, chat_format.N_FEATURES)).astype(float))
    for n in (1, 2, 5, 6):
        emission = model.emission(rng.integers(-1, 4, n), rng.integers(0, chat_format.N_FEATURES, n))
        score = lambda p: model.begin[p[0]] + sum(model.after[a, b] for a, b in itertools.pairwise(p)) + sum(emission[i, s] for i, s in enumerate(p))
        best = max(map(score, itertools.product(range(4), repeat=n)))
        assert abs(score(model.decode(emission)) - best) < 1e-9
        held = (1, 2)  # the state before and the last one are given
        best = max(score(p) - model.begin[p[0]] + model.after[held[0], p[0]] for p in itertools.product(range(4), repeat=n) if p[-1] == held[1])
        found = model.decode(emission, *held)
        assert found[-1] == held[1] and abs(score(found) - model.begin[found[0]] + model.after[held[0], found[0]] - best) < 1e-9


def test_roles_are_recovered_without_the_role_column(spark):
    chats = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = chat_format.format_chats(chats, trust_roles=False).collect()
    agree = np.mean([r.role == r.given for r in out])
    assert len(out) == chats.count() and not any(r.marked for r in out)
    assert 0.95 < agree, agree


# ---- 6


def brute_components(ids, fps):
    f = np.array(fps, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    big = 1 << 60
    label = np.array([big if i is None else i for i in ids])
    while True:
        new = np.array([label[near[k]].min() for k in range(len(f))])
        if (new == label).all():
            return [None if x == big else int(x) for x in label]
        label = new


def test_simhash_classes_match_brute_force(corpus, spark):
    docs = corpus[0].select("doc_id", "text").limit(400)
    out = simhash.near_duplicates(docs).collect()
    assert [r.component for r in out] == brute_components([r.doc_id for r in out], [r.fp for r in out])
    h = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert simhash.fingerprint(b"A b  C d") == h and simhash.fingerprint(b" \n") == 0
    kept = simhash.deduplicate(docs)
    assert kept.count() == len({r.component for r in out}) and kept.columns == docs.columns


def plain_fingerprint(text, shingle=4):
    """By the definition, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    own = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def test_fingerprints_are_the_majority_of_the_hashes(corpus):
    docs = [r.text for r in corpus[0].limit(150).collect()]
    for text in [*docs, "", "A", "a b c d", "É a\x1cb\x85 c d e f", " ".join(["x y z"] * 40)]:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text or "")


def test_deduplicate_keeps_unlike_texts_of_one_id(spark):
    rng = np.random.default_rng(8)
    say = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))
    a, b, c = say(), say(), say()
    docs = spark.createDataFrame([(5, a, 1), (5, b, 1), (5, a, 1), (None, c, 1), (None, c, 1), (7, "", 1), (7, None, 1)], "doc_id bigint, text string, _gone int")
    kept = simhash.deduplicate(docs)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns and len(got) == 4
    assert [g for g in got if g[0] != 7] == sorted([(5, a), (5, b), (None, c)], key=str)
    more = docs.union(spark.createDataFrame([(3, b, 1), (4, c, 1)], docs.schema))
    got = sorted((r.doc_id, r.text) for r in simhash.deduplicate(more).collect() if r.doc_id != 7)
    assert got == sorted([(3, b), (5, a), (4, c)])


def test_hot_fingerprints_are_dealt_over_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one text of many rows" if i % 3 else f"text number {i} of its own kind {i * i}") for i in range(300)], "doc_id int, text string")
    expected = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    for few in (100_000, 0):
        monkeypatch.setattr(simhash, "HOT", 20)
        monkeypatch.setattr(simhash, "FEW", few)
        assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == expected


def test_covering_misses_no_pair():
    rng = np.random.default_rng(6)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & m == 0 for m in masks)


def test_oversized_keys_are_dealt_again(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    centre = rng.integers(0, 1 << 62, dtype=np.uint64)
    words = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(32, 3, replace=False))) for _ in range(200)], dtype=np.uint64))
    label = list(range(len(words)))
    find = lambda i: i if label[i] == i else find(label[i])
    for a, b in simhash._links(words, list(range(32)), 4):
        assert (words[a] ^ words[b]).bit_count() <= 4
        label[find(a)] = find(b)
    expected = brute_components(list(range(len(words))), words.view(np.int64))
    assert len({find(i) for i in range(len(words))}) == len(set(expected))


def test_crowded_keys_are_dealt_over_tasks(spark):
    rng = np.random.default_rng(6)
    hub = rng.integers(0, 1 << 63, dtype=np.uint64)
    words = [int(hub) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(400)] + [int(w) for w in rng.integers(0, 1 << 63, 200, dtype=np.uint64)]
    words = sorted(set(words))
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    found = simhash.links(spark.createDataFrame([(w,) for w in signed], "fp bigint"), crowd=20)
    classes = {w: w for w in signed}
    for r in components.connected_components(found).collect():
        classes[r["node"]] = r["component"]
    mine = {}
    for w in signed:
        mine.setdefault(classes[w], []).append(w)
    parent = list(range(len(words)))
    for i in range(len(words)):
        for j in range(i):
            if bin(words[i] ^ words[j]).count("1") <= 4 and parent[i] != parent[j]:
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    true = {}
    for i, p in enumerate(parent):
        true.setdefault(p, []).append(signed[i])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, true.values()))
    assert max(map(len, true.values())) > 20


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (200, 201)]
    out = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_odd_rows(odd, none):
    out = simhash.near_duplicates(odd).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == odd.count()
    assert by_id[2].fp == by_id[3].fp == by_id[4].fp == 0 and by_id[4].component == 2
    assert by_id[None].component is None
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), *[(True, i) for i in (1, 2, 5, 6, 7, 9)]]
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


# ---- 9


def test_languages_held_out(corpus):
    docs = corpus[0]
    model = language_id.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    out = language_id.predict(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    texts = {r.lang: r.text for r in docs.where("length(text) BETWEEN 800 AND 3000").collect()}
    mixed = model.predict(texts["de"][:800] + " " + texts["fr"][:500])
    assert mixed[0] == "de" and set(mixed[2]) == {"de", "fr"} and 0.45 < mixed[1] < 0.75


def test_language_odd_rows(odd, none):
    model = language_id.fit(odd)
    rows = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (2, 3, 4))
    assert rows[7].lang_pred == "de" and len(rows) == 9
    assert language_id.predict(odd, language_id.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(none, model).count() == 0


def plain_em(c, p, rounds=400):
    share = np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        share = share * (p @ (c / (share @ p))) / c.sum()
    return share, float(c @ np.log(share @ p))


def test_language_sets_are_those_of_the_best_penalised_likelihood(corpus):
    """Against all subsets of the languages, by plain EM from the model's table."""
    docs = corpus[0]
    model = language_id.fit(docs)
    texts = [r.text for r in docs.where("length(text) BETWEEN 200 AND 1500").orderBy("doc_id").limit(25).collect()]
    texts += [texts[k][:400] + " " + texts[-k - 1][:300] for k in range(10)]
    same = 0
    for text in texts:
        counts = np.bincount(language_id.cells(text), minlength=language_id.CELLS)
        at = np.flatnonzero(counts)
        c, p = counts[at].astype(float), model.chance[:, at]
        cost = language_id.PENALTY * np.log(c.sum() + 1)
        fits = {s: plain_em(c, p[list(s)]) for n in range(1, 5) for s in itertools.combinations(range(4), n)}
        best = max(fits, key=lambda s: fits[s][1] - cost * len(s))
        lang, score, chosen = model.predict(text)
        same += set(chosen) == {model.languages[i] for i in best}
        if set(chosen) == {model.languages[i] for i in best}:
            share = dict(zip(best, fits[best][0], strict=True))
            assert abs(score - max(share.values())) < 0.02
    assert same >= len(texts) - 1


def test_languages_of_small_share_are_left_to_the_penalty():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(300, 0.2), 6) + 1e-4
    c = 4000 * p[0] + 20 * p[3]  # half a percent
    share, _ = language_id._em(c, p, np.full(6, 1 / 6), 50)
    assert share[3] < 0.01
    assert language_id._worth_a_look(c, p, share, 0.5)[:2] == [0, 3]
    assert language_id._worth_a_look(c, p, share, 1e9) == [0]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some text", f"l{i % 5}") for i in range(60)], "doc_id int, text string, lang string")
    with pytest.raises(ValueError, match="a model holds 3"):
        language_id.fit(docs)


# ---- 10


def test_additive_scores_are_plain_sums_of_table_cells(corpus):
    docs, labels = corpus
    model = quality_model.fit(docs, labels)
    rows = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(200).collect():
        x = quality_model.features(r.text.encode())
        place = lambda edges, v: sum(e <= v for e in edges)
        z = model.intercept + sum(t[place(e, v)] for t, e, v in zip(model.tables, model.edges, x, strict=True))
        z += sum(t[place(model.coarse[a], x[a])][place(model.coarse[b], x[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(1 / (1 + math.exp(-z)) - rows[r.doc_id]) < 1e-9


def test_quality_held_out(corpus):
    docs, labels = corpus
    model = quality_model.fit(docs, labels)
    out = quality_model.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    assert model.pairs and all(0 <= r.score <= 1 for r in out)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(10)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit_additive(x, y, pairs=1)
    assert model.pairs == [(0, 1)]
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95


def test_quality_model_odd_rows(odd, none, labels):
    model = quality_model.fit(odd, labels)
    rows = quality_model.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_model.score(odd, quality_model.fit(none, labels)).collect()} == {0.5}
    assert quality_model.score(none, model).count() == 0 and quality_model.select(odd, model).columns == odd.columns
