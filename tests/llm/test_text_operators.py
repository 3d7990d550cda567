"""Operators 2, 4, 5, 7, 8 against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tallyframe.llm import bpe, decontamination, line_dedup, quality_rules, secrets

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


# ---- 2


def brute_lines(docs):
    """docs: (id, text) in the order of ids."""
    first, gone = {}, {}
    for doc, text in docs:
        lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", x)]
        for k in range(len(lines) - 2):
            window = tuple(x for _, x in lines[k : k + 3])
            place = (doc, lines[k][0], lines[k + 2][0])
            if window not in first:
                first[window] = place
            else:
                f = first[window]
                start = max(place[1], f[2] + 1) if f[0] == doc else place[1]
                gone.setdefault(doc, set()).update(range(start, place[2] + 1))
    return {doc: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ())) for doc, text in docs}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    lines = [f"line {i}" for i in range(6)] + ["", "  "]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 14)))) for i in range(80)] + [(100, None), (101, "A\nA\nA\nA\nA\nA")]
    out = line_dedup.deduplicate_lines(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert {r.doc_id: r.text for r in out} == brute_lines(docs)
    assert {r.doc_id: r.text for r in out}[101] == "A\nA\nA"


def test_line_dedup_odd_rows(odd, none):
    out = line_dedup.deduplicate_lines(odd, counts=True)
    assert out.columns == [*odd.columns, "_n_lines", "_n_removed"]
    assert out.count() == odd.count() and out.where("_n_removed > 0").count() == 0
    assert out.where("text IS NULL").count() == 1 and out.where("doc_id IS NULL AND text IS NOT NULL").count() == 1
    assert line_dedup.deduplicate_lines(none).count() == 0


def test_line_dedup_tells_rows_of_one_id_apart(spark, monkeypatch):
    rows = [(1, "p\nq\nr"), (5, "p\nq\nr\ns"), (5, "u\nv\nw\nz"), (5, "u\nv\nw\nz"), (None, "p\nq\nr"), (None, None), (7, "u\nv\nw")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    want = [(1, "p\nq\nr"), (5, "s"), (5, "u\nv\nw\nz"), (5, "u\nv\nw\nz"), (None, "p\nq\nr"), (None, None), (7, "")]
    for most in (line_dedup.ROWS, 0):
        monkeypatch.setattr(line_dedup, "ROWS", most)
        assert sorted(map(str, line_dedup.deduplicate_lines(docs).collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in want)


def test_line_dedup_keeps_columns_with_its_own_names(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 1, 2, 3, 4), (2, "a\nb\nc", 5, 6, 7, 8)], "doc_id int, text string, _lines int, _id int, _of int, lines int")
    assert [tuple(r) for r in line_dedup.deduplicate_lines(docs).orderBy("doc_id").collect()] == [(1, "a\nb\nc", 1, 2, 3, 4), (2, "", 5, 6, 7, 8)]


def test_line_dedup_is_native(odd):
    plan = line_dedup.deduplicate_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 4


def brute_secrets(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate((("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_long_logins_are_found(spark):
    texts = [f"see https://bob:{'x' * 70}@host.example/ and", f"ftp://{'u' * 500}:{'p' * 5000}@{'h' * 400}", "http://bob:pw@host", "a" * 5000 + "://u:secret@h", "x" * 200_000 + " https://bob:hunter2@h.example"]
    out = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    spans = [[(s.start, s.end) for s in r.found if s.kind == "url_login"] for r in out]
    assert spans == [[(4, 99)], [(0, 5908)], [], [(4979, 5013)], [(200_001, 200_030)]]


def test_secrets_match_brute_force(spark):
    rng = random.Random(4)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "ſecret", "Key", "=", " : ", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "0123456789abcdef", "x", " ", "é😀", "\n", "ghp_" + "a" * 36, "AKI", "hunter2hunter2"]
    texts = [(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(600)]
    out = secrets.scan(spark.createDataFrame(texts, "doc_id int, text string")).collect()
    for r in out:
        base = brute_secrets(texts[r.doc_id][1])
        assert [tuple(s) for s in r.found if s.kind in ("assign", "access", "hex")] == base
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
    assert any(s.kind == "repository_token" for r in out for s in r.found)


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == secrets.Query.ANY
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert secrets.trigram_query("(?:abcd|xyz)?q") == secrets.Query.ANY
    assert secrets.trigram_query("ab[cd]e") == ("or", (("and", (b"abc", b"bce")), ("and", (b"abd", b"bde"))))


def test_secrets_odd_rows(odd, none):
    out = secrets.scan(odd)
    assert out.count() == odd.count()
    assert {r.spans for r in out.where("doc_id IN (2, 3, 4)").collect()} == {""}
    assert secrets.scan(none).count() == 0
    redacted = secrets.redact(odd.withColumn("text", F.concat("text", F.lit(" token=abcdefgh12"))))
    assert redacted.columns == odd.columns
    assert redacted.where("text LIKE '%abcdefgh12%'").count() == 0 and redacted.where("text IS NULL").count() == 1


# ---- 5


def test_bpe_is_what_the_library_gives(spark):
    rng = random.Random(5)
    parts = ["a", "th", "e ", "  ", "\n", "\t", "\x1c", "\x85", " ", "漢", "é", "½", "²", "Ⅷ", "'s", "'S", "<|endoftext|>", "😀", "​", "ɐ", "_", "\x00", "٣", "lly", "1"]
    texts = [(i, "".join(rng.choices(parts, k=rng.randint(0, 50)))) for i in range(400)] + [(1000 + i, "".join(rng.choices("abcdeth", k=n))) for i, n in enumerate((200, 257, 3000, 4095, 4097, 9000))]
    out = bpe.tokenize(spark.createDataFrame(texts, "doc_id int, text string"), PATH, public_tokenizers.PATTERN)
    by_id = dict(texts)
    for r in out.collect():
        ids = TIKTOKEN.encode_ordinary(by_id[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()
    back = bpe.detokenize(out, PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == by_id


def test_bpe_odd_rows(odd, none):
    out = bpe.tokenize(odd, PATH, public_tokenizers.PATTERN, with_ids=False)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    empty = hashlib.sha256(b"").hexdigest()
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count()
    assert all(rows[i].n_tokens == 0 and rows[i].ids_sha256 == empty == rows[i].decoded_sha256 for i in (2, 3))
    assert bpe.tokenize(none, PATH, public_tokenizers.PATTERN).count() == 0


# ---- 7


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(7)
    parts = ["a", "b", "c", " ", " ", "\n", "\x0b", "#", "é😀", "the "]
    texts = [(i, "".join(rng.choices(parts, k=rng.randint(0, 300)))) for i in range(150)]
    for r in quality_rules.judged(spark.createDataFrame(texts, "doc_id int, text string")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id][1])
        assert not (r.kept and r.base_failed)


def test_quality_filters_stay_above_the_counts(odd, none):
    judged = quality_rules.judged(odd)
    good = judged.where("NOT base_failed AND n_words < 50").select("doc_id", F.explode(F.array_append("broken_rules", F.lit("-"))).alias("rule"))
    expected = {r.doc_id for r in judged.collect() if not r.base_failed and r.n_words < 50}
    assert {r.doc_id for r in good.collect()} == expected
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_quality_counts_where_packed_hashes_would_collide(spark, monkeypatch):
    """With places of few bits upper halves agree by chance, and texts have more windows than places."""
    rng = random.Random(17)
    texts = [(i, " ".join(rng.choices("abc", k=rng.randint(10, 90)))) for i in range(60)]
    for bits in (3, 62):
        monkeypatch.setattr(quality_rules, "_AT", (1 << bits) - 1)
        for r in quality_rules.judged(spark.createDataFrame(texts, "doc_id int, text string")).collect():
            assert r.n_repeat_words == brute_quality(texts[r.doc_id][1])[4]


def test_quality_odd_rows(odd, none):
    rows = quality_rules.judged(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].n_words == 0 and by_id[i].base_failed and not by_id[i].kept for i in (2, 3, 4))
    assert by_id[1].kept and by_id[5].n_words == 60_000
    assert quality_rules.judged(none).count() == 0
    custom = quality_rules.judged(odd, rules=[quality_rules.Rule("stop_word_ratio", least=0.9)])
    assert custom.where("doc_id = 1").first().broken_rules == ["stop_word_ratio"]


# ---- 8


def brute_hits(text, items):
    get = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, covered, found = get(text), set(), set()
    for item, t in items:
        own = get(t)
        n = min(10, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    covered |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(covered), len(found), decontamination.digest(sorted(found)), bool(covered)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["One", "two", "drei", "é", "x1", "-", "FIVE", "y"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.randint(0, 16))) for i in range(12)] + [(None, "null item passage with eleven words in it as you see"), (50, None)]
    docs = [(i, " ".join([say(rng.randint(0, 20)), rng.choice(items)[1] or "", say(3)])) for i in range(60)] + [(60, None), (61, "So: NULL item, passage with eleven words in it as you see!")]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    expected = {i: brute_hits(t, items) for i, t in docs}
    for bytes_ in (1 << 20, 120):  # in one block, and in many
        out = decontamination.summary(decontamination.scan(d, b, block_bytes=bytes_)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in out} == expected
    clean = decontamination.decontaminate(d, b)
    assert {r.doc_id for r in clean.collect()} == {i for i, e in expected.items() if not e[4]}
    cut = decontamination.decontaminate(d, b, remove="spans")
    assert cut.columns == d.columns and cut.count() == d.count()
    assert cut.where("doc_id = 61").first().text == "So: !"
    for bytes_ in (1 << 20, 120):  # every row, nulls and empty texts among them
        rows = {r.doc_id: r.text for r in decontamination.decontaminate(d, b, remove="spans", block_bytes=bytes_).collect()}
        assert rows[60] is None and rows[61] == "So: !"
        assert all(rows[i] == t for i, t in docs if not expected[i][4])
        assert all(len(rows[i]) < len(t) for i, t in docs if expected[i][4])


def test_decontamination_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([("a", "quick brown fox jumps over the lazy dog near the river"), ("b", "")], "item_id string, text string")
    out = decontamination.summary(decontamination.scan(odd, bench))
    assert [r.doc_id for r in out.where("contaminated").collect()] == [1]
    assert decontamination.decontaminate(odd, bench).columns == odd.columns
    spans = decontamination.decontaminate(odd, bench, remove="spans")
    assert spans.columns == odd.columns and len(spans.collect()) == odd.count()
    assert {r.doc_id: r.text for r in spans.collect()}[1] == "The  bank today"
    twice = bench.union(bench)
    assert decontamination.summary(decontamination.scan(odd, twice)).collect() == decontamination.summary(decontamination.scan(odd, bench)).collect()
    assert decontamination.scan(none, bench).count() == 0
    assert decontamination.scan(odd, bench.where("item_id = 'c'")).where("size(_hits) > 0").count() == 0
