"""Likely parties against all pairs."""

import difflib

from tallyframe.operators import parties
from tallyframe.plans import catalogue

PARTIES = [
    (1, "Greyvane Partners Ltd", "active"), (2, "Graywane Partner", "active"), (3, "Acme Global Services", "active"), (4, "Monolith", "active"), (5, "Monolit", None),
    (6, "Monolyth", "active"), (7, "Monolith Inc", "archived"), (8, "abc abc", "active"), (9, "Moonolith", "active"), (10, "Menolith", "active"), (11, "Monaliths", "active"),
    (12, "", "active"), (13, None, "active"), (14, "Mono-Lith", "active"), (15, "x" * 300, "active"), (16, "a b c d e longlonglong", "active"),
]
ALIASES = [(3, "AGS"), (4, "The Monolith Works"), (7, "Monolith"), (1, None), (99, "Monolith")]
ASKED = ["monolith", "Monolith", "Global Services Acme", "grayvane partners", "ags", "", None, "x" * 299, "a b c d e othertotally", "Zebra"]


def similarity(a, b):
    if a == b:
        return 1.0
    x, y = set(a.split(" ")), set(b.split(" "))
    return max(difflib.SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y))


def plain(asked, known):
    """asked keys, known (party, key) -> the best five of each."""
    out = set()
    for a in set(asked) - {""}:
        best = {}
        for p, b in known:
            s = similarity(a, b) if b else 0.0
            if s >= parties.SUGGEST:
                best[p] = max(best.get(p, 0.0), s)
        out |= {(a, p, round(s, 9), n) for n, (p, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[: parties.TOP], 1)}
    return out


def keys(spark, names):
    frame = spark.createDataFrame([(n, x) for n, x in enumerate(names)], "n int, name string")
    return [r.k for r in frame.select("n", parties.party_key(frame["name"]).alias("k")).orderBy("n").collect()]


def test_fuzzy_candidates_are_all_pairs(spark):
    known = spark.createDataFrame(PARTIES, "party_id bigint, name string, status string")
    aliases = spark.createDataFrame(ALIASES, "party_id bigint, alias string")
    asked = spark.createDataFrame([(a,) for a in ASKED], "name string")
    active = [(p, n) for p, n, s in PARTIES if s != "archived"]
    rows = active + [(p, n) for p, n in ALIASES if p in {q for q, _ in active}]
    want = plain(keys(spark, ASKED), list(zip([p for p, _ in rows], keys(spark, [n for _, n in rows]), strict=True)))
    for block in (2, 4_000):
        out = parties.fuzzy_candidates(asked, known, aliases, block=block).collect()
        assert {(r.norm, r.party_id, round(r.score, 9), r["rank"]) for r in out} == want and len(out) == len(want)
    assert len([w for w in want if w[0] == "monolith"]) == 5 and any(w[:2] == ("ags", 3) for w in want)
    assert parties.fuzzy_candidates(asked.where("name = 'none'"), known).count() == 0


def test_fuzzy_query_is_all_pairs(spark, small):
    part = [(r.p_partkey, f"{r.p_name} {r.p_partkey % 97}") for r in spark.read.parquet(f"{small}/part.parquet").collect()]
    known = list(zip([p for p, _ in part], keys(spark, [n for _, n in part]), strict=True))
    want = plain(keys(spark, [n.replace("e", "ee") for p, n in part if p % 50 == 0]), known)
    out = catalogue.QUERIES["fuzzy_party_ratio"](spark, small).collect()
    assert {(r.norm, r.party_id, round(r.score, 9), r["rank"]) for r in out} == want and want


def test_names_part_at_punctuation_and_symbols(spark):
    marks = ".,;:!?'\"`´’“”()[]{}<>/\\|+*&#@~^$%_—–-"
    assert keys(spark, [f"a{m}b" for m in marks]) == ["a b"] * len(marks)


def test_many_parties_of_one_name(spark):
    """Of parties with one key only the least can be among the best; no other row is made."""
    rows = [(n, f"large ring {n % 7}") for n in range(700)] + [(n, "large rang 3") for n in range(700, 705)]
    known = spark.createDataFrame(rows, "party_id bigint, name string")
    asked = spark.createDataFrame([("large ring 3",), ("largee rings",), ("large rang 33",)], "name string")
    firsts = parties._firsts(known.selectExpr("party_id", "name b"), parties.TOP).collect()
    assert len(firsts) == 8 and all(len(r.ids) == parties.TOP for r in firsts)
    want = plain(["large ring 3", "largee rings", "large rang 33"], rows)
    out = parties.fuzzy_candidates(asked, known).collect()
    assert {(r.norm, r.party_id, round(r.score, 9), r["rank"]) for r in out} == want and len(out) == len(want)
