"""Values and items found on pages."""

import random

from test_pages import words

from tallyframe.operators import boxes


def brute(ws, value):
    """The first window of whole words that is the value, else the smallest that holds it."""
    plain = lambda s: "".join(s.split())
    ws, want = sorted(ws, key=lambda w: (w[0], round(w[2], 1), w[1])), plain(value)
    held = []
    for i in range(len(ws)):
        joined, low = "", ws[i][2]
        for j in range(i, min(i + boxes.WINDOW, len(ws))):
            if ws[j][0] != ws[i][0] or (j > i and ws[j][2] - low > boxes.LINE_GAP):
                break
            low = max(low, ws[j][2])
            joined += plain(ws[j][5])
            own = ws[i : j + 1]
            box = (ws[i][0], min(w[1] for w in own), min(w[2] for w in own), max(w[3] for w in own), max(w[4] for w in own))
            if joined == want:
                return box, "exact"
            if want in joined:
                held.append(((box[3] - box[1]) * (box[4] - box[2]), i, box))
    return (min(held)[2], "inside") if held else None


def test_values_against_every_window():
    rng = random.Random(42)
    for _ in range(60):
        ws = []
        for page in (0, 1):
            for row in range(rng.randrange(1, 6)):
                y = 20.0 * row + 40 * (row > 2)
                ws += [(page, 30.0 * k, y, 30.0 * k + 25, y + 9, "".join(rng.choices("ab ", k=rng.randrange(1, 5))).strip() or "a") for k in range(rng.randrange(1, 5))]
        values = ["".join(rng.choices("ab", k=rng.randrange(2, 9))) for _ in range(20)] + ["a b", "zz"]
        got = boxes.find(ws, values)
        for value, hit in zip(values, got):
            want = brute(ws, value)
            assert (hit and hit[1]) == (want and want[1]), value
            if want and want[1] == "exact":
                assert hit == want
            elif want:  # the smallest box; of several equal ones any
                area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
                assert area(hit[0]) <= area(want[0])


def test_blocks_and_odd_values():
    ws = [(0, 40.0, 10.0, 90.0, 18.0, "12 Harbour Road"), (0, 300.0, 10.0, 360.0, 18.0, "other"), (0, 40.0, 30.0, 80.0, 38.0, "Suite 800"), (0, 300.0, 30.0, 360.0, 38.0, "column"), (0, 40.0, 500.0, 80.0, 508.0, "Suite 800")]
    assert boxes.find(ws, ["12 Harbour Road, Suite 800", "x", "", None, "no, such, place"]) == [((0, 40.0, 10.0, 90.0, 38.0), "block"), None, None, None, None]
    assert boxes.find([], ["abc"]) == [None]


def test_items(spark):
    page = words(spark, {
        "d": [(43, 274, 90, 284, "Professional"), (95, 274, 140, 284, "Fees"), (523, 274, 580, 284, "7,000.00"), (43, 300, 120, 310, "Totally"), (125, 300, 300, 310, "different"), (520, 300, 580, 310, "500.00")],
    })
    items = spark.createDataFrame([("d", 1, "Professional Fees", "7,000.00"), ("d", 2, "unmatchable long narrative", "500.00"), ("d", 3, "nowhere", "1.23"), ("d", 4, "Totally different", None), ("e", 1, "no words", "1.00")], "doc_id string, item int, description string, amount string")
    out = {(r.doc_id, r.item): (r.page, r.x0, r.y0, r.x1, r.y1) for r in boxes.locate_items(page, items).collect()}
    assert out == {("d", 1): (1, 43, 274, 580, 284), ("d", 2): (1, 43, 300, 580, 310), ("d", 4): (1, 43, 300, 300, 310)}


def test_short_and_hashed_searches_agree(monkeypatch):
    """Short documents with few values are searched without hashes; overlapping places count in both ways."""
    ws = [(0, 10.0 * k, 10.0, 10.0 * k + 8, 18.0, t) for k, t in enumerate(["aaaa", "ab", "a", "b 1", "aa"])]
    values = ["aa", "aab", "aba", "b1aa", "zz", None, "aaaa, b1a"]
    short = boxes.Page(ws).places({"aa", "aab", "zz"})
    plain = boxes.find(ws, values)
    monkeypatch.setattr(boxes, "FEW", 0)
    assert boxes.Page(ws).places({"aa", "aab", "zz"}) == short and short["aa"] == [0, 1, 2, 3, 9]
    assert boxes.find(ws, values) == plain


def test_many_documents_come_to_one_call(spark):
    """A document is one row with its words, and no group of its own."""
    docs = {f"d{k}": [(10, 10, 20, 18, f"no{k}"), (25, 10, 30, 18, "x")] for k in range(1200)}
    asked = spark.createDataFrame([(d, "v", "no" + d[1:]) for d in docs], "doc_id string, id string, text string")
    found = boxes.locate(words(spark, docs), asked)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.how, r.x0) for r in found.collect()} == {(d, "exact", 10.0) for d in docs}
