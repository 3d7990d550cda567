"""Edits folded into documents."""

import json

import pytest

from tallyframe.operators import edits


def item(d, a, **more):
    return {"description": d, "quantity": None, "unit_price": None, "amount": a, "subs": [], **more}


def invoice(**more):
    return {"fields": {"invoice_no": "I-1", "invoice_date": "2026-01-01", "subtotal": "100", "sales_tax": "5", "total_due": "105"}, "items": [item("a", "60"), item("b", "40")], **more}


def go(state, *commands):
    d = edits.Document(json.loads(json.dumps(state)))
    log = [edits.run(d, {"seq": i, "at": None, "sub": None, "field": None, "value": None, **c}) for i, c in enumerate(commands)]
    return d.state, log


def test_fields():
    s, log = go(invoice(), {"kind": "change_field", "field": "total_due", "value": "HK$1,250.50"}, {"kind": "change_field", "field": "invoice_date", "value": "28 December 2025"}, {"kind": "change_field", "field": "currency", "value": "us$" .upper()},
                {"kind": "change_field", "field": "tax_rate", "value": "5"}, {"kind": "change_field", "field": "issuer_name", "value": "  "}, {"kind": "change_field", "field": "subtotal", "value": "abc"}, {"kind": "change_field", "field": "note", "value": "x", "reason": "box:0,1,2,3,4"}, {"kind": "clear_box", "field": "note"}, {"kind": "clear_box", "field": "note"})
    assert s["fields"] == {"invoice_no": "I-1", "invoice_date": "2025-12-28", "subtotal": "100", "sales_tax": "5", "total_due": "1250.50", "currency": "USD", "tax_rate": "5%", "issuer_name": None, "note": "x"}
    assert [bool(r["refused"]) for r in log] == [False] * 5 + [True, False, False, True] and s["rev"] == 7 and (log[0]["old"], log[0]["new"]) == ("105", "1250.50")


def test_items_and_parts():
    s, log = go(invoice(), {"kind": "split_item", "at": 0, "pieces": ["x", " y ", ""]}, {"kind": "add_item", "value": "new", "field": "7.00"}, {"kind": "delete_item", "at": 2}, {"kind": "change_item", "at": 1, "field": "amount", "value": "$3.5"},
                {"kind": "add_sub", "at": 0}, {"kind": "change_sub", "at": 0, "sub": 0, "field": "date", "value": "2 Jan 2026"}, {"kind": "change_sub", "at": 0, "sub": 9, "field": "date", "value": "x"}, {"kind": "delete_sub", "at": 0, "sub": 0}, {"kind": "split_item", "at": 0, "pieces": ["one"]}, {"kind": "delete_item", "at": 5}, {"kind": "change_item", "at": 0, "field": "colour", "value": "red"})
    assert [(i["description"], i["amount"]) for i in s["items"]] == [("x", "60"), ("y", "3.5"), ("new", "7.00")] and s["items"][0]["subs"] == []
    assert [r["refused"] is not None for r in log] == [False] * 6 + [True, False, True, True, True] and log[2]["old"] == "b / 40" and log[5]["new"] == "2026-01-02"


def test_locks_and_revisions():
    s, log = go(invoice(locked=True), {"kind": "change_field", "field": "note", "value": "x"}, {"kind": "delete"}, {"kind": "act", "value": "Hold"})
    assert [r["refused"] for r in log] == ["part of a confirmed match"] * 2 + [None] and s["status"] == "Hold"
    rows = [dict.fromkeys(("date", "description", "income", "expense", "balance")) for _ in range(3)]
    s, log = go({"kind": "statement", "rows": rows, "locked": True, "locked_rows": [1]}, {"kind": "change_row", "at": 1, "field": "income", "value": "5"}, {"kind": "change_row", "at": 0, "field": "income", "value": "5"}, {"kind": "delete_row", "at": 0}, {"kind": "change_field", "field": "bank_name", "value": "B"})
    assert [bool(r["refused"]) for r in log] == [True, False, True, False]
    s, log = go(invoice(), {"kind": "change_field", "field": "a", "value": "1", "base": 0}, {"kind": "change_field", "field": "a", "value": "2", "base": 0}, {"kind": "change_field", "field": "a", "value": "3", "base": 1}, {"kind": "nonsense"})
    assert s["fields"]["a"] == "3" and log[1]["refused"] == "made on revision 0, the document is at 1" and log[3]["refused"]


def test_actions():
    ok = {"kind": "act", "value": "Approved"}
    assert go(invoice(), ok)[0]["status"] == "Approved"
    assert go(invoice(fields={"invoice_no": "1"}), ok)[1][0]["refused"] == "missing: invoice_date, total_due"
    wrong = invoice()
    wrong["fields"]["total_due"] = "106"
    assert go(wrong, ok)[1][0]["refused"] == "sums differ: total" and go(wrong, {**ok, "reason": "rounded"})[0]["status"] == "Approved"
    assert go(invoice(items=[item("a", "1")]), ok)[1][0]["refused"] == "sums differ: items"
    assert go(invoice(approved_copy=True), ok)[1][0]["refused"] and go(invoice(approved_copy=True), {**ok, "force": True})[0]["status"] == "Approved"
    assert go(invoice(), {"kind": "act", "value": "Rejected"})[1][0]["refused"] and go(invoice(), {"kind": "act", "value": "Rejected", "reason": "no"})[0]["status"] == "Rejected"
    s, log = go(invoice(), {"kind": "delete"}, {"kind": "act", "value": "Hold"})
    assert s["deleted"] and log[1]["refused"] == "the document is deleted" and go(invoice(), ok, {"kind": "delete"})[1][1]["refused"]


@pytest.fixture
def log_of(spark):
    docs = spark.createDataFrame([(i, {"invoice_no": f"I-{i}"}, "Pending") for i in range(20)], "doc_id int, fields map<string,string>, status string")
    rows = [(i, s, "change_field", "note", f"{i}/{s}", None) for i in range(20) for s in range(50)] + [(3, 100, "act", None, "Rejected", "why"), (99, 1, "act", None, "Hold", None), (None, 1, "act", None, "Hold", None)]
    return docs, spark.createDataFrame(rows, "doc_id int, seq int, kind string, field string, value string, reason string")


def test_fold(log_of):
    states, log = edits.fold(*log_of)
    got = {r.doc_id: r for r in states.collect()}
    assert len(got) == 20 and all(r.fields["note"] == f"{i}/49" and r.rev == 50 + (i == 3) and r.status == ("Rejected" if i == 3 else "Pending") and not r.deleted for i, r in got.items())
    lines = log.collect()
    assert len(lines) == 1003 and sorted(str(r.doc_id) for r in lines if r.refused) == ["99", "None"]
    one = sorted((r.seq, r.old, r.new, r.rev) for r in lines if r.doc_id == 7)
    assert one[1] == (1, "7/0", "7/1", 2)


def test_nothing_to_fold(spark, log_of):
    docs, commands = log_of
    states, log = edits.fold(docs.where("doc_id < 0"), commands.where("doc_id < 0"))
    assert states.count() == log.count() == 0
    assert edits.fold(docs, commands.where("doc_id < 0"))[0].count() == 20


def test_stream(spark, tmp_path):
    schema = "doc_id string, seq bigint, body string"
    send = lambda n, rows: spark.createDataFrame([(d, s, json.dumps(b)) for d, s, b in rows], schema).coalesce(1).write.json(str(tmp_path / "in" / str(n)))
    change = lambda v: {"kind": "change_field", "field": "note", "value": v}
    send(1, [("a", 2, change("x")), ("a", 1, {"kind": "open", "value": json.dumps(invoice())}), ("b", 1, change("y"))])
    got = []
    for n in (1, 2):
        if n == 2:
            send(2, [("a", 3, change("z"))])
        log = edits.live(spark.readStream.schema(schema).json(str(tmp_path / "in" / "*")))
        q = log.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
        q.awaitTermination(120)
    assert sorted((r.doc_id, r.seq, r.old, r.new, r.refused, r.rev) for r in got) == [("a", 1, None, "open", None, 0), ("a", 2, None, "x", None, 1), ("a", 3, "x", "z", None, 2), ("b", 1, None, None, "no such document", None)]


def test_match_states_by_ranges(spark):
    import random

    from tallyframe.operators import lifecycle

    rng = random.Random(8)
    events = [(m, i, rng.choice(["propose"] * (i == 0) or [*lifecycle.ACTIONS, "nonsense"])) for m, n in ((1, 900), (2, 1), (3, 40), (None, 5)) for i in range(n)]
    want = {}
    for m, _, action in sorted(events, key=lambda e: (str(e[0]), e[1])):
        need, gives = lifecycle.ACTIONS.get(action, (None, None))
        state, n = want.get(m, ("", 0))
        want[m] = (gives if state == need else state, n + 1)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = lifecycle.match_states(spark.createDataFrame(rng.sample(events, len(events)), "match_id int, seq int, action string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.match_id: (r.state, r.n_actions) for r in out} == want
