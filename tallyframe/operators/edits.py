"""Edits of a review as a log of commands: each document's commands are folded in order into its state, and every command leaves a line in the log.

A fold reads its rows sorted by document and number, and holds one document at a time; documents lie over all tasks, so a document with any number of commands costs
its task time and no memory.  A command names the revision that it was made on, and is refused if the document has moved on since; it is refused as well where a lock or
the document itself does not allow it.  A refused command changes nothing, and says why in the log."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from decimal import Decimal, InvalidOperation

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import checkpointed

AMOUNTS = {"subtotal", "sales_tax", "total_due", "opening_balance", "closing_balance"}
DATES = {"invoice_date", "payment_due_date", "period_start", "period_end"}
REQUIRED = ("invoice_no", "invoice_date", "total_due")
CENT = Decimal("0.01")
_SIGNS = {"US$": "USD", "HK$": "HKD", "S$": "SGD", "€": "EUR", "£": "GBP"}
_DAYS = ("%Y-%m-%d", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y", "%Y/%m/%d", "%d-%b-%Y", "%m/%d/%Y")

#: What a document is to the fold.
STATE = "kind string, fields map<string,string>, boxes map<string,string>, items array<struct<description: string, quantity: string, unit_price: string, amount: string, subs: array<struct<date: string, description: string, amount: string>>>>, rows array<struct<date: string, description: string, income: string, expense: string, balance: string>>, locked boolean, locked_rows array<int>, approved_copy boolean, category string, account string, status string, rev bigint"
COMMAND = "by string, kind string, at int, sub int, field string, value string, pieces array<string>, reason string, base bigint, force boolean"


class Refused(Exception):
    """Why a command was refused."""


def number(value: str | None, what: str) -> str | None:
    """An amount as people type it, without signs, codes and groups; an empty one is none."""
    if value is None or not value.strip():
        return None
    bare = re.sub(r"[A-Za-z$€£¥\s,']", "", value)
    if re.fullmatch(r"\(.*\)", bare):
        bare = "-" + bare[1:-1]
    try:
        return str(Decimal(bare))
    except InvalidOperation:
        raise Refused(f"{what} is no number") from None


def day(value: str) -> str:
    """ISO where the text is a date, else the text."""
    for form in _DAYS:
        try:
            return datetime.strptime(value.strip(), form).date().isoformat()
        except ValueError:
            continue
    return value.strip()


def field_value(field: str, value: str | None) -> str | None:
    if value is None or not value.strip():
        return None
    if field in AMOUNTS:
        return number(value, field)
    if field in DATES:
        return day(value)
    if field == "currency":
        return next((c for s, c in _SIGNS.items() if s in value), value.strip().upper())
    if field == "tax_rate":
        return value.strip() + "%" * bool(re.fullmatch(r"\d+(?:\.\d+)?", value.strip()))
    return value.strip()


class Document:
    """A document's state, and what commands do to it; each returns what was there before and what is there now."""

    def __init__(self, state: dict):
        self.state = {"fields": {}, "boxes": {}, "items": [], "rows": [], "locked_rows": [], "status": "Pending", "rev": 0, "kind": "invoice", **{k: v for k, v in state.items() if v is not None}}

    def apply(self, c: dict) -> tuple[str | None, str | None]:
        if self.state.get("deleted"):
            raise Refused("the document is deleted")
        if c.get("base") is not None and c["base"] != self.state["rev"]:
            raise Refused(f"made on revision {c['base']}, the document is at {self.state['rev']}")
        do = getattr(self, f"do_{c['kind']}", None)
        if do is None:
            raise Refused(f"no such command: {c['kind']}")
        out = do(c)
        self.state["rev"] += 1
        return out

    def _open(self) -> None:
        if self.state.get("locked") and self.state["kind"] != "statement":
            raise Refused("part of a confirmed match")

    @staticmethod
    def _at(rows: list, at: int | None, what: str) -> dict:
        if at is None or not 0 <= at < len(rows):
            raise Refused(f"no such {what}: {at}")
        return rows[at]

    # fields

    def do_change_field(self, c: dict):
        self._open()
        old = self.state["fields"].get(c["field"])
        now = field_value(c["field"], c["value"])
        self.state["fields"][c["field"]] = now
        if c.get("reason", "") and str(c["reason"]).startswith("box:"):
            self.state["boxes"][c["field"]] = c["reason"][4:]
        return old, now

    def do_clear_box(self, c: dict):
        if c["field"] not in self.state["boxes"]:
            raise Refused("no box to clear")
        return self.state["boxes"].pop(c["field"]), None

    def do_classify(self, c: dict):
        self._open()
        old = self.state.get("category")
        self.state["category"], self.state["account"] = c["value"], c["field"]
        return old, c["value"]

    # items, and what adds up to an item

    def _changed(self, row: dict, c: dict, numbers: set, texts: set, what: str):
        if c["field"] not in numbers | texts:
            raise Refused(f"no such column of an {what}: {c['field']}")
        old = row.get(c["field"])
        value = number(c["value"], c["field"]) if c["field"] in numbers else (c["value"] or "").strip() or None
        row[c["field"]] = day(value) if c["field"] == "date" and value else value
        return old, row[c["field"]]

    def do_change_item(self, c: dict):
        self._open()
        return self._changed(self._at(self.state["items"], c["at"], "item"), c, {"quantity", "unit_price", "amount"}, {"description"}, "item")

    def do_add_item(self, c: dict):
        self._open()
        try:
            amount = number(c["field"], "amount")  # field: the amount that comes with it
        except Refused:
            amount = None
        self.state["items"].append({"description": (c["value"] or "").strip() or None, "amount": amount, "subs": []})
        return None, f"item {len(self.state['items']) - 1}"

    def do_delete_item(self, c: dict):
        self._open()
        gone = self._at(self.state["items"], c["at"], "item")
        del self.state["items"][c["at"]]
        return f"{gone.get('description')} / {gone.get('amount')}", None

    def do_split_item(self, c: dict):
        self._open()
        first = self._at(self.state["items"], c["at"], "item")
        parts = [p.strip() for p in c.get("pieces") or [] if p and p.strip()]
        if len(parts) < 2:
            raise Refused("a split needs two parts at least")
        old = first.get("description")
        new = [{**first, "description": parts[0]}] + [{"description": p, "amount": None, "subs": []} for p in parts[1:]]
        self.state["items"][c["at"] : c["at"] + 1] = new
        return old, f"{len(parts)} parts"

    def _subs(self, c: dict) -> list:
        self._open()
        item = self._at(self.state["items"], c["at"], "item")
        item["subs"] = list(item.get("subs") or [])
        return item["subs"]

    def do_change_sub(self, c: dict):
        return self._changed(self._at(self._subs(c), c["sub"], "part"), c, {"amount"}, {"date", "description"}, "part")

    def do_add_sub(self, c: dict):
        subs = self._subs(c)
        subs.append({"date": None, "description": None, "amount": None})
        return None, f"part {len(subs) - 1}"

    def do_delete_sub(self, c: dict):
        subs = self._subs(c)
        gone = self._at(subs, c["sub"], "part")
        del subs[c["sub"]]
        return f"{gone.get('description')} / {gone.get('amount')}", None

    # rows of a statement: those that are matched or booked are locked, and hold the numbers of all rows

    def do_change_row(self, c: dict):
        if c["at"] in self.state["locked_rows"]:
            raise Refused("the row is matched or booked")
        return self._changed(self._at(self.state["rows"], c["at"], "row"), c, {"income", "expense", "balance"}, {"date", "description"}, "row")

    def _movable(self) -> list:
        if self.state["locked_rows"]:
            raise Refused("rows are matched or booked by their numbers")
        return self.state["rows"]

    def do_add_row(self, c: dict):
        rows = self._movable()
        rows.append(dict.fromkeys(("date", "description", "income", "expense", "balance")))
        return None, f"row {len(rows) - 1}"

    def do_delete_row(self, c: dict):
        rows = self._movable()
        gone = self._at(rows, c["at"], "row")
        del rows[c["at"]]
        return f"{gone.get('date')} / {gone.get('description')}", None

    # the document as a whole

    def sums_that_differ(self) -> list[str]:
        value = lambda k: Decimal(v) if (v := self.state["fields"].get(k)) else None
        sub, tax, total = value("subtotal"), value("sales_tax"), value("total_due")
        amounts = [Decimal(i["amount"]) for i in self.state["items"] if i.get("amount")]
        out = []
        if sub is not None and total is not None and abs(sub + (tax or 0) - total) > CENT:
            out.append("total")
        if sub is not None and amounts and len(amounts) == len(self.state["items"]) and abs(sum(amounts) - sub) > CENT:
            out.append("items")
        return out

    def do_act(self, c: dict):
        old, action, reason = self.state["status"], c["value"], (c.get("reason") or "").strip()
        if action not in ("Approved", "Rejected", "Hold"):
            raise Refused(f"no such action: {action}")
        if action == "Approved":
            missing = [f for f in REQUIRED if not self.state["fields"].get(f)]
            if missing:
                raise Refused("missing: " + ", ".join(missing))
            wrong = self.sums_that_differ()
            if wrong and not reason:
                raise Refused("sums differ: " + ", ".join(wrong))
            if self.state.get("approved_copy") and not c.get("force"):
                raise Refused("an approved document looks the same")
        if action == "Rejected" and not reason:
            raise Refused("a rejection needs a reason")
        self.state["status"] = action
        return old, action

    def do_delete(self, c: dict):
        self._open()
        if self.state["status"] == "Approved":
            raise Refused("an approved document stays")
        self.state["deleted"] = True
        return self.state["status"], "deleted"


def run(document: Document, command: dict) -> dict:
    """A line of the log."""
    line = {k: command.get(k) for k in ("seq", "by", "kind", "at", "sub", "field")}
    try:
        old, now = document.apply(command)
        return {**line, "old": old, "new": now, "refused": None, "rev": document.state["rev"]}
    except Refused as why:
        return {**line, "old": None, "new": None, "refused": str(why), "rev": document.state["rev"]}


_LINE = [("seq", pa.int64()), ("by", pa.string()), ("kind", pa.string()), ("at", pa.int32()), ("sub", pa.int32()), ("field", pa.string()), ("old", pa.string()), ("new", pa.string()), ("refused", pa.string()), ("rev", pa.int64())]
LOG = "seq bigint, by string, kind string, at int, sub int, field string, old string, new string, refused string, rev bigint"
_BATCH = 4096


def fold(documents: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents(doc_id, and columns of STATE), commands(doc_id, seq, and columns of COMMAND) -> states(doc_id, STATE, deleted), log(doc_id, LOG).

    Commands are taken in the order of seq, those of one number in the order of their kind and value.  Columns that are left out are null.  Commands of a document that is not there are refused,
    those with a null doc_id too."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = lambda ddl: T.StructType.fromDDL(ddl).names
    state = F.to_json(F.struct(*[c for c in names(STATE) if c in documents.columns]))
    told = [c for c in names(COMMAND) if c in commands.columns]
    both = documents.select("doc_id", F.lit(0).alias("_what"), F.lit(None).cast("bigint").alias("seq"), state.alias("body")).unionByName(
        commands.select("doc_id", F.lit(1).alias("_what"), F.col("seq").cast("bigint").alias("seq"), F.to_json(F.struct(*told)).alias("body")))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = None, None, []

        def batch() -> pa.RecordBatch:
            ids = pa.array([r[0] for r in out], type_of[0])
            rows = [ids, pa.array([r[1] for r in out], pa.string()), *(pa.array([(r[2] or {}).get(n) for r in out], t) for n, t in _LINE)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, names=["doc_id", "state", *(n for n, _ in _LINE)])

        type_of = [None]
        for b in batches:
            type_of[0] = b.schema.field("doc_id").type
            for doc_id, what, seq, body in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if what == 0:
                    if open_ is not None:
                        out.append((now, json.dumps(open_.state), None))
                    now, open_ = doc_id, Document(json.loads(body))
                    continue
                command = {"at": None, "sub": None, "field": None, "value": None, **json.loads(body), "seq": seq}
                if open_ is None or doc_id is None or doc_id != now:
                    out.append((doc_id, None, {**{n: command.get(n) for n, _ in _LINE}, "refused": "no such document", "rev": None}))
                else:
                    out.append((doc_id, None, run(open_, command)))
                if len(out) >= _BATCH:
                    yield batch()
        if open_ is not None:
            out.append((now, json.dumps(open_.state), None))
        if out:
            yield batch()

    dealt = both.repartition("doc_id").sortWithinPartitions("doc_id", "_what", "seq", "body")
    folded = checkpointed(dealt.mapInArrow(go, f"doc_id {kind}, state string, {LOG}"))
    read = F.from_json("state", STATE + ", deleted boolean")
    states = folded.where("state IS NOT NULL").select("doc_id", read.alias("s")).select("doc_id", "s.*").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return states, folded.where("state IS NULL").drop("state")


def live(commands: DataFrame) -> DataFrame:
    """The log of a stream of commands(doc_id string, seq, COMMAND columns as one JSON `body`), states kept from batch to batch.

    A document comes in with a command of kind `open`, whose value is its state as JSON.  Commands of one batch are taken in the order of seq."""

    def step(key, frames, state):
        document = Document(json.loads(state.get[0])) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, body in zip(rows["seq"], rows["body"], strict=True):
            c = {"at": None, "sub": None, "field": None, "value": None, **json.loads(body), "seq": int(seq)}
            line = {n: c.get(n) for n, _ in _LINE}
            if c["kind"] == "open":
                if document is None:
                    document = Document(json.loads(c["value"]))
                    out.append({**line, "old": None, "new": "open", "refused": None, "rev": document.state["rev"]})
                else:
                    out.append({**line, "refused": "the document is there already", "rev": document.state["rev"]})
            elif document is None:
                out.append({**line, "refused": "no such document", "rev": None})
            else:
                out.append(run(document, c))
        if document is not None:
            state.update((json.dumps(document.state),))
        frame = pd.DataFrame(out, columns=[n for n, _ in _LINE]).astype({"seq": "Int64", "at": "Int32", "sub": "Int32", "rev": "Int64"})
        frame.insert(0, "doc_id", key[0])
        yield frame

    return commands.groupBy("doc_id").applyInPandasWithState(step, f"doc_id string, {LOG}", "state string", "update", "NoTimeout")
