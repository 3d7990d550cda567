"""Operator 4: secret scans with a trigram inverted index.

Each rule's regex is read into a Boolean query of trigrams that every match must contain.  A slice of documents
gets an index, from trigram to posting (a bit for each document); a rule's query is evaluated on the postings, and
its regex is run over the candidates alone.  A rule without mandatory trigrams scans every document.

Defined cases: a null text is empty and has no spans; offsets are code points, ends exclusive; matches of a kind are
leftmost and do not overlap, those of different kinds may; repeated rows get a row each; further columns are not
carried.  An index covers one slice of a partition, so it grows neither with a key nor with the table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyframe.llm.common import raw, sliced


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: This group of a match must have so many characters at least.
    group: int = 0
    least: int = 0
    query: object = field(default=None, compare=False)


# fixed values: the base kinds, in their order
BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# fixed values: formats that issuers publish
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("repository_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    # of a longer scheme the last 21 characters count, which keeps the search linear; name, password and host are of any length
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@[^\s/@]+"),
)
RULES = BASE + MORE

#: Alternatives that are followed one by one; beyond, a part of a regex counts as unknown.
_EXACT = 64


class Query:
    """ANY matches all texts; otherwise ("and" | "or", parts), a part being a trigram or a query."""

    ANY = ("any", ())

    @staticmethod
    def all_of(parts: list) -> tuple:
        parts = list(dict.fromkeys(p for p in parts if p != Query.ANY))
        return Query.ANY if not parts else parts[0] if len(parts) == 1 and isinstance(parts[0], tuple) else ("and", tuple(parts))

    @staticmethod
    def any_of(parts: list) -> tuple:
        parts = list(dict.fromkeys(parts))
        return Query.ANY if not parts or Query.ANY in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))

    @staticmethod
    def of_string(s: str) -> tuple:
        data = s.encode()
        return Query.all_of([data[i : i + 3] for i in range(len(data) - 2)])

    @staticmethod
    def of_strings(strings: set[str]) -> tuple:
        return Query.any_of([Query.of_string(s) for s in sorted(strings)])


def _expand(op, arg) -> set[str] | None:
    """The strings that an item matches, lower case; None for too many, or for others than ASCII.

    A rule that ignores case must do so for ASCII alone, as (?ai:...)."""
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN and all(x[0] is C.LITERAL for x in arg):
        return {chr(x[1]).lower() for x in arg} if all(x[1] < 128 for x in arg) else None
    if op is C.IN and all(x[0] in (C.LITERAL, C.RANGE) for x in arg) and sum(x[1][1] - x[1][0] + 1 if x[0] is C.RANGE else 1 for x in arg) <= 10:
        return {chr(i).lower() for x in arg for i in (range(x[1][0], x[1][1] + 1) if x[0] is C.RANGE else [x[1]])}
    return None


def trigram_query(pattern: str) -> tuple:
    """What the trigrams of a lower-cased text must satisfy for the pattern to match in it."""
    return _sequence(_parser.parse(pattern))[1]


def _sequence(items) -> tuple[set[str] | None, tuple]:
    """All strings of a sequence if they are few, and its query."""
    run, parts, whole = {""}, [], True

    def flush() -> None:
        parts.append(Query.of_strings(run))

    for op, arg in items:
        strings, query = _item(op, arg)
        if strings is not None and len(strings) * len(run) <= _EXACT:
            run = {a + b for a in run for b in strings}
        else:
            flush()
            parts.append(query)
            run, whole = strings if strings is not None else {""}, False
    flush()
    return run if whole else None, Query.all_of(parts)


def _item(op, arg) -> tuple[set[str] | None, tuple]:
    if (strings := _expand(op, arg)) is not None:
        return strings, Query.ANY if len(next(iter(strings), "")) < 3 else Query.of_strings(strings)
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        known = [s for s, _ in each if s is not None]
        return (set().union(*known) if len(known) == len(each) and sum(map(len, known)) <= _EXACT else None), Query.any_of([q for _, q in each])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", C.MAX_REPEAT)):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if high == 1 and strings is not None:
            return strings | {""}, Query.ANY
        return None, query if low else Query.ANY
    if op is C.AT:
        return {""}, Query.ANY
    return None, Query.ANY


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class TrigramIndex:
    """Postings of the wanted trigrams over a slice of documents; letters A-Z count as a-z."""

    def __init__(self, wanted: list[bytes]):
        self.at = {t: i + 1 for i, t in enumerate(wanted)}
        self.slot = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.at.items():
            self.slot[int.from_bytes(t, "big")] = i

    def build(self, texts: list[bytes]) -> None:
        self.n = len(texts)
        data = _LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)].astype(np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, self.n))
        self.postings = np.zeros((len(self.at) + 1, self.n), dtype=bool)
        if len(data) < 3:
            return
        found = self.slot[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        where = np.flatnonzero(found)
        doc = np.searchsorted(ends, where, "right")
        inside = where + 3 <= ends[doc]
        self.postings[found[where[inside]], doc[inside]] = True

    def candidates(self, query: tuple | bytes) -> np.ndarray:
        if isinstance(query, bytes):
            return self.postings[self.at[query]]
        kind, parts = query
        if kind == "any":
            return np.ones(self.n, dtype=bool)
        return (np.logical_and if kind == "and" else np.logical_or).reduce([self.candidates(p) for p in parts])


def _trigrams(query: tuple | bytes) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _verifier(rule: Rule) -> re.Pattern:
    """The rule's regex.  Where it is one class repeated, only long enough runs are asked for; they are whole runs either way."""
    parts = list(_parser.parse(rule.pattern))
    if rule.least > 1 and len(parts) == 1 and parts[0][0] is C.MAX_REPEAT and parts[0][1][:2] == (1, C.MAXREPEAT) and [x[0] for x in parts[0][1][2]] == [C.IN]:
        return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}")
    return re.compile(rule.pattern)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, _verifier(r), trigram_query(r.pattern)) for r in rules]
        self.index = TrigramIndex(sorted(set().union(*(_trigrams(q) for _, _, q in self.rules))))

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """By start, then in the order of the rules."""
        self.index.build([t.encode() for t in texts])
        found: list[list] = [[] for _ in texts]
        for order, (rule, pattern, query) in enumerate(self.rules):
            for i in np.flatnonzero(self.index.candidates(query)):
                for m in pattern.finditer(texts[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[i].append((m.start(), order, rule.kind, m.end()))
        return [[(kind, a, b) for a, _, kind, b in sorted(x)] for x in found]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Per document: id, found (array of kind, start, end), n_<kind> and a digest of the base kinds, and all spans as a string."""
    kinds = [r.kind for r in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(tuple(rules))
        for batch in sliced(batches, "text"):
            found = scanner.spans([t or "" for t in batch.column(1).to_pylist()])
            own = [[s for s in x if s[0] in kinds] for x in found]
            arrays = [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], type=pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]
            arrays += [pa.array([sum(s[0] == k for s in x) for x in own], pa.int64()) for k in kinds]
            arrays += [pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in own]), pa.array([joined(x) for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "found", *[f"n_{k}" for k in kinds], "base_sha256", "spans"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, found {SPANS.simpleString()}, {', '.join(f'n_{k} bigint' for k in kinds)}, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """The documents, with their own columns, every span replaced by the mask; overlapping spans become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(tuple(rules))
        for batch in sliced(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            clean = []
            for text, found in zip(texts, scanner.spans([t or "" for t in texts]), strict=True):
                kept, last = [], 0
                for _, a, b in found:
                    if a >= last:
                        kept += [text[last:a], mask]
                    last = max(last, b)
                clean.append(text if not found else "".join([*kept, text[last:]]))
            yield pa.RecordBatch.from_arrays([pa.array(clean, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
