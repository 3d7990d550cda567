"""Operator 3: chat formatting.

A transcript is the rows of a conversation in the order of their turns.  Each row is cut into utterances at lines
that begin with a speaker marker; the row's own role, if it is a known name, marks the first.  A hidden Markov model
has the roles as states; an utterance shows a marker (or none) and features of its lines.  Transitions and features
are counted over the marked utterances of the whole table; Viterbi recovers all roles, and each utterance is
rendered as a canonical turn.

A conversation may be longer than a partition: utterances are dealt by ranges of (conversation, turn), so such a one
lies in several neighbouring partitions.  Each partition sends what its first and last conversation amount to as
max-plus matrices; chaining these (a few per partition) fixes the states at the seams, and every partition then
decodes on its own.  Nobody holds a whole long conversation.

Defined cases: a null text is an empty utterance; a row of blank lines and markers keeps an utterance for each
marker; rows of a null conversation form one conversation; null turns come first; rows that tie in turn are
ordered by a hash of role and text, and the utterances of a row stay together, so equal rows of several utterances
follow each other whole; of paths that are equally likely one is taken, the same each time; utterances of one speaker in a row are
separate turns; an empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import checkpointed, sliced

ROLES = ("system", "user", "assistant", "tool")
# fixed values: names of speakers in common chat formats
ALIASES = {
    "system": ("system", "instructions", "developer"),
    "user": ("user", "human", "prompter", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "gpt", "chatgpt", "model", "agent", "answer", "a"),
    "tool": ("tool", "function", "observation", "ipython"),
}
_ROLE = {name: k for k, role in enumerate(ROLES) for name in ALIASES[role]}
_LONG = "|".join(sorted((n for n in _ROLE if len(n) > 1), key=len, reverse=True))
#: `User:`, `### Human:`, `**Assistant**:`, `<|user|>`, `[system]`; one-letter names as capitals with a colon alone.
_MARKER = re.compile(rf"[ \t]*(?:(?:#{{1,4}}[ \t]*|\*\*)?(?P<plain>(?i:{_LONG})|[QA])(?:\*\*)?[ \t]*:(?:\*\*)?|<\|(?:im_start\|>)?(?P<bar>(?i:{_LONG}))(?:\|>)?|\[(?P<square>(?i:{_LONG}))\])[ \t]*")
UNMARKED = -1

#: A wrong marker is this likely.
SLIP = 1e-3
#: Counts that are taken for granted: who speaks after whom, and who begins.
_BEFORE = np.array([[0.2, 8, 1, 0.2], [0.1, 1, 8, 0.5], [0.1, 8, 1, 1], [0.1, 1, 8, 0.5]])
_BEGINS = np.array([4.0, 8.0, 1.0, 0.1])
N_FEATURES = 6 * 4 * 2 * 2
PARTITION_BYTES = 64 << 20


def utterances(role: str | None, text: str | None) -> list[tuple[int, str]]:
    """(marker or UNMARKED, text) of a row's utterances."""
    marker = _ROLE.get((role or "").strip().lower(), UNMARKED)
    out: list[tuple[int, list[str]]] = [(marker, [])]
    for line in (text or "").split("\n"):
        m = _MARKER.match(line)
        if m is None:
            out[-1][1].append(line)
            continue
        name = m["plain"] or m["bar"] or m["square"]
        found = (_ROLE[name.lower()], [line[m.end() :]])
        if len(out) == 1 and not any(x.strip() for x in out[0][1]):
            out[0] = found  # the row begins with a marker of its own
        else:
            out.append(found)
    return [(k, "\n".join(lines).strip("\n")) for k, lines in out]


def feature(text: str) -> int:
    """A code for the lines: how many words, how many lines, whether they ask, whether they list or quote code."""
    lines = [x for x in text.split("\n") if x.strip()]
    words = min(5, int(math.log2(len(text.split()) + 1) / 1.5))
    asks = any(x.rstrip().endswith("?") for x in lines)
    lists = any(x.lstrip().startswith(("- ", "* ", "```", "1.", "#")) for x in lines)
    return ((words * 4 + min(3, len(lines))) * 2 + asks) * 2 + lists


class Model:
    """Log chances of the states: at the beginning, after a state, and of what an utterance shows."""

    def __init__(self, after: np.ndarray, begins: np.ndarray, shown: np.ndarray):
        share = lambda n: np.log(n / n.sum(axis=-1, keepdims=True))
        self.after, self.begin = share(after + _BEFORE), share(begins + _BEGINS)
        self.shown = share(shown + 0.5)  # roles by features
        wrong = math.log(SLIP / (len(ROLES) - 1))
        self.marker = np.full((len(ROLES) + 1, len(ROLES)), wrong)
        np.fill_diagonal(self.marker, math.log(1 - SLIP))
        self.marker[UNMARKED] = 0.0

    def emission(self, markers: np.ndarray, features: np.ndarray) -> np.ndarray:
        return self.marker[markers] + self.shown[:, features].T

    def matrix(self, emission: np.ndarray) -> np.ndarray:
        """Best score from each state before to each state at the end of a stretch."""
        best = np.full((len(ROLES), len(ROLES)), -np.inf)
        np.fill_diagonal(best, 0.0)
        for e in emission:
            best = (best[:, :, None] + self.after[None]).max(axis=1) + e
        return best

    def decode(self, emission: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
        """States of a stretch, with the state before it and the last one as given (None: a beginning, any)."""
        n = len(emission)
        back = np.zeros((n, len(ROLES)), dtype=np.int64)
        score = (self.begin if before is None else self.after[before]) + emission[0]
        for t in range(1, n):
            step = score[:, None] + self.after
            back[t] = step.argmax(axis=0)
            score = step[back[t], np.arange(len(ROLES))] + emission[t]
        states = np.empty(n, dtype=np.int64)
        states[-1] = int(score.argmax()) if last is None else last
        for t in range(n - 1, 0, -1):
            states[t - 1] = back[t, states[t]]
        return states


def _parsed(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, trust_roles: bool = True) -> DataFrame:
    """Utterances, dealt by ranges of their order and kept; `shown` is the marker that decoding may see."""
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = []
            for i, (role, text) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                found = utterances(role, text)
                shown = found if trust_roles else utterances(None, text)
                out += [(i, k, marker, seen, feature(said), said) for k, ((marker, said), (seen, _)) in enumerate(zip(found, shown, strict=True))]
            row, *numbers, said = zip(*out, strict=True)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(4)), *(pa.array(x, pa.int32()) for x in numbers), pa.array(said, pa.string())], names=["conv", "turn", "tie", "row", "part", "marker", "shown", "feature", "said"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    # the number of a row keeps its utterances together among equal rows, and parts such rows over ranges
    tied = rows.select("conv", "turn", F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("row"), "role", "text")
    cut = tied.mapInArrow(run, f"conv {kinds['conv']}, turn {kinds['turn']}, tie bigint, row bigint, part int, marker int, shown int, feature int, said string")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PARTITION_BYTES))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "tie", "row", "part")]
    return checkpointed(cut.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("pid", F.spark_partition_id())


def _stretches(batches: Iterator[pa.RecordBatch], marker: str, also: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(pid, first in the partition, last, conversation, markers, features, other columns) of each conversation in order."""
    names = (marker, "feature", *also)
    held: tuple | None = None
    begun = True
    for batch in batches:
        columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("pid", "conv", *names)}
        start = 0
        for end in range(1, batch.num_rows + 1):
            if end < batch.num_rows and columns["conv"][end] == columns["conv"][start]:
                continue
            part = [columns[n][start:end] for n in names]
            if held is not None and held[1] == columns["conv"][start]:
                for a, b in zip(held[2], part, strict=True):
                    a.extend(b)
            else:
                if held is not None:
                    yield held[0], begun, False, held[1], *map(np.array, held[2][:2]), held[2][2:]
                    begun = False
                held = (columns["pid"][start], columns["conv"][start], part)
            start = end
    if held is not None:
        yield held[0], begun, True, held[1], *map(np.array, held[2][:2]), held[2][2:]


def _learn(dealt: DataFrame) -> Model:
    """Counts over all marked utterances; pairs that a seam parts are added from the seams' own rows."""
    k = len(ROLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        for pid, first, last, conv, markers, features, _ in _stretches(batches, "marker"):
            for a, b in zip(markers[:-1].tolist(), markers[1:].tolist(), strict=True):
                if a >= 0 and b >= 0:
                    counts["after", a * k + b, -1] = counts.get(("after", a * k + b, -1), 0) + 1
            for m, f in zip(markers.tolist(), features.tolist(), strict=True):
                if m >= 0:
                    counts["shown", m * N_FEATURES + f, -1] = counts.get(("shown", m * N_FEATURES + f, -1), 0) + 1
            head = markers[0]
            if first or last:  # who comes before is known from the other rows of this kind alone
                name = "null" if conv is None else f"={conv}"
                yield _row("seam", int(head), int(markers[-1]), pid, int(first), name)
            elif head >= 0:
                counts["begins", int(head), -1] = counts.get(("begins", int(head), -1), 0) + 1
        for (kind, at, _), n in counts.items():
            yield _row(kind, at, n, -1, 0, "")

    found = dealt.select("pid", "conv", "marker", "feature").mapInArrow(run, "kind string, at bigint, n bigint, pid int, first int, conv string")
    after, begins, shown = np.zeros(k * k), np.zeros(k), np.zeros(k * N_FEATURES)
    tables = {"after": after, "begins": begins, "shown": shown}
    sums = found.groupBy("kind", "at", "pid", "first", "conv").agg(F.sum("n").alias("n")).collect()  # cells of the model, and two rows per partition
    seams = []
    for r in sums:
        if r["kind"] == "seam":
            seams.append((r["pid"], 1 - r["first"], r["conv"], r["at"], r["n"]))
        else:
            tables[r["kind"]][r["at"]] += r["n"]
    before = (None, None)
    for _, _, conv, head, tail in sorted(seams):
        if before[0] == conv:
            if before[1] >= 0 and head >= 0:
                after[before[1] * k + head] += 1
        elif head >= 0:
            begins[head] += 1
        before = (conv, tail)
    return Model(after.reshape(k, k), begins, shown.reshape(k, N_FEATURES))


def _row(kind: str, at: int, n: int, pid: int, first: int, conv: str) -> pa.RecordBatch:
    values = zip((kind, at, n, pid, first, conv), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["kind", "at", "n", "pid", "first", "conv"])


def _seams(dealt: DataFrame, model: Model) -> dict[tuple[int, bool], tuple[int | None, int | None, int]]:
    """Of the first (True) and last stretch of each partition: the state before it, its last state, and the turns before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pid, first, last, conv, markers, features, _ in _stretches(batches, "shown"):
            if first or last:
                emission = model.emission(markers, features)
                start = model.begin + emission[0]
                for e in emission[1:]:
                    start = (start[:, None] + model.after).max(axis=0) + e
                values = [pid, first, last, "null" if conv is None else f"={conv}", len(markers), model.matrix(emission).ravel().tolist(), start.tolist()]
                kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["pid", "first", "last", "conv", "n", "m", "start"])

    rows = dealt.select("pid", "conv", "shown", "feature").mapInArrow(run, "pid int, first boolean, last boolean, conv string, n bigint, m array<double>, start array<double>").collect()  # two per partition
    rows.sort(key=lambda r: (r["pid"], not r["first"]))
    out = {}
    chain: list = []

    def close() -> None:
        scores = [np.array(chain[0]["start"])]
        for r in chain[1:]:
            scores.append((scores[-1][:, None] + np.array(r["m"]).reshape(len(ROLES), -1)).max(axis=0))
        ends = [int(scores[-1].argmax())]
        for r, score in zip(reversed(chain[1:]), reversed(scores[:-1]), strict=True):
            ends.insert(0, int((score + np.array(r["m"]).reshape(len(ROLES), -1)[:, ends[0]]).argmax()))
        passed = 0
        for i, r in enumerate(chain):
            out[r["pid"], r["first"]] = (ends[i - 1] if i else None, ends[i], passed)
            passed += r["n"]

    for r in rows:
        if chain and chain[-1]["conv"] != r["conv"]:
            close()
            chain = []
        chain.append(r)
    if chain:
        close()
    return out


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def format_chats(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trust_roles: bool = True) -> DataFrame:
    """(conversation, turn_no, role, marked, text, rendered): a row per utterance, numbered from 0 in each conversation.

    The model is counted over all utterances that a marker or the role column names.  With trust_roles=False roles are then
    recovered without the role column, from markers in the text, lines and order alone; what was named is in `given`."""
    dealt = _parsed(conversations, conv_col, turn_col, role_col, text_col, trust_roles)
    model = _learn(dealt)
    sc = dealt.sparkSession.sparkContext
    shared = sc.broadcast((model, _seams(dealt, model)))  # the model, and two entries per partition
    kind = dealt.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seams = shared.value
        conv_type = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv").type
                yield batch

        held, size = [], 0
        for pid, first, last, conv, markers, features, (said, given) in _stretches(typed(), "shown", ("said", "marker")):
            before, end, passed = seams[pid, first] if first or last else (None, None, 0)
            states = model.decode(model.emission(markers, features), before, end)
            held += [(conv, passed + i, ROLES[s], bool(m >= 0), ROLES[g] if g >= 0 else None, t, render(ROLES[s], t)) for i, (s, m, g, t) in enumerate(zip(states.tolist(), markers.tolist(), given, said, strict=True))]
            size += sum(map(len, said))
            if size > 1 << 22:
                yield _turns(held, conv_type)
                held, size = [], 0
        if held:
            yield _turns(held, conv_type)

    turns = dealt.select("pid", "conv", "marker", "shown", "feature", "said").mapInArrow(run, f"conv {kind}, turn_no bigint, role string, marked boolean, given string, text string, rendered string")
    return (turns.drop("given") if trust_roles else turns).withColumnRenamed("conv", conv_col)


def _turns(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    kinds = (conv_type, pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", "turn_no", "role", "marked", "given", "text", "rendered"])
