"""Operator 2: line dedup over overlapping three-line windows, with DataFrame functions alone.

Windows of three consecutive lines that hold more than white space are hashed; of every hash the first place, by
id, text and line, is found; the lines of later places are merged and removed.

Defined cases: a null text stays null; a text of fewer lines than a window loses nothing; an empty text stays empty;
lines that are blank form no window, and those inside a removed one go with it; a later window that overlaps the
first one of its kind in the same document loses only the lines beyond it, so the first copy stays whole; rows that
repeat an id with unlike texts are documents of their own, ordered by a hash of the text; rows that repeat id and text are
one document seen again, and lose the same lines; rows with a null id are neither read for
windows nor changed; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import checkpointed, unused

WIDTH = 3
#: Documents that lose lines, and lines to remove, that are broadcast at most; the texts are dealt by a shuffle where there are more.
ROWS, LINES = 1_000_000, 8_000_000


def _windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, of, start, end, h1, h2): every window, by its document (id and a hash of the text), the places of its first and last line and 96 bits of hash."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].rlike(r"[^\x20\x09-\x0D]"))
    numbered = docs.where(F.col(id_col).isNotNull() & F.contains(F.col(text_col), F.lit("\n"))).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of"), lines.alias("l"))
    line = [f"l[k + {j}].x" for j in range(width)]
    window = f"""explode(transform(sequence(0, size(l) - {width}), k -> struct(
        l[k].i AS start, l[k + {width - 1}].i AS end,
        xxhash64({", ".join(line)}) AS h1, cast(shiftright(xxhash64({", ".join(reversed(line))}), 32) AS int) AS h2)))"""
    return numbered.where(F.size("l") >= width).select("id", "of", F.expr(window).alias("w")).select("id", "of", "w.*")


def covered_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, of, lines): the places of the lines to remove, for documents that have some; of is the text's xxhash64."""
    windows = _windows(docs, id_col, text_col, width)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "of", "start", "end")).alias("f"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "f")
    later = windows.join(first, ["h1", "h2"]).where("struct(id, of, start) > struct(f.id, f.of, f.start)")
    same = (F.col("id") == F.col("f.id")) & (F.col("of") == F.col("f.of"))
    places = later.select("id", "of", F.sequence(F.when(same, F.greatest("start", F.col("f.end") + 1)).otherwise(F.col("start")), "end").alias("lines"))
    return places.groupBy("id", "of").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


def deduplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, counts: bool = False) -> DataFrame:
    """The documents with their own columns, without later copies; with counts=True also _n_lines and _n_removed."""
    key, of, places = unused(docs, "_id", "_of", "_lines")
    gone = covered_lines(docs, id_col=id_col, text_col=text_col, width=width).withColumnsRenamed({"id": key, "of": of, "lines": places})
    gone = checkpointed(gone)
    rows, lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size(places)), F.lit(0))).first()
    # dealt by id and text, unsorted, where the lines to remove are too many to broadcast; null ids then lie over all tasks
    gone = F.broadcast(gone) if rows <= ROWS and lines <= LINES else gone.hint("shuffle_hash")
    both = docs.join(gone, (docs[id_col] == gone[key]) & (F.xxhash64(docs[text_col]) == gone[of]), "left")
    split = F.split(text_col, "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), places), lambda i: F.get(split, i))
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    out = [text.alias(c) if c == text_col else docs[c] for c in docs.columns]
    if counts:
        n = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(F.regexp_replace(text_col, "[^\n]+", "")) + 1)
        out += [n.cast("long").alias("_n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("long").alias("_n_removed")]
    return both.select(out)
