"""Operator 5: byte-level BPE encoding and decoding with a given table of ranks.

The distinct pieces of a slice of texts lie in numpy matrices, one for each length bucket, padded at the right.
In each round every row merges its leftmost pair of least rank: ranks come from a hash table of token pairs,
the merged cell is closed up by a shift, and rows without a pair left leave the matrix.

Defined cases: a null or empty text has no ids and decodes to no bytes; pieces that are tokens themselves get
that token at once; pieces of more than WIDEST bytes are merged with a heap, as rounds over a padded row would
cost the square of its length.  Strings of special tokens are ordinary text.  Repeated rows get a row each;
further columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyframe.llm.common import SLICE_BYTES, sliced

BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024, 2048, 4096)
WIDEST = BUCKETS[-1]
#: Distinct pieces whose ids a worker remembers; beyond, it forgets all.
REMEMBERED = 150_000
#: Bytes of text whose pieces and ids a worker holds as Python objects at once, some thirty times their size.
TEXT_BYTES = 1 << 20
_NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class PairTable:
    """(left, right) to the rank of the joined token: open addressing with linear probing, looked up in bulk."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, _NONE, dtype=np.int64)
        key = (left << 32) | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = key[free]  # of several for a slot the last stays
            placed = self.keys[slot[todo]] == key[todo]
            self.ranks[slot[todo[placed]]] = rank[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, _NONE where no token joins the two or one of them is padding."""
        shape, key = left.shape, ((left << 32) | right).ravel()
        out = np.full(key.shape, _NONE)
        todo = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        key = key[todo]
        slot = self._slot(key)
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there >= 0)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        triples = [(a, b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        self.pairs = PairTable(*np.array(triples, dtype=np.int64).reshape(-1, 3).T)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, str, bytes]] = {}

    @staticmethod
    @lru_cache(2)
    def shared(path: str, pattern: str) -> Codec:
        """One for each worker process."""
        return Codec(read_ranks(path), pattern)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of 2 to `width` bytes."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        cells = np.full((n, width), -1, dtype=np.int64)
        cells[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = self.pairs(cells[:, :-1], cells[:, 1:])
        out: list[list[int]] = [[]] * n
        rows = np.arange(n)
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            here = np.arange(len(rows))
            least = ranks[here, at]
            done = least == _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = cells[i, : lengths[i]].tolist()
                rows, cells, ranks, lengths, at, least = (x[~done] for x in (rows, cells, ranks, lengths, at, least))
                if not len(rows):
                    break
                longest = int(lengths.max())
                cells, ranks = cells[:, :longest], ranks[:, : max(1, longest - 1)]
                here = np.arange(len(rows))
            # close up: columns right of the pair move one to the left
            columns = np.arange(cells.shape[1])
            shifted = np.concatenate([cells[:, 1:], np.full((len(rows), 1), -1)], axis=1)
            cells = np.where(columns > at[:, None], shifted, cells)
            cells[here, at] = least
            shifted = np.concatenate([ranks[:, 1:], np.full((len(rows), 1), _NONE)], axis=1)
            ranks = np.where(columns[:-1] > at[:, None], shifted, ranks) if cells.shape[1] > 1 else np.full((len(rows), 1), _NONE)
            lengths = lengths - 1
            width_left = cells.shape[1]
            nxt = np.minimum(at + 1, width_left - 1)
            right = self.pairs(cells[here, at], np.where(at + 1 < width_left, cells[here, nxt], -1))
            inside = at < ranks.shape[1]
            ranks[here[inside], at[inside]] = right[inside]
            before = at > 0
            ranks[here[before], at[before] - 1] = self.pairs(cells[here[before], at[before] - 1], cells[here[before], at[before]])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, with a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(piece)
        tokens: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if tokens[i] is None or after[i] != j or j >= n or ranks.get(tokens[i] + tokens[j]) != rank:
                continue  # a pair that is gone
            tokens[i], tokens[j] = tokens[i] + tokens[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(tokens[i] + tokens[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, after[i]))
            if before[i] >= 0 and (r := ranks.get(tokens[before[i]] + tokens[i])) is not None:
                heapq.heappush(heap, (r, before[i], i))
        return [ranks[t] for t in tokens if t is not None]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > WIDEST:
                out[i] = self.merge_long(piece)
            else:
                buckets.setdefault(next(b for b in BUCKETS if len(piece) <= b), []).append(i)
        for width, members in buckets.items():
            step = max(1, SLICE_BYTES // (16 * width))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        return _PLAIN.findall(text) if _ODD.search(text) is None else self.pattern.findall(text)

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; afterwards all of them are known."""
        split = [self.split(t) for t in texts]
        new = list({p for pieces in split for p in pieces} - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known.clear()
            new = list({p for pieces in split for p in pieces})
        for piece, ids in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
            self.known[piece] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return split

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces([p.encode() for p in self.split(text)]) for i in ids]


#: For texts of these characters alone, the standard library's engine finds what the tokenizer's pattern finds, and sooner.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_ODD = re.compile(rf"[^\x09-\x0d\x20-\x7e{_LETTERS}]")
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_PLAIN_FOR = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: id, ids (array; left out with with_ids=False), n_tokens, ids_sha256 (of the decimal ids, joined by spaces), decoded_sha256 (of the bytes that the ids decode to).

    ranks_path is a vocabulary file that every executor can open, as it comes with an installed package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.shared(ranks_path, pattern)
        if pattern != _PLAIN_FOR:
            codec.split = codec.pattern.findall
        for batch in sliced(batches, text_col, TEXT_BYTES):
            split = codec.learn([t or "" for t in batch.column(1).to_pylist()])
            rows = []
            for pieces in split:
                known = [codec.known[p] for p in pieces]
                ids = " ".join([k[1] for k in known])
                row = (sum([k[0] for k in known]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([k[2] for k in known])).hexdigest())
                rows.append((*row, list(map(int, ids.split())) if with_ids else None))
            counts, coded, decoded, lists = zip(*rows, strict=True)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        codec.known.clear()  # the worker may go on to another stage

    rows = docs.select(docs[id_col].alias("id"), docs[text_col])
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def detokenize(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the decoded text; bytes that are no UTF-8 become U+FFFD, null ids no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.shared(ranks_path, pattern)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col])
    return rows.mapInArrow(run, f"id {encoded.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
