"""Byte-level BPE by longest matches and adjacent-token compatibility.

Bytes are mapped to the 256 Latin-1 characters, so that an Aho-Corasick trie of
the vocabulary answers "which is the longest token that starts here". A piece is
tokenised greedily from the left; a token is kept only if it is compatible with
the token before it, that is if merging the two tokens' bytes from scratch gives
the same two tokens again. When no shorter token is compatible either, the last
token is taken back, and a position once given up is never tried again, so the
work is linear in the piece. A sequence whose neighbours are all compatible is
exactly what the rank-by-rank merges give. Compatibility and pieces are memoised
in tables of a fixed size that are emptied when full and at the end of a task.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tradeloom.llm.shared import slices

MEMO = 400_000
LONG_PIECE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 text and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """Plain BPE: merge the adjacent pair of lowest rank, leftmost first, until ``until`` parts or no pair is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > until:
        found = min(
            ((ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in ranks),
            default=None,
        )
        if found is None:
            break
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class _Pieces(dict):
    """Ids of pieces seen lately, as 32-bit integers in a row."""

    def __init__(self, coder: ByteCoder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.coder.encode_piece(piece.encode())).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class ByteCoder:
    """Encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        # A token that merging cannot build stands only for a whole piece.
        self.ids = {
            token.decode("latin-1"): rank
            for token, rank in ranks.items()
            if len(token) == 1 or len(merge(token, ranks)) == 1
        }
        self.longest = max(map(len, self.ids))
        self.trie = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.trie.add_word(token, rank)
        self.rank_of = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.edges: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        self.prefixes: dict[str, str] = {}
        self.memo: dict[tuple[str, str], bool] = {}
        self.pieces = _Pieces(self)

    def match(self, text: str, start: int) -> str:
        """Longest token at ``start``; empty at the end of the text."""
        window = text[start : start + self.longest]
        window = window[: self.trie.longest_prefix(window)]
        while window and window not in self.ids:
            window = window[:-1]
        return window

    def shorter(self, token: str) -> str:
        """Longest token that is a proper prefix of a token; empty if there is none."""
        known = self.prefixes.get(token)
        if known is None:
            known = self.prefixes[token] = self.match(token[:-1], 0)
        return known

    def edge(self, token: str, last: bool) -> list[tuple[str, float]]:
        """The parts that end (or start) the token while it is merged, each with the rank that absorbs it."""
        known = self.edges.get((token, last))
        if known is None:
            parts = merge(token.encode("latin-1"), self.ranks, until=2) if len(token) > 1 else []
            known = []
            if parts:
                inner = self.edge(parts[-1 if last else 0].decode("latin-1"), last)
                known = [*inner[:-1], (inner[-1][0], self.ids[token])]
            known = [*known, (token, math.inf)]
            self.edges[token, last] = known
        return known

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the bytes of both gives just these two tokens.

        The two parts beside the border are followed while ranks rise; the
        tokens are incompatible as soon as the pair across the border would be
        merged before either part is absorbed into its own token.
        """
        known = self.memo.get((left, right))
        if known is None:
            ends, starts = iter(self.edge(left, True)), iter(self.edge(right, False))
            (end, end_until), (start, start_until) = next(ends), next(starts)
            while True:
                across = self.rank_of.get(end + start, math.inf)
                known = not (across < end_until and across <= start_until and across < math.inf)
                if not known or end_until == start_until == math.inf:
                    break
                if end_until <= start_until:
                    end, end_until = next(ends)
                else:
                    start, start_until = next(starts)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the splitting pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        size, memo, prefixes = len(text), self.memo, self.prefixes
        tokens: list[str] = []
        dead: set[int] = set()
        before, at, token = "", 0, self.match(text, 0)
        while at < size:
            while token:
                end = at + len(token)
                if end not in dead:
                    fits = not before or memo.get((before, token))
                    if fits or (fits is None and self.compatible(before, token)):
                        break
                token = prefixes.get(token) or self.shorter(token)
            if token:
                tokens.append(token)
                before, at = token, end
                token = self.match(text, at)
            elif not tokens:
                raise ValueError("the vocabulary lacks single bytes")
            else:
                dead.add(at)
                token = tokens.pop()
                at -= len(token)
                before = tokens[-1] if tokens else ""
                token = self.shorter(token)
        return [self.ids[token] for token in tokens]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers in a row."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def forget(self) -> None:
        """Empty the memos, since a worker may go on with other work."""
        self.pieces.clear()
        self.memo.clear()


def token_table(ranks: dict[bytes, int]) -> pa.Array:
    """Bytes of each id in order; null where no token has the id."""
    by_rank = {rank: token for token, rank in ranks.items()}
    return pa.array([by_rank.get(rank) for rank in range(max(by_rank) + 1)], pa.large_binary())


def decode_rows(ids: pa.ListArray, table: pa.Array) -> pa.BinaryArray:
    """The bytes of each row's ids; a null row has none."""
    ids = ids.fill_null([]) if ids.null_count else ids
    tokens = table.take(ids.flatten())
    if tokens.null_count:
        raise ValueError("an id is not in the vocabulary")
    starts = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :]
    ends = starts[np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])]
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), tokens.buffers()[2]]).cast(pa.binary())


@lru_cache(maxsize=2)
def _table(path: str) -> pa.Array:
    return token_table(read_ranks(path))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteCoder:
    """One coder per Python worker, vocabulary and pattern."""
    return ByteCoder(read_ranks(path), pattern)


def _encoded(texts: pa.Array, use: ByteCoder) -> pa.ListArray:
    rows = [use.encode_bytes(value or "") for value in texts.to_pylist()]
    ends = np.cumsum([0, *(len(row) // 4 for row in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row, repeated rows and null keys included.

    Null and empty texts have no ids. Other columns of any name are ignored.
    ``path`` names a rank file that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(path, pattern)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), _encoded(batch.column("text"), use)], names=["key", "ids"])
        use.forget()

    kind = df.schema[key].dataType.simpleString()
    rows = df.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, bytes binary): ``encode`` and then ``decode`` in one pass, with one worker per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(path, pattern)
        for batch in slices(batches, "text"):
            ids = _encoded(batch.column("text"), use)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), ids, decode_rows(ids, _table(path))], names=["key", "ids", "bytes"]
            )
        use.forget()

    kind = df.schema[key].dataType.simpleString()
    rows = df.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, bytes binary").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, bytes binary): the bytes the ids stand for; null ids give none. An unknown id raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids, decode_rows(ids, _table(path))], names=["key", "ids", "bytes"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids")
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, bytes binary").withColumnRenamed("key", key)
