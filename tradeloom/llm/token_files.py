"""Token ids in files: frequency-ranked ids, byte-aligned lengths, control bytes apart from data bytes.

Ids are replaced by their rank in the corpus, most frequent first, so that most
take one byte. A number takes one to four bytes, little end first; two bits for
each give its length, four of them to a control byte. All control bytes of a
chunk stand before, and apart from, its data bytes, so a chunk is decoded with a
table of 256 rows and a few numpy operations.

A file set is a folder with ``chunks`` (Parquet rows of one chunk each, ordered
by part and chunk) and ``vocabulary`` (rank to id). Chunks hold whole documents.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tradeloom.llm.shared import slices, split_words
from tradeloom.plans.workspace import new_path, stored

MEMO = 800_000
LONG_WORD = 64
CHUNK_IDS = 1 << 18
LOOKED_UP = 1 << 23  # bytes of text whose distinct words are looked up together
# Marks that are no part of a word whatever stands around them; an apostrophe may be.
MARKS = "".join(mark for mark in string.punctuation if mark != "'")
MARKED = rf"([a-z])([{re.escape(MARKS)}])"
# Lengths of the four numbers of a control byte, the first in the lowest bits.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of numbers below 2**32."""
    numbers = numbers.astype("<u4")
    lengths = 1 + (numbers > 0xFF) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[: len(numbers)] = lengths - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    used = np.arange(4) < lengths[:, None]
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), numbers.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers that were packed."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


class _Words:
    """Ids of blank-separated words, as little-endian bytes, through one tokenizer file.

    The tokenizer's own splitting ends at every blank and its normalisation does
    not reach across one, so a text's ids are those of its words in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

        def ids(text: str) -> list[int]:
            return self.library.encode(text, add_special_tokens=False).ids

        # What the file does with letters' case and with a mark after a letter decides how far words can be
        # brought together before they are looked up.
        letters = string.ascii_lowercase
        self.lowers = all(ids(one) == ids(one.upper()) for one in letters)
        self.parts = all(ids(one + mark) == ids(one) + ids(mark) for one in letters for mark in MARKS)

    def lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        new = [word for word in words if word not in self.known]
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            new = words
        found = self.library.encode_batch_fast(new, add_special_tokens=False)
        code = self.kind.char
        self.known.update(zip(new, [array(code, one.ids).tobytes() for one in found], strict=True))
        ids = [self.known[word] for word in words]
        for word in new:
            if len(word) > LONG_WORD:
                del self.known[word]
        return ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; each distinct word of the texts is looked up once."""
        if self.lowers:
            texts = pc.ascii_lower(texts)
            if self.parts:
                texts = pc.replace_substring_regex(texts, MARKED, r"\1 \2")
        words, ends = split_words(texts)
        coded = words.dictionary_encode()
        ids = pa.array(self.lookup(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        _, starts, data = ids.buffers()
        at = np.frombuffer(starts, np.int64)[ends].tolist()
        data = memoryview(data) if data else b""
        return [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def encode(df: DataFrame, path: str, *, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary): each whole text's ids and then ``end_id``, two bytes each (four for a large vocabulary).

    Null and empty texts hold the end id alone. Strings of special tokens in a
    text are ordinary text. ``path`` names a tokenizer file that splits at blanks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        end = np.array([end_id], words.kind).tobytes()
        for batch in slices(batches, "text", LOOKED_UP):
            ids = [found + end for found in words.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary())], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    return rows.mapInArrow(run, f"key {kind}, ids binary")


def frequencies(tokens: DataFrame, size: int, kind: str) -> DataFrame:
    """(id, n) over all rows of (key, ids); one small table per task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices([batch], "ids"):
                joined = b"".join(value or b"" for value in part.column("ids").to_pylist())
                total += np.bincount(np.frombuffer(joined, kind), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(
    df: DataFrame, path: str, *, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", chunk_ids: int = CHUNK_IDS
) -> None:
    """Write the file set of all texts in ascending order of their keys.

    Null keys come first; rows with equal keys are ordered by their ids. An
    empty table gives a file set without chunks. Each text is tokenised once;
    the driver holds the ranks, at most one per entry of the vocabulary.
    """
    words = _words(tokenizer)
    kind, size = words.kind.str, max(words.size, end_id + 1)
    tokens = stored(encode(df, tokenizer, end_id=end_id, key=key, text=text), "tokens")
    counted = np.zeros(size, np.int64)
    for row in frequencies(tokens, size, kind).collect():
        counted[row.id] = row.n
    order = np.lexsort((np.arange(size), -counted))
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(rank)
    key_type = tokens.schema["key"].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start, held = TaskContext.get().partitionId(), 0, 0, 0
        keys: list = []
        parts: list[np.ndarray] = []

        def chunk() -> pa.RecordBatch:
            control, data = pack(ranks.value[np.concatenate(parts)])
            columns = [[part], [number], [start], [held], [keys], [[len(x) for x in parts]], [control], [data]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(arrow_key), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=CHUNK_COLUMNS)

        for batch in batches:
            for one, value in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
                keys.append(one)
                parts.append(np.frombuffer(value.as_buffer(), kind))
                held += len(parts[-1])
                if held >= chunk_ids:
                    yield chunk()
                    number, start, held = number + 1, start + held, 0
                    keys, parts = [], []
        if keys:
            yield chunk()

    types = f"part bigint, chunk bigint, start bigint, n_ids bigint, keys array<{key_type}>, lengths array<bigint>, control binary, data binary"
    ordered = tokens.repartitionByRange("key").sortWithinPartitions("key", "ids")
    ordered.mapInArrow(run, types).write.parquet(f"{path}/chunks")
    vocabulary = [(i, int(x)) for i, x in enumerate(order)]
    spark.createDataFrame(vocabulary, "rank bigint, id bigint").coalesce(1).write.parquet(f"{path}/vocabulary")


CHUNK_COLUMNS = ["part", "chunk", "start", "n_ids", "keys", "lengths", "control", "data"]


def read(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    """(key, start bigint, ids binary) of every document of a file set.

    ``start`` counts the ids before the document in key order; ``ids`` are
    little-endian unsigned 32-bit integers.
    """
    chunks = spark.read.parquet(f"{path}/chunks")
    by_rank = np.zeros(0, np.uint32)
    rows = spark.read.parquet(f"{path}/vocabulary").collect()
    by_rank = np.zeros(len(rows), "<u4")
    for row in rows:
        by_rank[row.rank] = row.id
    ids_of = spark.sparkContext.broadcast(by_rank)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunks.groupBy("part")
        .agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    key_type = chunks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = np.array(batch.column("lengths")[row].as_py(), np.int64)
                ends = np.cumsum(lengths)
                ids = ids_of.value[unpack(batch.column("control")[row].as_py(), batch.column("data")[row].as_py(), int(lengths.sum()))]
                starts = batch.column("first")[row].as_py() + ends - lengths
                texts = [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[row].values, pa.array(starts), pa.array(texts, pa.binary())], names=["key", "start", "ids"]
                )

    placed = chunks.join(F.broadcast(offsets), "part").select(
        (F.col("offset") + F.col("start")).alias("first"), "keys", "lengths", "control", "data"
    )
    return placed.mapInArrow(run, f"key {key_type}, start bigint, ids binary").withColumnRenamed("key", key)


def file_set(df: DataFrame, **options) -> str:
    """Path of a new file set in the shared folder."""
    path = new_path(df.sparkSession, "token-files")
    write(df, path, **options)
    return path
