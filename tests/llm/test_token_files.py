from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tradeloom.llm import token_files
from tradeloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    loaded = Tokenizer.from_file(PATH)
    loaded.encode_special_tokens = True
    return lambda text: loaded.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("count", [0, 1, 3, 4, 5, 1000])
def test_packing_round_trip(count):
    rng = np.random.default_rng(count)
    numbers = rng.integers(0, 2 ** rng.integers(1, 33, count), dtype=np.uint64).astype(np.uint32) if count else np.zeros(0, np.uint32)
    control, data = token_files.pack(numbers)
    assert len(control) == -(-count // 4)
    assert len(data) == sum(max(1, -(-int(n).bit_length() // 8)) for n in numbers)
    assert token_files.unpack(control, data, count).tolist() == numbers.tolist()


def test_words_equal_library(library):
    rng = random.Random(4)
    words = token_files._Words(PATH)
    alphabets = ["aàéß ñ日本語😀 \n\t.,'s!\x0b\x0c\r", "ΣΑΟΔς Σ\n ", "á̧̈ ë́    \x85\x1c\x1f b", "ab' s'll\t'", "<|endoftext|> a", "aB.,!'s* ", "e.ǅ'Ll-;x_ "]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60))) for _ in range(500)] + ["x" * 5000, "ab " * 9000]
    got = words.encode(pa.array(texts))
    assert [np.frombuffer(one, words.kind).tolist() for one in got] == [library(text) for text in texts]


def test_odd_rows(spark, tmp_path, library):
    rows = [(9, "later words"), (3, None), (3, ""), (5, "some more"), (None, "no key"), (5, "some more"), (7, "x y " * 4000)]
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id bigint, text string, ids string, key int")
    token_files.write(df, str(tmp_path / "set"), tokenizer=PATH, end_id=2, chunk_ids=8)
    got = sorted(token_files.read(spark, str(tmp_path / "set")).collect(), key=lambda r: r.start)
    at, seen = 0, []
    for row in got:
        ids = np.frombuffer(bytes(row.ids), "<u4").tolist()
        assert row.start == at
        at += len(ids)
        seen.append((row.doc_id, ids))
    assert [key for key, _ in seen] == [None, 3, 3, 5, 5, 7, 9]
    assert sorted(ids for _, ids in seen) == sorted(library(text or "") + [2] for _, text in rows)
    token_files.write(df.limit(0), str(tmp_path / "none"), tokenizer=PATH, end_id=2)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_query(spark, small, library):
    got = {r.doc_id: r for r in QUERIES["op10_token_files"](spark, small).collect()}
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{small}/documents.parquet' ORDER BY 1").fetchall()
    assert len(got) == len(rows)
    start = 0
    for doc_id, text in rows:
        ids = np.array([*library(text), 2], "<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens) == (start, len(ids))
        assert got[doc_id].ids_crc32 == zlib.crc32(ids.tobytes())
        start += len(ids)
