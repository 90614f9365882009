from __future__ import annotations

import hashlib
import random

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tradeloom.llm import byte_bpe
from tradeloom.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_random_texts_equal_library(library):
    coder, rng = byte_bpe.coder(PATH, PATTERN), random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz ", "aàéß ñ日本語😀 \n\t.,'s!", "etaoin shr", "ab", "-= \n"]
    for _ in range(400):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 300)))
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text)
        rows = byte_bpe.decode_rows(pa.array([ids, None, ids[:1]], pa.list_(pa.int32())), byte_bpe._table(PATH)).to_pylist()
        assert rows[0] == text.encode() and rows[1] == b"" and text.encode().startswith(rows[2])


def test_long_pieces(library):
    coder = byte_bpe.coder(PATH, PATTERN)
    for text in ("a" * 50_000, "thenation" * 5_000, "=" * 20_000, " " * 20_000):
        assert coder.encode(text) == library.encode_ordinary(text)


def test_memo_of_any_size_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 5)
    coder = byte_bpe.ByteCoder(byte_bpe.read_ranks(PATH), PATTERN)
    text = "Thinan erstly. Ofthtioninor, ofthtioninor élèveaux!"
    assert coder.encode(text) == library.encode_ordinary(text)


def test_odd_rows(spark):
    rows = [(1, None, "x", 0), (2, "", "x", 1), (None, "two", "x", 2), (1, "two", "x", 3), (1, "two", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, ids int")
    encoded = byte_bpe.encode(df, PATH, PATTERN)
    decoded = byte_bpe.decode(encoded, PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in decoded) == [
        (0, b"two"), (1, b""), (1, b"two"), (1, b"two"), (2, b"")
    ]
    both = byte_bpe.round_trip(df, PATH, PATTERN).collect()
    assert sorted(map(repr, both)) == sorted(map(repr, decoded))
    assert byte_bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


def test_query(spark, small, library):
    got = {r.doc_id: r for r in QUERIES["op6_byte_bpe"](spark, small).collect()}
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{small}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
