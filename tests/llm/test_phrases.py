from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tradeloom.llm import phrases

SCHEMA = "doc_id bigint, lang string, text string, words int, phrase string"


def counts(rows) -> Counter:
    """(lang, words) of all phrases of one to four words."""
    found: Counter = Counter()
    for lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    found["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    return found


def brute(rows, least: int, top: int) -> list[tuple]:
    f = counts(rows)
    n = Counter()
    for (lang, phrase), count in f.items():
        n[lang] += count * (len(phrase) == 1)
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out: dict[str, list] = {}
    for (lang, phrase), a in candidates.items():
        cuts = [(2000000 * a // (f[lang, phrase[:k]] + f[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        inside = any(
            other_lang == lang and len(longer) > len(phrase) and 100 * b >= 80 * a
            and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))
            for (other_lang, longer), b in candidates.items()
        )
        if not inside:
            text = " ".join(phrase)
            out.setdefault(lang, []).append((-score, -a, text.encode(), text, a, f[lang, phrase[:k]], f[lang, phrase[k:]], score))
    return sorted(
        (lang, rank, text, a, l, r, n[lang], score)
        for lang, found in out.items()
        for rank, (*_, text, a, l, r, score) in enumerate(sorted(found)[:top], 1)
    )


def texts(seed: int, count: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c\x00", "é", "Ü", "日本", "the", "of", "x-y", "\x85", "\x1cw"]
    fixed = ["new york city hall", "of the\tsame kind", "a b a b a b"]
    rows = []
    for _ in range(count):
        parts = [rng.choice([rng.choice(vocabulary), rng.choice(fixed)]) for _ in range(rng.randint(0, 40))]
        text = "".join(part + rng.choice([" ", "  ", " ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!? "]) for part in parts)
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, None), ("en", ""), ("fr", " . ,")]


def frame(spark, rows):
    return spark.createDataFrame([(i, *row, 1, "x") for i, row in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"shard_phrases": 7, "shards_per_pass": 3}, {"filter_bits": 6}])
def test_equals_brute_force(spark, options):
    rows = texts(1, 300)
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), least=5, top=40, **options).collect())
    assert got == brute(rows, 5, 40)
    assert len(got) > 60


def test_counts_equal_brute_force(spark):
    rows = texts(2, 200)
    found, totals = phrases.counted(frame(spark, rows), least=3, shard_phrases=50, shards_per_pass=2)
    want = {key: count for key, count in counts(rows).items() if count >= 3}
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect()} == want
    assert all(r.words == len(r.phrase.split(" ")) for r in found.collect())
    n = Counter()
    for (lang, phrase), count in counts(rows).items():
        n[lang] += count * (len(phrase) == 1)
    assert {r.lang: r.n for r in totals.collect()} == n


def test_batches_are_cut_anywhere(spark, monkeypatch):
    rows = texts(4, 60) + [("en", "deep learning " * 5000)]
    df = frame(spark, rows).coalesce(1)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 100)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=4, top=30).collect())
    assert got == brute(rows, 4, 30)


def test_score_needs_more_than_64_bits(spark):
    row = spark.sql("SELECT CAST(9000000000000 AS BIGINT) AS a, CAST(9000000000000 AS BIGINT) AS l, CAST(9000000000001 AS BIGINT) AS r")
    found = row.selectExpr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(20,0)) + r) AS s").first()
    assert found.s == 2000000 * 9000000000000 // 18000000000001


def test_empty_tables(spark):
    empty = frame(spark, texts(1, 1)).limit(0)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(frame(spark, [(None, None), ("en", "one two")])).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_trie_holds_its_rows_and_nothing_else(seed):
    rng = np.random.default_rng(seed)
    count, wide = int(rng.integers(1, 2000)), int(rng.integers(2, 300))
    rows = np.unique(rng.integers(1, wide, (count, 4)), axis=0)
    sizes = rng.integers(1, 5, len(rows))
    rows[np.arange(4) >= sizes[:, None]] = 0
    rows, at = np.unique(rows, axis=0, return_index=True)
    sizes = sizes[at]
    trie = phrases.Trie.build(rows, sizes, seed)
    row_of = {state: i for i, state in enumerate(trie.accept.tolist())}

    def walk(row) -> int:
        state = 0
        for symbol in row:
            moved = trie.base[state] + symbol
            if trie.check[moved] != state:
                return -1
            state = moved
        return row_of.get(int(state), -1)

    known = {tuple(row[:size]): i for i, (row, size) in enumerate(zip(rows.tolist(), sizes, strict=True))}
    assert all(walk(row) == i for row, i in known.items())
    for row in rng.integers(1, wide, (500, 4)).tolist():
        for size in range(1, 5):
            assert walk(row[:size]) == known.get(tuple(row[:size]), -1)
    assert len(row_of) == len(rows)


def test_texts_are_read_once_for_all_shards(spark, monkeypatch):
    reads = []

    def stored(df, name, keep=phrases.stored):
        if name == "counts":
            reads.append(df._jdf.queryExecution().analyzed().toString())
        return keep(df, name)

    monkeypatch.setattr(phrases, "stored", stored)
    rng = np.random.default_rng(5)
    said = [" ".join(f"w{n}" for n in rng.zipf(1.5, 60) % 40) + ". end" for _ in range(120)]
    rows = [(text, "en" if at % 3 else None) for at, text in enumerate(said)]
    df = spark.createDataFrame(rows, "text string, lang string")
    many = {(r.lang, r.phrase): r.f for r in phrases.counted(df, least=3, shard_phrases=10)[0].collect()}
    assert len(reads) == 1
    want = Counter()
    for text, lang in rows:
        for piece in text.split("."):
            words = piece.split()
            want.update((lang or "und", " ".join(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    assert many == {key: n for key, n in want.items() if n >= 3}
