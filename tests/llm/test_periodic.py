from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tradeloom.llm import periodic
from tradeloom.llm.queries import QUERIES


def brute(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs: maximal stretches of every period, without those of a smaller one."""
    found = []
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end + period - at >= max(least, 2 * period):
                found.append((at, end + period - at, period))
            at = end + 1
    smaller = lambda run: any(
        p < run[2] and s <= run[0] and s + n >= run[0] + run[1] for s, n, p in found
    )
    return sorted((run for run in found if not smaller(run)), key=lambda run: (run[0], run[2]))


def made(rng: random.Random, size: int) -> list[int]:
    words: list[int] = []
    while len(words) < size:
        kind = rng.random()
        if kind < 0.3 and words:
            back = rng.randint(1, min(len(words), 12))
            words += (words[-back:] * rng.randint(1, 6))[: rng.randint(1, 60)]
        else:
            words += [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randint(1, 12))]
    return words[:size]


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    words = made(rng, rng.randint(0, 160))
    for least in (2, 5, 12):
        assert periodic.runs_of(words, least) == brute(words, least)


def test_regular_sequences():
    fibonacci = [0, 1]
    while len(fibonacci) < 300:
        fibonacci += fibonacci[: len(fibonacci) // 2 + 1]
    a, b = [0], [0, 1]
    while len(b) < 250:
        a, b = b, b + a
    for words in (b, fibonacci[:250], [7] * 200, [0, 1] * 90, list(range(100)), list(range(40)) * 5):
        assert periodic.runs_of(words) == brute(words)


@pytest.mark.parametrize("seed", range(30))
def test_stretches_hold_all_runs(seed):
    rng = random.Random(seed)
    texts = [made(rng, rng.randint(0, 200)) for _ in range(6)]
    codes = np.array([word for text in texts for word in text], np.int64)
    owner = np.repeat(np.arange(6), [len(text) for text in texts])
    first = np.concatenate([[0], np.cumsum([len(text) for text in texts])])
    got = []
    for start, end in zip(*periodic.stretches(codes, owner), strict=True):
        assert owner[start] == owner[end - 1]
        got += [(int(start) + at, n, p) for at, n, p in periodic.runs_of(codes[start:end].tolist())]
    want = [(int(first[i]) + at, n, p) for i, text in enumerate(texts) for at, n, p in brute(text)]
    assert sorted(got) == sorted(want)


def collapsed(words: list[str], runs) -> str:
    drop = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(word for i, word in enumerate(words) if i not in drop)


def test_odd_rows(spark):
    line = "one two three four five six seven"
    texts = [
        None, "", " \t\n", "word", line, f"{line} {line}", f" {line}\n{line}\t{line} x", "a " * 40, "\x1c a\x85b " * 20,
        "é ü " * 9 + "end", f"{line} other {line} words", " ".join(f"{i}" for i in range(3000)) * 3, "a " * 40,
    ]
    rows = [(None if i == 3 else i % 11, text, "kept", i) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, key0 int")
    got = periodic.runs(df, keep=["doc_id", "key0", "runs"]).collect()
    assert len(got) == len(rows)
    for row in got:
        words = [part.decode() for part in (texts[row.key0] or "").encode().split()]
        runs = [tuple(run) for run in row.runs]
        assert runs == (brute(words) if len(words) < 500 else runs)
        assert (row.n_words, row.collapsed) == (len(words), collapsed(words, runs))
    assert [tuple(r) for r in next(row for row in got if row.key0 == 11).runs] == [(1, 8996, 2999)]
    assert periodic.runs(df.limit(0)).count() == 0
    assert set(periodic.runs(df).columns) == {"doc_id", "key0", "n_words", "runs", "collapsed"}


def test_query_equals_plain_version(spark, small):
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, small).collect()}
    assert set(got) == set(documents)
    some = 0
    for doc_id, text in documents.items():
        words = [part.decode() for part in text.encode().split()]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        row = got[doc_id]
        if n > 1500:
            continue
        runs = brute(words)
        some += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        text = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        assert row.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert some > 10
