from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tradeloom.llm import pitman_yor
from tradeloom.llm.queries import QUERIES


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def made(seed, n, taught=0.8):
    rng = random.Random(seed)
    kinds = ["".join(rng.choices(["th", "er", "é", "on", "a"], k=rng.randint(1, 5))) for _ in range(80)]
    return [(i, " ".join(rng.choices(kinds, weights=range(1, 81), k=rng.randint(0, 60))), rng.random() < taught) for i in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    words = Counter(w for _, text, taught in made(1, 300) if taught for w in tokens(text))
    df = spark.createDataFrame([*words.items(), ("never", 0)], "word string, n bigint")
    return words, pitman_yor.fit(df, sweeps=3, burn=1, share=1e-3, seed=5)


def test_letter_contexts_sum_to_one(fitted):
    _, model = fitted
    assert len(model.letters.level) > 20
    for logs in model.logs:
        assert np.exp(logs).sum(axis=1) == pytest.approx(np.ones(len(logs)), abs=1e-5)


def test_spelling_takes_the_longest_open_context(spark, fitted):
    words, model = fitted
    share, total, seen = 1e-3, 0, Counter()
    for word in words:
        letters = [0, *word.encode(), 0]
        for at in range(1, len(letters)):
            total += 1
            for k in range(1, 5):
                if at - k >= 0:
                    seen[bytes(letters[at - k : at])] += 1
    opened = {context for context, n in seen.items() if n >= share * total}
    assert len(opened) + 1 == len(model.letters.level)
    # Each word leads through the restaurants of its longest open contexts, whose depths are known.
    for word in list(words)[:40]:
        letters, state = [0, *word.encode(), 0], model.letters.start
        for at in range(1, len(letters)):
            longest = max(k for k in range(5) if not k or (at - k >= 0 and bytes(letters[at - k : at]) in opened))
            assert model.letters.level[state] == longest
            state = model.letters.follow[state, letters[at]]
    names = pa.array([*words, "x" * 3000, "日本"])
    spelled = model.letters.spell(names, model.logs[-1])
    for word, value in zip(names.to_pylist(), spelled, strict=True):
        state, want = model.letters.start, 0.0
        for letter in [*word.encode(), 0]:
            want += model.logs[-1][state, letter]
            state = model.letters.follow[state, letter]
        assert value == pytest.approx(want, rel=1e-4)


def test_contexts_of_a_rare_script_are_open(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in range(2500)] + ["ж" * 2] * 30
    contexts = pitman_yor._contexts(spark.createDataFrame([(w,) for w in words], "word string"))
    total = contexts.agg(F.sum("n")).first()[0]
    key = int.from_bytes("жж".encode(), "big")
    assert 1e-4 * total <= contexts.where(f"context = {key}").first().n < 1e-3 * total
    letters = pitman_yor.open_contexts(contexts, pitman_yor.SHARE)
    state = letters.start
    for letter in "жж".encode():
        state = letters.follow[state, letter]
    assert letters.level[state] == 4


def test_outcomes_sum_to_one(fitted):
    words, model = fitted
    names, counts = pa.array(list(words)), np.array(list(words.values()))
    known = 10 ** model.log10(names, counts, False)
    new = 10 ** model.log10(pa.array(["neverseen"]), np.array([0]), False)
    assert known.sum() + new[0] == pytest.approx(1, abs=1e-9)
    assert model.log10(pa.array(["neverseen"]), np.array([0]), True)[0] < math.log10(new[0])


def test_seating_follows_the_restaurant():
    seeds = np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64)
    weight, discount, customers, runs = 2.0, 0.6, 12, 20_000
    got = pitman_yor.seat(np.full(runs, customers), np.full(runs, weight), discount, seeds).mean()
    chance = {1: 1.0}
    for seated in range(1, customers):
        after = Counter()
        for tables, p in chance.items():
            new = weight / (weight + seated - discount * tables)
            after[tables + 1] += p * new
            after[tables] += p * (1 - new)
        chance = after
    assert got == pytest.approx(sum(t * p for t, p in chance.items()), rel=0.02)
    many = pitman_yor.seat(np.array([1, 2, 100_000, 10**9]), np.full(4, 0.5), discount, seeds[:4])
    assert many[0] == 1 and (many >= 1).all() and many[3] < 1000


def test_group_draws_are_binomial():
    seeds = np.random.default_rng(4).integers(0, 2**63, 20_000).astype(np.uint64)
    for n, p in ((3, 0.5), (40, 0.02), (400, 0.2), (10**6, 1e-7)):
        got = pitman_yor._binomial(np.full(len(seeds), n), np.full(len(seeds), p), seeds, 7)
        assert got.mean() == pytest.approx(n * p, rel=0.05, abs=0.01)
        assert got.var() == pytest.approx(n * p * (1 - p), rel=0.06, abs=0.02)


def plain_scores(rows, parts, word_log, sweeps=4, burn=1, seed=5):
    """Scores of all texts by dictionaries; ``word_log`` gives log10 probabilities from the tables of words."""
    texts = [(key, tokens(text), bool(taught)) for key, text, taught in rows]
    uses = Counter(w for _, ws, _ in texts for w in ws)
    code = dict(zip(uses, pitman_yor._hashes(pa.array(list(uses))).tolist(), strict=True))
    counts, used = Counter(), sum(uses.values())
    for _, ws, taught in texts:
        for pair in zip(["", *ws], ws):
            counts[pair] += taught
    hot = {w for w in uses if uses[w] * parts >= used}
    part = {}
    for u, w in counts:
        one = pitman_yor._part(np.array([code[u]]), np.array([code[w]]), np.array([u in hot]), parts)
        part[u, w] = int(one[0])
    tables, sums = {pair: int(n > 0) for pair, n in counts.items()}, Counter()
    for sweep in range(sweeps):
        opened, served, held = Counter(), Counter(), Counter()
        for (u, w), t in tables.items():
            at = part[u, w]
            opened[at, u] += t
            served[at, w] += t
            held[at] += t
        for (u, w), n in counts.items():
            if n > 1:
                at = part[u, w]
                back = pitman_yor.CONTEXT_STRENGTH + pitman_yor.CONTEXT_DISCOUNT * opened[at, u] * (parts if u in hot else 1)
                draw = (code[u] * 0xD6E8FEB86659FD93 ^ code[w]) + (seed * 1000 + sweep) * 0x94D049BB133111EB
                draw = np.array([draw % 2**64], np.uint64)
                weight = np.array([back * (served[at, w] / held[at])])
                tables[u, w] = int(pitman_yor.seat(np.array([n]), weight, pitman_yor.CONTEXT_DISCOUNT, draw)[0])
            if sweep >= burn:
                sums[u, w] += tables[u, w]
    customers = Counter()
    for (_, w), t in tables.items():
        customers[w] += t
    base = {w: 10**x for w, x in word_log({w: customers[w] for w in uses}).items()}
    met, opened = Counter(), Counter()
    for (u, w), n in counts.items():
        met[u] += n
        opened[u] += sums[u, w] / (sweeps - burn)

    def chance(u, w):
        own = counts.get((u, w), 0) - pitman_yor.CONTEXT_DISCOUNT * sums[u, w] / (sweeps - burn)
        return (own + (1 + pitman_yor.CONTEXT_DISCOUNT * opened[u]) * base[w]) / (1 + met[u])

    new = 10 ** word_log({**customers, "neverseen": 0})["neverseen"]
    known = [w for w in uses if customers[w]]
    for u in ("", *known[:5], "neverseen"):
        rest = (1 + pitman_yor.CONTEXT_DISCOUNT * opened[u]) / (1 + met[u]) * new
        assert sum(chance(u, w) for w in known) + rest == pytest.approx(1, abs=1e-6)
    return {key: sum(math.log10(chance(u, w)) for u, w in zip(["", *ws], ws)) for key, ws, _ in texts}


@pytest.mark.parametrize(("batches", "parts"), [(1, 1), (7, 4)])
def test_scores_equal_plain_python(spark, batches, parts):
    rows = made(7, 120)

    def word_log(customers):
        df = spark.createDataFrame([(w, n) for w, n in customers.items() if n], "word string, n bigint")
        model = pitman_yor.fit(df, sweeps=4, burn=1, share=pitman_yor.SHARE, seed=5)
        found = model.log10(pa.array(list(customers)), np.array(list(customers.values())), False)
        return dict(zip(customers, found.tolist(), strict=True))

    want = plain_scores(rows, parts, word_log)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, taught boolean").repartition(batches)
    got = {r.doc_id: r.score for r in pitman_yor.score(df).collect()}
    assert got.keys() == want.keys()
    for key, value in got.items():
        assert value == pytest.approx(want[key], rel=1e-4, abs=1e-4)


def test_word_order_counts(spark):
    rows = [(1, "one two three four one two three", True), (2, "one two three four one two three", False), (3, "three two one four three two one", False)]
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id bigint, text string, taught boolean")).collect()}
    assert got[1] == pytest.approx(got[2]) and got[2] > got[3] + 0.3


def test_planes_round_trip():
    for values in ([], [0], [255, 256, 0], [2**40 - 1, 3], [2**62, 1, 0]):
        back = pitman_yor.from_planes(pitman_yor.planes(np.array(values, np.int64)), len(values))
        assert back.tolist() == values


def test_odd_rows(spark):
    rows = [(i, text, taught, 0.5) for i, text, taught in made(2, 60)]
    rows += [(100, None, True, 0.0), (101, "", None, 0.0), (102, " \n ", False, 0.0), (None, "THER on", True, 0.0)]
    rows += [(103, "ther " * 30_000 + "y" * 5000, False, 0.0), (104, "same", True, 0.0), (104, "same", True, 0.0), (105, "nul\x00byte", True, 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, taught boolean, score double")
    got = pitman_yor.score(df).collect()
    assert len(got) == len(rows) and all(r.score < 0 and math.isfinite(r.score) for r in got)
    counts = Counter(w for _, text, taught, _ in rows if taught for w in tokens(text))
    total = sum(counts.values())
    def told(key, taught, n, known):
        return (key is not None, key or 0, taught, n, known)

    want = [told(key, bool(taught), len(tokens(text)), sum(w in counts for w in tokens(text))) for key, text, taught, _ in rows]
    assert sorted(told(r.doc_id, r.taught, r.n_tokens, r.n_known) for r in got) == sorted(want)
    assert {r.train_tokens for r in got} == {total}
    for r in got:
        if r.doc_id is not None and r.doc_id < 100:
            base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens(rows[r.doc_id][1]))
            assert r.base_score == pytest.approx(base)
    assert pitman_yor.score(df.limit(0)).count() == 0
    untaught = pitman_yor.score(df.withColumn("taught", F.lit(False))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untaught)


def test_query(spark, medium):
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{medium}/documents.parquet'").fetchall())
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, text in rows.items() if i not in held for w in tokens(text))
    total = sum(counts.values())
    got = QUERIES["op5_lm_scores"](spark, medium).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = tokens(rows[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(ws), sum(w in counts for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws), abs=1e-6)
        assert r.score < 0
    for held_out in (True, False):
        some = [r for r in got if r.held_out == held_out]
        assert sum(r.score for r in some) > sum(r.base_score for r in some)
