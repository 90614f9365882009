from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tradeloom.llm import mixing


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_permutation_is_one_to_one(spark, n):
    keys = mixing.round_keys(F.lit(n).cast("bigint"), F.lit("s"))
    at = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), keys, F.lit("s")).alias("x"))
    got = [r.x for r in at.orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        assert sum(abs(x - i) < 20 for i, x in enumerate(got)) < 100 and sum(b == a + 1 for a, b in zip(got, got[1:])) < 20


def plain_targets(words: dict, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(words.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * words[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * words[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize(
    "words",
    [{"a": 10, "b": 1000, "c": 50, None: 7, "Z": 400, "é": 0}, {"a": 5}, {"a": 0, "b": 0}, {f"s{i}": i * i for i in range(20)}],
)
def test_targets_equal_resharing(spark, words):
    df = spark.createDataFrame(list(words.items()), "source string, words bigint")
    got = {r.source: r.target for r in mixing.targets(df, weights=(5, 2, 1), share=1.5, most=2.0).collect()}
    assert got == pytest.approx(plain_targets(words))


def test_mix_of_odd_rows(spark):
    rows = [(i, f"w{i} " * (i % 40) + "\nend", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(600)]
    rows += [(700, None, "hot", 0), (701, "", None, 0), (702, "one", None, 0), (703, "long text " * 20_000, "long", 0), (704, " ", "blank", 0)]
    rows += [(5, "same row twice", "hot", 0)] * 2 + [(None, "no key at all", "hot", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, number int")
    plan = mixing.mix(df, block=8, shard=64)
    got = mixing.taken(plan).collect()
    assert len(got) == len(rows)
    by_target = {}
    for row in got:
        assert 0 <= row.taken <= 2 * row.size
        by_target.setdefault((row.source_size, row.target), []).append(row)
    for (size, target), members in by_target.items():
        assert abs(sum(r.taken for r in members) - target) <= 8 and sum(r.size for r in members) % max(size, 1) == 0
    assert sum(target for _, target in by_target) == pytest.approx(1.5 * sum(r.size for r in got))
    assert got_rows(mixing.taken(mixing.mix(df, block=8, shard=64)).collect()) == got_rows(got)
    per_shard = mixing.counts(plan).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert all(r.n == 64 for r in sorted(per_shard, key=lambda r: r.shard)[:-1])
    assert mixing.taken(mixing.mix(df.limit(0))).count() == 0


def got_rows(rows):
    return sorted(map(repr, rows))


def test_mixed_texts_hold_the_words_taken(spark, medium):
    df = spark.read.parquet(f"{medium}/documents.parquet").withColumns({"mixed_key": F.lit(1), "Mixed_Pieces": F.lit("x")})
    plan = mixing.mix(df)
    texts = {r.doc_id: r for r in mixing.mixed(df, plan).collect()}
    before = {r.doc_id: set(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect()}
    for row in mixing.taken(plan).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[row.key].text) if row.key in texts else []
        assert len(words) == row.taken and set(words) <= before[row.key]
