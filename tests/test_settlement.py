"""Settling requests of accounts that share nothing, against running them one by one."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tradeloom.plans import settlement
from tradeloom.plans.prefix import BUCKETS, hot_buckets
from tradeloom.plans.settlement import ACCEPTED, OPEN, _bounded, _decided, _outcomes, settle

SCHEMA = (
    "seq bigint, account string, a bigint, b bigint, at_seq bigint, coef bigint, cap bigint, need bigint, lead boolean"
)


def test_separate_chains_take_few_rounds(spark):
    """60 accounts with a chain of 30 requests each, in turns: 150 requests fit into a block."""
    rng = random.Random(8)
    left, want = dict.fromkeys(range(60), 100), {}
    postings = [(None, "cash", k, 0, 0, 100, 1, None, False) for k in left]
    for seq in range(1, 1801):
        k, amount, spends = rng.randrange(60), rng.randint(1, 60), rng.random() < 0.6
        coef, need = (-amount, amount) if spends else (amount, rng.randint(1, 40))
        postings.append((seq, "cash", k, 0, seq, coef, 1, need, True))
        want[seq] = int(left[k] >= need)
        left[k] += coef * want[seq]
    units, rounds = settle(spark.createDataFrame(postings, SCHEMA), block_requests=150, first_block=10)
    assert {r.seq: r.units for r in units.collect()} == want
    assert rounds <= 3


def test_only_keys_with_many_rows_are_hot(spark):
    df = spark.createDataFrame([(7,)] * 50 + [(k,) for k in range(100, 140)], "k bigint")
    expected = df.filter("k = 7").select(F.expr(f"pmod(hash(k), {BUCKETS})")).first()[0]
    assert hot_buckets(df, ["k"], 40) == [expected]
    assert hot_buckets(df, ["k"], 60) == []


def test_postings_leave_the_rounds_with_the_doubt(spark):
    """Request 1 and 2 have enough, 3 has not, 4 and 5 compete; only what they compete for is kept with its amounts."""
    postings = [(None, "cash", k, 0, 0, amount, 1, None, False) for k, amount in [(1, 100), (2, 1), (3, 10)]]
    for seq, k, amount in [(1, 1, 30), (2, 1, 40), (3, 2, 5), (4, 3, 6), (5, 3, 7)]:
        postings.append((seq, "stock", 9, 0, seq, amount, 1, None, True))
        postings.append((seq, "cash", k, 0, seq, -amount, 1, amount, False))
    df = spark.createDataFrame(postings, SCHEMA)
    units, _ = settle(df)
    assert {r.seq: r.units for r in units.collect()} == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    first = df.selectExpr(
        "*", "CAST(0 AS BIGINT) AS flock", "cap AS guess", "CAST(0 AS BIGINT) AS base", "true AS live",
        f"IF(seq IS NULL, {ACCEPTED}, {OPEN}) AS state", "IF(seq IS NULL, cap, 0) AS units",
    )
    kept = {(r.seq, r.account) for r in _decided(_bounded(first, 1000, [])).filter("NOT lead").collect()}
    assert kept == {(3, "cash"), (4, "cash"), (5, "cash")}


def test_accounts_covered_by_their_totals_are_not_ordered(spark, monkeypatch):
    """User 1 can pay for all requests in any order and user 2 cannot; nothing asks for the stock of 9."""
    ordered = []
    running = settlement.running_before

    def seen(df, *rest):
        ordered.append({r.a for r in df.select("a").collect()})
        return running(df, *rest)

    monkeypatch.setattr(settlement, "running_before", seen)
    postings = [(None, "cash", 1, 0, 0, 70, 1, None, False), (None, "cash", 2, 0, 0, 69, 1, None, False)]
    for seq, k, amount in [(1, 1, 30), (2, 2, 30), (3, 1, 40), (4, 2, 40)]:
        postings.append((seq, "stock", 9, 0, seq, amount, 1, None, True))
        postings.append((seq, "cash", k, 0, seq, -amount, 1, amount, False))
    # Asking for all there is leaves user 3 in doubt, as does asking without taking on user 4.
    postings += [(None, "cash", k, 0, 0, 5, 1, None, False) for k in (3, 4)]
    postings += [(5, "cash", 3, 0, 5, -1, 6, 1, True), (6, "cash", 4, 0, 6, 0, 1, 6, True)]
    units, _ = settle(spark.createDataFrame(postings, SCHEMA))
    assert {r.seq: r.units for r in units.collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 5, 6: 0}
    assert ordered[0] == {2, 3, 4}


def test_blocks_are_spread_by_their_requests(spark):
    """400 small blocks of 20 requests go to many tasks, although their bytes would fit into one."""
    runs = spark.range(8000).selectExpr(
        "id % 400 AS flock", "0L AS block", "id AS seq", "'cash' AS account", "id % 400 AS a", "0L AS b", "id AS at_seq",
        "-1L AS coef", "1L AS cap", "1L AS need", "1L AS guess", "5L AS likely", "0 AS state", "0L AS units",
    )
    found = _outcomes(runs, 8000, 1000).withColumn("task", F.spark_partition_id())
    sizes = found.groupBy("task").count().collect()
    assert sum(r["count"] for r in sizes) == 8000
    assert len(sizes) > 32 and max(r["count"] for r in sizes) <= 1000


def test_amounts_are_made_after_the_shuffle_by_account(spark, capsys):
    """The rows that go to their accounts carry a posting, not the four amounts that follow from it."""
    postings = [(None, "cash", 1, 0, 0, 9, 1, None, False), (1, "cash", 1, 0, 1, -5, 1, 5, True), (2, "cash", 1, 0, 2, -5, 1, 5, True)]
    first = spark.createDataFrame(postings, SCHEMA).selectExpr(
        "*", "CAST(0 AS BIGINT) AS flock", "cap AS guess", "CAST(0 AS BIGINT) AS base", "true AS live",
        f"IF(seq IS NULL, {ACCEPTED}, {OPEN}) AS state", "IF(seq IS NULL, cap, 0) AS units",
    )
    _bounded(first, 1000, []).explain()
    plan = capsys.readouterr().out
    assert 0 < plan.index("AS sure#") < plan.index("Exchange hashpartitioning(a#")
    rows = _bounded(first, 1000, []).select("seq", "base", "low", "high", "likely").collect()
    assert sorted(map(tuple, rows)) == [(1, 9, 9, 9, 9), (2, 9, 4, 9, 4)]
