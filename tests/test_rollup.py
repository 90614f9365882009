"""Reports from a rollup against the same reports from the facts."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tradeloom.operators import analytics, rollup
from tradeloom.streaming.sinks import run_available

FACTS = (
    "item_id bigint, transaction_date timestamp_ntz, price_per_unit bigint, quantity bigint, transaction_type string, "
    "total_amount bigint"
)
LAST = dt.datetime(2024, 3, 10, 14, 7, 33)


def facts(seed: int, count: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        back = rng.choice([dt.timedelta(minutes=rng.randint(0, 1600)), dt.timedelta(days=rng.randint(0, 420), minutes=rng.randint(0, 90))])
        price, quantity = rng.randint(1, 999), rng.randint(1, 5)
        rows.append((rng.choice([1, 1, 2, 3, None]), LAST - back, price, quantity, rng.choice(["purchase", "sale"]), price * quantity))
    # At the very edges of the day view, and of a quarter of an hour.
    for back in (dt.timedelta(days=1), dt.timedelta(days=1, microseconds=1), dt.timedelta(hours=23, minutes=52, seconds=33)):
        rows.append((1, LAST - back, 5000, 1, "purchase", 5000))
    return rows


@pytest.mark.parametrize("period", ["day", "week", "month", "year", "all"])
def test_reports_equal_the_direct_ones(spark, period):
    rows = spark.createDataFrame(facts(1, 400), FACTS)
    parts = [rollup.rolled_up(rows.filter(f"pmod(hash(price_per_unit), 3) = {i}")) for i in range(3)]
    whole = rollup.merged(rollup.merged(parts[0], parts[1]), parts[2])
    got = rollup.sales_dynamics(whole, period, LAST, rows).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in analytics.sales_dynamics(rows, period, LAST).collect()]
    got = rollup.price_history(whole, period, LAST, rows).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, analytics.price_history(rows, period, LAST).collect()))


def test_a_stream_keeps_the_same_rollup_as_a_batch(spark, tmp_path):
    rows = facts(2, 120)
    schema = spark.createDataFrame([], FACTS).schema
    table = rollup.rollup_table(spark, str(tmp_path / "table"), spark.createDataFrame([], FACTS), compact_every=2)
    table.create(rollup.rolled_up(spark.createDataFrame(rows[:30], FACTS)), buckets=4)
    for start in range(30, len(rows), 31):
        spark.createDataFrame(rows[start : start + 31], FACTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run_available(rollup.keep_rollup(stream, table), str(tmp_path / "progress"))
    want = rollup.rolled_up(spark.createDataFrame(rows, FACTS))
    assert sorted(map(repr, table.read().collect())) == sorted(map(repr, want.collect()))


def test_no_facts(spark):
    none = rollup.rolled_up(spark.createDataFrame([], FACTS))
    assert rollup.sales_dynamics(none, "week", LAST).count() == rollup.price_history(none, "all").count() == 0
