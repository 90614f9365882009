"""Streams over several micro-batches: late rows, restarts, repeated batches."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry import queries
from tradeloom.operators import analytics
from tradeloom.streaming import live, state
from tradeloom.streaming.sinks import read_batches, run_available, write_batch

T0 = dt.datetime(2024, 1, 1)
SALES = "user_id bigint, transaction_type string, quantity bigint, total_amount bigint, transaction_date timestamp_ntz"


class Feed:
    """A folder that grows file by file, read one file per micro-batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.files = spark, str(folder), schema, 0

    def add(self, rows):
        self.files += 1
        df = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        df.write.mode("append").parquet(self.folder)

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(self.folder)


def drain(spark, df, tmp_path, name="out"):
    writer = df.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name))
    run_available(writer, str(tmp_path / f"{name}-progress"))
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def sale(minutes, amount=10, kind="purchase", user=1):
    return (user, kind, 1, amount, T0 + dt.timedelta(minutes=minutes))


def test_late_rows_are_dropped_and_a_restart_adds_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", SALES)
    feed.add([sale(10), sale(70)])
    feed.add([sale(200)])
    df = live.live_sales(feed.stream())
    first = drain(spark, df, tmp_path).collect()
    assert sorted((r.window_start.hour, r.sales_count) for r in first) == [(0, 1), (1, 1)]
    feed.add([sale(20), sale(300)])  # the first row is behind the watermark
    second = drain(spark, live.live_sales(feed.stream()), tmp_path).collect()
    assert sorted((r.window_start.hour, r.sales_count) for r in second) == [(0, 1), (1, 1), (3, 1)]
    third = drain(spark, live.live_sales(feed.stream()), tmp_path).collect()
    assert sorted(second) == sorted(third)


def test_trailing_windows_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((sale(rng.randint(0, 3000), rng.randint(1, 9)) for _ in range(200)), key=lambda r: r[4])
    feed = Feed(spark, tmp_path / "in", SALES)
    for part in range(0, 200, 50):
        feed.add(rows[part : part + 50])
    got = drain(spark, live.live_trailing(feed.stream()), tmp_path).collect()
    closed = rows[-1][4] - dt.timedelta(minutes=10)
    expected = {}
    for row in rows:
        hour = row[4].replace(minute=0)
        for back in range(24):
            start = hour - dt.timedelta(hours=back)
            if start + dt.timedelta(hours=24) <= closed:
                count, total = expected.get(start, (0, 0))
                expected[start] = (count + 1, total + row[3])
    assert {r.window_start: (r.sales_count, r.total_amount) for r in got} == expected


ACTIONS = "id bigint, user_id bigint, action_type string, result string, created_at timestamp_ntz"


@pytest.fixture()
def actions(spark, tmp_path):
    rng = random.Random(2)
    feed = Feed(spark, tmp_path / "in", ACTIONS)
    rows = []
    for batch in range(3):
        part = [
            (batch * 100 + i, rng.randint(1, 5), rng.choice(["wheel", "hunt", "chest"]), rng.choice(["win", "lose"]),
             T0 + dt.timedelta(hours=batch * 30 + i % 20))
            for i in range(40)
        ]
        rows += part
        feed.add(part)
    return feed, rows


def test_daily_first(spark, tmp_path, actions):
    feed, rows = actions
    got = drain(spark, live.daily_first(feed.stream()), tmp_path).collect()
    assert sorted((r.user_id, r.day) for r in got) == sorted({(r[1], r[4].date()) for r in rows})


def test_counters_equal_the_batch_form(spark, tmp_path, actions):
    feed, rows = actions
    path = str(tmp_path / "counters")
    run_available(live.running_counters(feed.stream(), path), str(tmp_path / "progress"))
    batch = analytics.game_counters(spark.createDataFrame(rows, ACTIONS))
    assert sorted(live.latest_counters(spark, path).collect()) == sorted(batch.collect())
    last = live.compact_counters(spark, path, str(tmp_path / "compact"))
    compact = spark.read.parquet(str(tmp_path / "compact"))
    assert sorted(live.latest_counters(spark, path, compact, last).collect()) == sorted(batch.collect())


def test_holdings_survive_a_repeated_batch(spark, tmp_path):
    schema = "user_id bigint, item_id bigint, quantity bigint, at timestamp_ntz"
    feed = Feed(spark, tmp_path / "in", schema)
    feed.add([(1, 1, 5, T0), (1, 2, 1, T0)])
    feed.add([(1, 1, -5, T0), (1, 2, 3, T0)])
    snapshot = spark.createDataFrame([(1, 2, 1, T0)], "user_id bigint, item_id bigint, quantity bigint, purchased_at timestamp_ntz")
    path = str(tmp_path / "changes")
    run_available(state.upsert_holdings(feed.stream(), path), str(tmp_path / "progress"))
    after = sorted((r.user_id, r.item_id, r.quantity) for r in state.current_holdings(snapshot, path).collect())
    assert after == [(1, 2, 5)]
    again = read_batches(spark, path, state.CHANGES).filter("batch = 1").drop("batch").collect()
    write_batch(spark.createDataFrame(again, state.CHANGES), path, 1)
    assert sorted((r.user_id, r.item_id, r.quantity) for r in state.current_holdings(snapshot, path).collect()) == after
    last = state.compact_holdings(snapshot, path, str(tmp_path / "compact"))
    assert last == 1
    compact = spark.read.parquet(str(tmp_path / "compact"))
    write_batch(spark.createDataFrame([(1, 2, 4, T0)], state.CHANGES), path, 2)
    assert [r.quantity for r in state.current_holdings(compact, path, last).collect()] == [9]
    assert state.compact_holdings(compact, path, str(tmp_path / "again"), last) == 2
    assert [r.quantity for r in spark.read.parquet(str(tmp_path / "again")).collect()] == [9]


def test_balance_guard_over_batches(spark, tmp_path):
    rng = random.Random(3)
    schema = "event_id bigint, user_id bigint, ts timestamp_ntz, amount bigint"
    feed = Feed(spark, tmp_path / "in", schema)
    balances = {1: 60, 2: 30, 3: -5}
    users = spark.createDataFrame(list(balances.items()), "id bigint, balance bigint")
    expected, event = {}, 0
    for batch in range(3):
        rows = []
        for i in range(30):
            event += 1
            rows.append((event, rng.choice([1, 1, 2, 3, 4]), T0 + dt.timedelta(hours=batch, minutes=i), rng.randint(1, 15)))
        feed.add(rows)
        for event_id, user, _, amount in rows:
            expected[event_id] = user in balances and balances[user] >= amount
            if expected[event_id]:
                balances[user] -= amount
    path = str(tmp_path / "guard")
    run_available(state.guard_balances(feed.stream(), users, path), str(tmp_path / "progress"))
    assert {r.event_id: r.accepted for r in state.guard_verdicts(spark, path).collect()} == expected
    last = state.compact_balances(users, path, str(tmp_path / "compact"))
    compact = spark.read.parquet(str(tmp_path / "compact"))
    assert last == 2 and {r.id: r.balance for r in compact.collect()} == balances
    # The stream goes on from the compacted users.
    feed.add([(1000, 1, T0 + dt.timedelta(days=1), balances[1] + 1), (1001, 1, T0 + dt.timedelta(days=1), balances[1])])
    run_available(state.guard_balances(feed.stream(), compact, path, last), str(tmp_path / "progress"))
    late = {r.event_id: r.accepted for r in state.guard_verdicts(spark, path).filter("event_id >= 1000").collect()}
    assert late == {1000: False, 1001: True}


SPENDS = "event_id bigint, user_id bigint, ts timestamp_ntz, amount bigint"


def spend_batches(seed: int, batches: int, per_batch: int, balances: dict) -> tuple[list[list], dict]:
    """Spends of a hot user and others, some of them unknown, and the one-by-one verdicts; ``balances`` is left at the end."""
    rng, event, expected, parts = random.Random(seed), 0, {}, []
    for batch in range(batches):
        rows = []
        for i in range(per_batch):
            event += 1
            user = rng.choice([1, 1, 1, 2, 3, 4, None])
            rows.append((event, user, T0 + dt.timedelta(hours=batch, minutes=i // 2), rng.randint(0, 15)))
        for event_id, user, _, amount in rows:
            expected[event_id] = user in balances and balances[user] >= amount
            if expected[event_id]:
                balances[user] -= amount
        rng.shuffle(rows)
        parts.append(rows)
    return parts, expected


def test_keyed_guard_over_batches_and_restarts(spark, tmp_path):
    balances = {1: 200, 2: 60, 3: -5}
    users = spark.createDataFrame(list(balances.items()), "id bigint, balance bigint")
    feed = Feed(spark, tmp_path / "in", SPENDS)
    parts, expected = spend_batches(3, 5, 40, balances)

    def run(known):
        with state.rocksdb(spark):
            writer = state.guard_keyed(feed.stream(), known).writeStream.outputMode("append").format("parquet")
            run_available(writer.option("path", str(tmp_path / "out")), str(tmp_path / "progress"))
        found = spark.read.parquet(str(tmp_path / "out")).collect()
        assert len({r.event_id for r in found}) == len(found)
        return {r.event_id: r.accepted for r in found}

    for rows in parts[:3]:
        feed.add(rows)
    assert run(users) == {event: expected[event] for rows in parts[:3] for event, *_ in rows}
    # After a restart the state goes on; the users' table is not read again.
    changed = users.withColumn("balance", F.lit(10_000).cast("bigint"))
    for rows in parts[3:]:
        feed.add(rows)
    assert run(changed) == expected
    assert run(changed) == expected


def test_keyed_guard_keeps_only_those_who_spend(spark, tmp_path):
    """Large balances stay exact beside unknown users and null ones."""
    large = 2**62 + 1
    users = spark.range(500).selectExpr("id", f"CAST({large} AS BIGINT) AS balance")
    feed = Feed(spark, tmp_path / "in", SPENDS)
    spends = [(1, 7, large), (2, 7, 1), (3, 900, 0), (4, None, 0), (5, 8, large + 1)]
    feed.add([(event, user, dt.datetime(2024, 1, 1, 0, 0, event), amount) for event, user, amount in spends])
    with state.rocksdb(spark):
        writer = state.guard_keyed(feed.stream(), users).writeStream.outputMode("append").format("parquet")
        writer = writer.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    found = {r.event_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: True, 2: False, 3: False, 4: False, 5: False}
    kept = [one["numRowsTotal"] for progress in query.recentProgress for one in progress["stateOperators"]]
    assert max(kept) == 2


def test_spending_in_order_equals_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(300):
        low = int(rng.choice([0, 0, 0, -5]))
        amounts = rng.integers(low, int(rng.choice([3, 20, 2**62])), rng.integers(0, 60))
        balance = int(rng.integers(-5, 200))
        paid, left = state.spend_in_order(amounts, balance)
        for i, amount in enumerate(amounts.tolist()):
            assert paid[i] == (amount <= balance)
            balance -= amount if paid[i] else 0
        assert left == balance


def test_guard_reads_the_users_once_and_repeats_a_batch(spark, tmp_path):
    balances = {1: 150, 2: 40, 3: 0}
    users = spark.createDataFrame(list(balances.items()), "id bigint, balance bigint")
    feed = Feed(spark, tmp_path / "in", SPENDS)
    parts, expected = spend_batches(8, 4, 20, balances)
    path = str(tmp_path / "guard")
    for rows in parts:
        feed.add(rows)
    run_available(state.guard_balances(feed.stream(), users, path, buckets=4, compact_every=2), str(tmp_path / "progress"))
    verdicts = lambda: {r.event_id: r.accepted for r in state.guard_verdicts(spark, path).collect()}
    assert verdicts() == expected
    table = state.balances_table(spark, f"{path}/balances", compact_every=2)
    assert {r.user_id: r.balance for r in table.read().collect()} == balances
    # The last batch once more, as after a lost commit: same verdicts, same balances.
    for name in ("3", ".3.crc"):
        (tmp_path / "progress" / "commits" / name).unlink()
    run_available(
        state.guard_balances(feed.stream(), users.limit(0), path, buckets=4, compact_every=2), str(tmp_path / "progress")
    )
    assert verdicts() == expected
    assert {r.user_id: r.balance for r in table.read().collect()} == balances


@pytest.mark.parametrize("name", ["stream_sales", "stream_candles", "stream_trailing"])
def test_windows_a_stream_lost_are_not_filled_in(spark, small, monkeypatch, name):
    whole = queries.QUERIES[name](spark, small).count()
    monkeypatch.setattr(queries, "_stream_to_table", lambda s, df, name: s.createDataFrame([], df.schema))
    assert 0 < queries.QUERIES[name](spark, small).count() < whole
