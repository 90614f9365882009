"""Versioned tables: untouched buckets stay, readers see few folders, repeated batches change nothing."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeloom.operators import changes
from tradeloom.sources.versions import VersionedTable
from tradeloom.streaming import state

T0 = dt.datetime(2024, 1, 1)
ITEM = T.StructType([T.StructField(name, T.LongType()) for name in ("id", "price", "stock")])
HELD = "user_id bigint, item_id bigint, quantity bigint, purchased_at timestamp_ntz"


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


def patched(table, rows_, some):
    return changes.patch(rows_, some, ["price", "stock"])[0]


def test_a_change_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    items = spark.range(1, 501).selectExpr("id", "id * 10 AS price", "id % 7 AS stock")
    table = VersionedTable(spark, str(tmp_path / "items"), ITEM, ["id"])
    first = table.create(items, buckets=32)
    assert table.create(items.limit(0)) == first
    assert len(first.buckets) == 32
    some = spark.createDataFrame([(3, 1, 7, None), (3, 2, 8, 1), (400, 1, None, 5)], "id bigint, seq int, price bigint, stock bigint")
    second = table.change(some, lambda now, given: patched(table, now, given))
    moved = [bucket for bucket in first.buckets if first.buckets[bucket] != second.buckets[bucket]]
    assert 1 <= len(moved) <= 2
    want = {r[0]: r for r in rows(items)} | {3: (3, 8, 1), 400: (400, 4000, 5)}
    assert rows(table.read()) == sorted(want.values())
    assert rows(table.lookup(some)) == [want[3], want[400]]
    # A lookup reads the files of its buckets alone.
    files = {file.split("/_bucket=")[1].split("/")[0] for file in table.lookup(some).inputFiles()}
    assert files == {str(bucket) for bucket in moved}


def test_a_bucket_that_loses_its_rows_is_gone(spark, tmp_path):
    items = spark.range(1, 20).selectExpr("id", "id AS price", "id AS stock")
    table = VersionedTable(spark, str(tmp_path / "items"), ITEM, ["id"])
    table.create(items, buckets=64)
    gone = items.filter("id < 10").select("id")
    table.change(gone, lambda now, keys: now.join(keys, "id", "left_anti"))
    assert [r[0] for r in rows(table.read())] == list(range(10, 20))
    table.change(items.select("id"), lambda now, keys: now.join(keys, "id", "left_anti"))
    assert table.manifest().buckets == {} and table.read().count() == 0
    table.change(items, lambda now, given: now.unionByName(given))
    assert table.read().count() == 19


def test_fifty_batches_leave_few_folders(spark, tmp_path):
    rng = random.Random(6)
    snapshot = spark.createDataFrame([(u, 1, 5, T0) for u in range(1, 9)], HELD)
    table = state.holdings_table(spark, str(tmp_path / "held"), compact_every=5)
    table.create(snapshot, buckets=4)
    held = {(u, 1): 5 for u in range(1, 9)}
    folders = []
    for batch in range(50):
        given = [(rng.randint(1, 8), rng.randint(1, 3), rng.choice([-1, 1, 2]), T0) for _ in range(3)]
        sums = spark.createDataFrame(given, state.CHANGES).coalesce(1).groupBy("user_id", "item_id").agg(
            F.sum("quantity").alias("quantity"), F.min("at").alias("at")
        )
        table.add(sums, batch)
        table.add(sums, batch)  # once more, as after a lost commit
        for user, item, quantity, _ in given:
            held[user, item] = held.get((user, item), 0) + quantity
        manifest = table.manifest()
        folders.append(len(manifest.buckets) + len(manifest.additions))
    assert max(folders) <= 4 + 4
    assert table.manifest().batch == 49
    assert len(table.versions()) == 3
    assert len(table.files.names(f"{table.path}/data")) <= 4 + 5 + 3
    assert {(r.user_id, r.item_id): r.quantity for r in state.held(table).collect()} == {k: q for k, q in held.items() if q > 0}


def test_a_change_on_top_of_additions_and_an_older_version(spark, tmp_path):
    snapshot = spark.createDataFrame([(u, 1, 5, T0) for u in range(1, 9)], HELD)
    table = state.holdings_table(spark, str(tmp_path / "held"), compact_every=9)
    table.create(snapshot, buckets=4)
    table.add(spark.createDataFrame([(1, 1, 2, T0), (9, 1, 1, T0)], state.CHANGES), 0)
    keys = spark.createDataFrame([(2, 1)], "user_id bigint, item_id bigint")
    after = table.change(keys, lambda now, some: now.join(some, ["user_id", "item_id"], "left_anti"), batch=1)
    assert after.additions == [] and table.change(keys, lambda now, some: now.limit(0), batch=1) == after
    assert [(r[0], r[2]) for r in rows(table.read())] == [(1, 7)] + [(u, 5) for u in range(3, 9)] + [(9, 1)]
    assert [(r[0], r[2]) for r in rows(table.read(before_batch=1))] == [(1, 7), (2, 5)] + [(u, 5) for u in range(3, 9)] + [(9, 1)]
    assert rows(table.read(before_batch=0)) == rows(snapshot)


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "items"), ITEM, ["id"])
    first = table.create(spark.range(3).selectExpr("id", "id AS price", "id AS stock"), buckets=2)
    table.change(spark.range(1), lambda now, some: now)
    monkeypatch.setattr(table, "manifest", lambda before_batch=None: first)
    with pytest.raises(FileExistsError):
        table.change(spark.range(1), lambda now, some: now)


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "16k")
    try:
        items = spark.range(0, 40000, 1, 8).selectExpr("id", "hash(id) * 1L AS price", "xxhash64(id) AS stock")
        table = VersionedTable(spark, str(tmp_path / "items"), ITEM, ["id"])
        table.create(items, buckets=2)
        files = [str(file).split("/_bucket=")[1].split("/")[0] for file in tmp_path.rglob("*.parquet")]
        assert min(files.count("0"), files.count("1")) > 1
        assert table.read().exceptAll(items).isEmpty() and table.read().count() == 40000
    finally:
        spark.conf.set(size, before)
