"""Plan shapes, and the skew-aware building blocks against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from registry.queries import QUERIES
from tradeloom import bindings as b
from tradeloom.operators import analytics, catalog
from tradeloom.plans.joins import keep_all_parents, top_per_key
from tradeloom.plans.numbering import dense_numbers
from tradeloom.plans.prefix import running_before


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def pushed(text: str) -> str:
    return " ".join(re.findall(r"PushedFilters: \[(.*)\]", text))


def schemas(text: str) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*>)", text)


def test_period_and_type_reach_the_scan(spark, small):
    facts = b.transactions(spark, small, with_user=False)
    text = plan(analytics.sales_dynamics(facts, "month", b.latest(b.read(spark, small, "lineitem"), "l_shipdate")))
    assert "GreaterThanOrEqual(l_shipdate" in pushed(text) and "EqualNullSafe(l_returnflag,N)" in pushed(text)
    assert schemas(text) == ["struct<l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>"]


def test_ranges_reach_the_scan_and_columns_are_pruned(spark, small):
    found = catalog.advanced_search(b.items(spark, small), category="SMALL", level_min=5).select("id")
    text = plan(found)
    assert "EqualTo(p_type,SMALL)" in pushed(text) and "GreaterThanOrEqual(p_size,5)" in pushed(text)


def test_top_n_is_not_a_full_sort(spark, small):
    assert "TakeOrderedAndProject" in plan(QUERIES["popular_items"](spark, small))


def test_history_is_cut_before_the_shuffle(spark, small):
    text = plan(QUERIES["trade_history"](spark, small))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_no_cross_joins(spark, small):
    for name in ("trade_details", "full_history", "all_users_inventory", "active_offers", "replay_rewards"):
        text = plan(QUERIES[name](spark, small))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_dense_numbers(spark):
    values = random.Random(3).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(5)
    rows = dense_numbers(df, ["v"], "n", start=11).collect()
    assert {r.v: r.n for r in rows} == {v: i for i, v in enumerate(sorted(values), 11)}


def test_running_before_in_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), i, rng.randint(-5, 5)) for i in range(300)]
    expected, sums = {}, {}
    for key, order, value in rows:
        expected[order] = sums.get(key, 0)
        sums[key] = sums.get(key, 0) + value
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    for block_rows in (7, 1000):
        got = running_before(df, ["k"], "o", ["v"], block_rows).collect()
        assert {r.o: r.before_v for r in got} == expected


def test_top_per_key_takes_one_shuffle(spark):
    df = spark.range(6000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    text = plan(top_per_key(df, ["k"], [F.desc("v")], 50))
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1 and "Partial" in text


def test_top_per_key_beyond_the_pushdown_limit(spark):
    df = spark.range(6000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    rows = top_per_key(df, ["k"], [F.desc("v")], 1500).collect()
    assert {(r.k, r.v) for r in rows} == {(v % 3, v) for v in range(6000) if v >= 6000 - 4500}


def test_keep_all_parents(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id bigint")
    children = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z")], "parent bigint, name string")
    rows = keep_all_parents(parents, children, "id", "parent").collect()
    assert sorted((r.id, r.name or "") for r in rows) == [(1, "x"), (1, "y"), (2, "")]


@pytest.mark.parametrize("name", ["trade_details", "trade_history", "full_history", "labelled_history", "ledger_fold"])
def test_lines_are_scanned_once(spark, small, name):
    """Order lines are stored by a job of their own; what is left reads the file once at most."""
    assert plan(QUERIES[name](spark, small)).count("lineitem.parquet") <= 1


def test_audit_reads_each_table_once(spark, small, monkeypatch):
    from tradeloom.operators import audit

    plans, keep = [], audit.stored

    def watched(df, name):
        plans.append(plan(df))
        return keep(df, name)

    monkeypatch.setattr(audit, "stored", watched)
    QUERIES["constraint_audit"](spark, small)
    assert len(plans) == 1
    for table in ("part", "customer", "events"):
        assert plans[0].count(f"/{table}.parquet") == 1
