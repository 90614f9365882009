from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import text
from tradeloom.operators import catalog

ITEMS = "id bigint, name string, description string, price bigint, category string, rarity string, level_required int, slot string, stock bigint, bonus_stats string"


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "Amber Lantern", "x" * 70, 640, "weapon", "epic", 12, "head", 0, '{"reach": 3, "glow": 21}'),
        (2, "plain amber cloak", "short", 410, "armor", "rare", 7, "body", 5, "not json"),
        (3, "Potion 100%", None, 0, "potion", "common", 0, "other", 6, '{"heal": "much"}'),
        (4, None, "y" * 50, 410, None, None, None, None, 1, None),
    ]
    return spark.createDataFrame(rows, ITEMS)


def ids(df):
    return [row.id for row in df.collect()]


def test_search_is_literal_and_ignores_case(items):
    assert ids(catalog.advanced_search(items, name="AMBER")) == [1, 2]
    assert ids(catalog.advanced_search(items, name="%")) == [3]
    assert ids(catalog.advanced_search(items, name="_")) == []


def test_zero_is_a_bound_and_blank_is_unset(items):
    assert ids(catalog.advanced_search(items, price_max=0)) == [3]
    assert ids(catalog.advanced_search(items, level_min=0, sort_by="level_required")) == [3, 2, 1]
    assert ids(catalog.advanced_search(items, name="", category="", price_min="")) == [4, 1, 3, 2]


def test_sort_whitelist(items):
    assert ids(catalog.browse(items, sort_by="price", order="DESC")) == [1, 2, 4, 3]
    assert sorted(ids(catalog.browse(items, sort_by="stock"))) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        catalog.browse(items, sort_by="price", order="ASC; DROP TABLE items")


def test_availability(items):
    assert ids(catalog.browse(items, availability="out_stock")) == [1]
    assert ids(catalog.browse(items, show_out_of_stock=False, sort_by="price")) == [3, 2, 4]
    assert ids(catalog.quick_search(items, "  Amber ", availability="in_stock")) == [2]


def test_stock_bands(items):
    assert {r.id: r.stock_status for r in catalog.stock_bands(items).collect()} == {1: "out", 2: "low", 3: "ok", 4: "low"}
    assert sorted(ids(catalog.low_stock(items))) == [2, 4]
    assert ids(catalog.out_of_stock(items)) == [1]


def test_lookup_and_balances(spark, items):
    wanted = spark.createDataFrame([(2,), (2,), (9,)], "k bigint")
    assert ids(catalog.lookup(items, wanted)) == [2]
    users = spark.createDataFrame([(2, 70)], "id bigint, balance bigint")
    assert sorted((r.user_id, r.balance) for r in catalog.balances(users, wanted).collect()) == [(2, 70), (2, 70), (9, 0)]


def test_labels_and_previews(items):
    rows = {r.id: r for r in catalog.labelled(items).collect()}
    assert rows[1].category_label == text.CATEGORY_LABELS["weapon"]
    assert rows[1].rarity_label == text.RARITY_LABELS["epic"]
    assert rows[4].category_label == text.BLANK and rows[4].rarity_label == text.RARITY_OTHER
    assert rows[1].card_text == "x" * 60 and rows[1].short_text == "x" * 50 + "..."
    assert rows[4].short_text == "y" * 50 and rows[3].card_text is None


def test_json_pairs_skip_what_is_not_an_object(items):
    rows = {(r.id, r.stat): (r.amount_text, r.amount) for r in text.json_pairs(items, "bonus_stats", "id").collect()}
    assert rows == {(1, "reach"): ("3", 3), (1, "glow"): ("21", 21), (3, "heal"): ("much", None)}


def test_blank_and_date_labels(spark):
    df = spark.createDataFrame([(None, None), (0, "2024-01-02 03:04:05")], "n int, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    rows = df.select(text.or_blank(F.col("n")).alias("n"), text.date_label("t").alias("t")).collect()
    assert [tuple(r) for r in rows] == [("-", text.DATE_UNKNOWN), ("-", "2024-01-02 03:04")]
