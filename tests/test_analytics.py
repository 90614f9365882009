from __future__ import annotations

import datetime as dt

import pytest

from tradeloom.operators import analytics, holdings, market

NOW = dt.datetime(2024, 3, 31, 12, 0)
SALES = "user_id bigint, item_id bigint, quantity bigint, transaction_type string, price_per_unit bigint, total_amount bigint, transaction_date timestamp_ntz"


def sale(item, quantity, when, kind="purchase", user=1, price=10):
    return (user, item, quantity, kind, price, price * quantity, when)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "id bigint, name string, category string")


@pytest.fixture(scope="module")
def sales(spark):
    day = dt.timedelta(days=1)
    rows = [
        sale(1, 2, NOW - 7 * day),
        sale(2, 2, NOW - 7 * day - dt.timedelta(seconds=1)),
        sale(2, 5, NOW, "sale"),
        sale(3, 2, NOW + day),
        sale(9, 50, NOW),
    ]
    return spark.createDataFrame(rows, SALES)


def test_period_bound_is_inclusive_and_open_ended(sales):
    row = analytics.total_stats(sales, "week", NOW).first()
    assert (row.total_transactions, row.total_items_sold) == (3, 54)
    assert analytics.total_stats(sales, "all", NOW).first().total_transactions == 4


def test_empty_totals_are_zero(spark):
    row = analytics.total_stats(spark.createDataFrame([], SALES), "day", NOW).first()
    assert tuple(row) == (0, 0, 0)


def test_unknown_period(sales):
    with pytest.raises(ValueError):
        analytics.total_stats(sales, "decade", NOW)


def test_popular_ties_go_to_the_lower_id(sales, items):
    rows = analytics.popular_items(sales, items, "all", NOW, n=2).collect()
    assert [(r.id, r.total_sold) for r in rows] == [(1, 2), (2, 2)]


def test_categories(sales, items):
    rows = analytics.category_stats(sales, items, "all", NOW).collect()
    assert [(r.category, r.total_sold) for r in rows] == [("x", 4), ("y", 2)]


def test_dynamics_grains(sales):
    assert [r.date for r in analytics.sales_dynamics(sales, "day", NOW).collect()] == ["2024-03-31 12:00", "2024-04-01 12:00"]
    assert [r.date for r in analytics.sales_dynamics(sales, "week", NOW).collect()] == ["2024-03-24", "2024-03-31", "2024-04-01"]
    year = analytics.sales_dynamics(sales, "year", NOW).collect()
    assert [(r.date, r.sales_count) for r in year] == [("2024-03", 3), ("2024-04", 1)]
    assert analytics.sales_dynamics(sales, "all", NOW).collect() == year


def test_default_clock(spark):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [sale(1, 1, now - dt.timedelta(hours=2)), sale(1, 1, now - dt.timedelta(days=3))]
    assert analytics.total_stats(spark.createDataFrame(rows, SALES), "day").first().total_transactions == 1


def test_candles_by_quarter_hour(spark):
    rows = [
        sale(1, 1, dt.datetime(2024, 3, 31, 11, 14, 59), price=10),
        sale(1, 2, dt.datetime(2024, 3, 31, 11, 15), price=11),
        sale(1, 3, dt.datetime(2024, 3, 31, 11, 29, 59), price=12),
    ]
    got = analytics.price_history(spark.createDataFrame(rows, SALES), "day", NOW).collect()
    assert [(r.date, r.avg_price, r.min_price, r.max_price, r.total_sold) for r in got] == [
        ("2024-03-31 11:00:00", 10.0, 10, 10, 1),
        ("2024-03-31 11:15:00", 11.5, 11, 12, 5),
    ]


def test_price_items_filter(sales):
    rows = analytics.daily_prices(sales, 30, NOW, item_ids=[1]).collect()
    assert [(r.item_id, r.date) for r in rows] == [(1, "2024-03-24")]


def test_users_without_holdings_stay(spark, items):
    users = spark.createDataFrame([(1, "zoe", "user"), (2, "ann", "user"), (3, "bob", "admin")], "id bigint, username string, role string")
    held = spark.createDataFrame(
        [(1, 2, 4, NOW), (1, 1, 1, NOW), (3, 77, 1, NOW)], "user_id bigint, item_id bigint, quantity bigint, purchased_at timestamp_ntz"
    )
    rows = holdings.all_users_inventory(users, held, items).collect()
    assert [(r.username, r.item_name, r.quantity) for r in rows] == [
        ("ann", None, None), ("bob", None, 1), ("zoe", "a", 1), ("zoe", "b", 4),
    ]


def test_other_party_and_history_order(spark, items):
    users = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cid")], "id bigint, username string")
    trades = spark.createDataFrame(
        [(10, 5, 1, 1, 7, 7, NOW), (11, 5, 2, 1, 7, 7, NOW), (12, 5, 3, 1, 7, 7, NOW)],
        "id bigint, offer_id bigint, item_id bigint, quantity bigint, price_per_unit bigint, total_amount bigint, transaction_date timestamp_ntz",
    )
    sides = spark.createDataFrame(
        [(10, 1, "buyer"), (10, 2, "seller"), (11, 3, "buyer"), (11, 3, "seller"), (12, 1, "seller"), (12, 3, "buyer")],
        "transaction_id bigint, user_id bigint, role string",
    )
    rows = market.trade_history(trades, sides, items, users).collect()
    got = sorted((r.user_id, r.item_name, r.type, r.other_party or "") for r in rows)
    assert got == [
        (1, "a", "purchase", "bob"), (1, "c", "sale", "cid"), (2, "a", "sale", "ann"),
        (3, "b", "purchase", ""), (3, "b", "sale", ""), (3, "c", "purchase", "ann"),
    ]
    shop = spark.createDataFrame([sale(3, 1, NOW), sale(2, 1, NOW + dt.timedelta(seconds=1))], SALES)
    newest = market.full_history(trades, sides, shop, items, users, n=2).filter("user_id = 1").collect()
    assert sorted((r.type, r.item_name) for r in newest) == [("purchase", "a"), ("shop_purchase", "b")]
    details = {r.id: (r.buyer_name, r.seller_name) for r in market.trade_details(trades, sides, items, users).collect()}
    assert details == {10: ("ann", "bob"), 11: ("cid", "cid"), 12: ("cid", "ann")}


def test_offer_filters(spark, items):
    users = spark.createDataFrame([(1, "ann"), (2, "bob")], "id bigint, username string")
    goods = items.selectExpr("*", "name AS description")
    offers = spark.createDataFrame(
        [(1, 1, 1, 1, 9, "active", NOW), (2, 2, 1, 1, 5, "active", NOW), (3, 2, 2, 1, 5, "sold", NOW), (4, 2, 2, 1, 5, "active", NOW - dt.timedelta(1))],
        "id bigint, seller_id bigint, item_id bigint, quantity bigint, price_per_unit bigint, status string, created_at timestamp_ntz",
    )
    assert [r.id for r in market.active_offers(offers, goods, users).collect()] == [4, 2, 1]
    assert [r.id for r in market.active_offers(offers, goods, users, exclude_seller=1, item_id="1").collect()] == [2]
    assert [r.id for r in market.active_offers(offers, goods, users, seller_id=1).collect()] == [1]
    with pytest.raises(ValueError):
        market.active_offers(offers, goods, users, item_id="1 OR 1=1")
