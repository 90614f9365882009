"""Sales and price statistics over whole logs.

Facts are summed per key before they meet a dimension, so the shuffle carries
one row per key and map task however unevenly the keys are spread.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tradeloom.functions.numbers import exact_average, total
from tradeloom.functions.periods import (
    PRICE_GRAIN,
    SALES_GRAIN,
    bucket,
    dynamics_period,
    label,
    period_days,
    trailing,
)


def _purchases(transactions: DataFrame, period: str, as_of: dt.datetime | None) -> DataFrame:
    bought = transactions.filter(F.col("transaction_type") == "purchase")
    return trailing(bought, "transaction_date", period_days(period), as_of)


def _sold_per_item(transactions: DataFrame, items: DataFrame, period: str, as_of: dt.datetime | None) -> DataFrame:
    sold = _purchases(transactions, period, as_of).groupBy("item_id").agg(F.sum("quantity").alias("total_sold"))
    return sold.join(items.select("id", "name", "category"), F.col("item_id") == F.col("id"))


def total_stats(transactions: DataFrame, period: str = "all", as_of: dt.datetime | None = None) -> DataFrame:
    """Count, quantity and revenue of purchases; sums are 0 over no rows."""
    return _purchases(transactions, period, as_of).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        total("quantity").alias("total_items_sold"),
        total("total_amount").alias("total_revenue"),
    )


def popular_items(
    transactions: DataFrame, items: DataFrame, period: str = "all", as_of: dt.datetime | None = None, n: int = 10
) -> DataFrame:
    """Best-selling items; ties go to the lower id."""
    return (
        _sold_per_item(transactions, items, period, as_of)
        .select("id", "name", "category", "total_sold")
        .orderBy(F.desc("total_sold"), F.asc("id"))
        .limit(n)
    )


def category_stats(
    transactions: DataFrame, items: DataFrame, period: str = "all", as_of: dt.datetime | None = None
) -> DataFrame:
    """Quantity sold per category, largest first."""
    return (
        _sold_per_item(transactions, items, period, as_of)
        .groupBy("category")
        .agg(F.sum("total_sold").alias("total_sold"))
        .orderBy(F.desc("total_sold"), F.asc("category"))
    )


def sales_dynamics(transactions: DataFrame, period: str = "week", as_of: dt.datetime | None = None) -> DataFrame:
    """Sales count and revenue per hour, day or month of a trailing period."""
    period = dynamics_period(period)
    grain = SALES_GRAIN[period]
    return (
        _purchases(transactions, period, as_of)
        .groupBy(bucket("transaction_date", grain).alias("date"))
        .agg(F.count(F.lit(1)).alias("sales_count"), F.sum("total_amount").alias("total_amount"))
        .orderBy("date")
        .withColumn("date", label("date", grain))
    )


def _prices(trades: DataFrame, grain: str) -> DataFrame:
    return (
        trades.groupBy("item_id", bucket("transaction_date", grain).alias("date"))
        .agg(
            exact_average("price_per_unit").alias("avg_price"),
            F.min("price_per_unit").alias("min_price"),
            F.max("price_per_unit").alias("max_price"),
            F.sum("quantity").alias("total_sold"),
        )
        .orderBy("item_id", "date")
        .withColumn("date", label("date", grain))
    )


def _of_items(trades: DataFrame, item_ids: list | None) -> DataFrame:
    return trades if item_ids is None else trades.filter(F.col("item_id").isin(*item_ids))


def daily_prices(
    trades: DataFrame, days: int = 30, as_of: dt.datetime | None = None, item_ids: list | None = None
) -> DataFrame:
    """Daily average, lowest and highest price and quantity per item over the last ``days``."""
    return _prices(trailing(_of_items(trades, item_ids), "transaction_date", days, as_of), "day")


def price_history(
    trades: DataFrame, period: str = "week", as_of: dt.datetime | None = None, item_ids: list | None = None
) -> DataFrame:
    """Price buckets per item: 15 minutes, days or months by period."""
    period = dynamics_period(period)
    recent = trailing(_of_items(trades, item_ids), "transaction_date", period_days(period), as_of)
    return _prices(recent, PRICE_GRAIN[period])


def candles(trades: DataFrame) -> DataFrame:
    """All 15-minute price buckets per item."""
    return _prices(trades, "quarter_hour")


def game_counters(game_stats: DataFrame) -> DataFrame:
    """Wheel spins, hunts won and lost, and chests opened per user."""
    hunt = F.col("action_type") == "hunt"
    return game_stats.groupBy("user_id").agg(
        F.count_if(F.col("action_type") == "wheel").alias("wheel_spins"),
        F.count_if(hunt & (F.col("result") == "win")).alias("hunt_wins"),
        F.count_if(hunt & (F.col("result") == "lose")).alias("hunt_losses"),
        F.count_if(F.col("action_type") == "chest").alias("chests_opened"),
    )


def daily_actions(game_stats: DataFrame) -> DataFrame:
    """Number of actions per user, kind and calendar day."""
    return game_stats.groupBy("user_id", "action_type", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("actions")
    )


def database_summary(
    users: DataFrame,
    items: DataFrame,
    inventory: DataFrame,
    transactions: DataFrame,
    offers: DataFrame,
    trades: DataFrame,
    game_stats: DataFrame,
) -> DataFrame:
    """One (metric, value) row per headline figure."""
    rows = F.count(F.lit(1))
    figures = [
        ("users", users.agg(rows)),
        ("items", items.agg(rows)),
        ("transactions", transactions.agg(rows)),
        ("active_offers", offers.filter(F.col("status") == "active").agg(rows)),
        ("trades", trades.agg(rows)),
        ("game_events", game_stats.agg(rows)),
        ("items_held", inventory.agg(total("quantity"))),
        ("player_balance", users.filter(F.col("role") != "admin").agg(total("balance"))),
    ]
    parts = [df.toDF("value").select(F.lit(metric).alias("metric"), "value") for metric, df in figures]
    return reduce(DataFrame.unionAll, parts)


def dashboard_counts(users: DataFrame, items: DataFrame) -> DataFrame:
    """Users, items and items out of stock."""
    people = users.agg(F.count(F.lit(1)).alias("users"))
    goods = items.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("stock") == 0).alias("out_of_stock"))
    columns = [("users", people, "users"), ("items", goods, "items"), ("out_of_stock", goods, "out_of_stock")]
    return reduce(
        DataFrame.unionAll,
        [df.select(F.lit(metric).alias("metric"), F.col(column).alias("value")) for metric, df, column in columns],
    )
