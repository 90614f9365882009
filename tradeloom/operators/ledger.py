"""Folding logs into account movements and comparing them with snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: price of one chest.
CHEST_COST = 100

ACCOUNT = ["account", "user_id", "item_id"]


def _entry(account: str, user: Column | None, item: Column | None, amount: Column) -> Column:
    empty = F.lit(None).cast("bigint")
    return F.struct(
        F.lit(account).alias("account"),
        (empty if user is None else user).alias("user_id"),
        (empty if item is None else item).alias("item_id"),
        amount.cast("bigint").alias("amount"),
    )


def _entries(df: DataFrame, entries: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*").filter(F.col("amount") != 0)


def shop_entries(transactions: DataFrame) -> DataFrame:
    """Balance, stock and holding movements of the shop log."""
    kind, user, item = F.col("transaction_type"), F.col("user_id"), F.col("item_id")
    paid = F.when(kind == "purchase", -F.col("total_amount")).when(kind == "sale", F.col("total_amount")).otherwise(0)
    taken = F.when(kind == "purchase", -F.col("quantity")).when(kind.isin("sale", "admin_remove"), F.col("quantity"))
    held = F.when(kind.isin("purchase", "admin_grant"), F.col("quantity")).otherwise(-F.col("quantity"))
    return _entries(
        transactions,
        [
            _entry("balance", user, None, paid),
            _entry("stock", None, item, taken.otherwise(0)),
            _entry("holding", user, item, held),
        ],
    )


def trade_entries(trades: DataFrame, participants: DataFrame) -> DataFrame:
    """Balance and holding movements of both sides; see ``offer_entries`` for goods not sold yet."""
    sides = participants.select("transaction_id", "user_id", "role")
    joined = trades.join(sides, F.col("id") == F.col("transaction_id"))
    buyer = F.col("role") == "buyer"
    return _entries(
        joined,
        [
            _entry("balance", F.col("user_id"), None, F.when(buyer, -F.col("total_amount")).otherwise(F.col("total_amount"))),
            _entry("holding", F.col("user_id"), F.col("item_id"), F.when(buyer, F.col("quantity")).otherwise(-F.col("quantity"))),
        ],
    )


def offer_entries(offers: DataFrame) -> DataFrame:
    """Goods still in escrow: what open offers took out of their sellers' holdings."""
    listed = offers.filter(F.col("status") == "active")
    return _entries(listed, [_entry("holding", F.col("seller_id"), F.col("item_id"), -F.col("quantity"))])


def reward_entries(game_stats: DataFrame) -> DataFrame:
    """Coins, items and chest prices of the game log."""
    user, value = F.col("user_id"), F.col("reward_value")
    coins = F.when(F.col("reward_type") == "coins", value).otherwise(0)
    price = F.when(F.col("action_type") == "chest", CHEST_COST).otherwise(0)
    return _entries(
        game_stats,
        [
            _entry("balance", user, None, coins - price),
            _entry("holding", user, value, F.when(F.col("reward_type") == "item", 1).otherwise(0)),
        ],
    )


def fold(*entries: DataFrame) -> DataFrame:
    """Net movement per account; partial sums meet before the shuffle."""
    return reduce(DataFrame.unionByName, entries).groupBy(*ACCOUNT).agg(F.sum("amount").alias("amount"))


def snapshot_entries(users: DataFrame, items: DataFrame, inventory: DataFrame) -> DataFrame:
    """A snapshot in the form of account amounts."""
    return reduce(
        DataFrame.unionByName,
        [
            users.select(_entry("balance", F.col("id"), None, F.col("balance")).alias("entry")).select("entry.*"),
            items.select(_entry("stock", None, F.col("id"), F.col("stock")).alias("entry")).select("entry.*"),
            inventory.select(
                _entry("holding", F.col("user_id"), F.col("item_id"), F.col("quantity")).alias("entry")
            ).select("entry.*"),
        ],
    )


def reconcile(opening: DataFrame, movements: DataFrame, closing: DataFrame) -> DataFrame:
    """Accounts whose closing amount is not opening plus movements: (account, ..., expected, actual)."""
    expected, actual = F.lit(1), F.lit(0)
    both = reduce(
        DataFrame.unionByName,
        [
            opening.withColumn("side", expected),
            movements.withColumn("side", expected),
            closing.withColumn("side", actual),
        ],
    )
    sums = both.groupBy(*ACCOUNT).agg(
        F.sum(F.when(F.col("side") == 1, F.col("amount")).otherwise(0)).alias("expected"),
        F.sum(F.when(F.col("side") == 0, F.col("amount")).otherwise(0)).alias("actual"),
    )
    return sums.filter(F.col("expected") != F.col("actual"))
