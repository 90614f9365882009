"""Inventory views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.functions.text import or_blank
from tradeloom.plans.joins import keep_all_parents

PRICED = ("id", "name", "description", "price", "category")


def inventory_detail(inventory: DataFrame, items: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Holdings with their items, each user's newest first.

    ``columns`` picks item columns; all of them by default.
    """
    picked = items.select(*(columns or items.columns))
    held = inventory.select("user_id", F.col("item_id").alias("_item"), "quantity", "purchased_at")
    return (
        held.join(picked, F.col("_item") == F.col("id"))
        .select("user_id", *picked.columns, "quantity", "purchased_at")
        .orderBy(F.asc("user_id"), F.desc("purchased_at"), F.asc("id"))
    )


def all_users_inventory(users: DataFrame, inventory: DataFrame, items: DataFrame) -> DataFrame:
    """Every user with every holding; users who hold nothing appear once."""
    goods = items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"), "category")
    held = inventory.select("user_id", F.col("item_id").alias("_item"), "quantity").join(
        goods, F.col("_item") == F.col("item_id"), "left"
    )
    people = users.select("id", "username", "role")
    return (
        keep_all_parents(people, held, "id", "user_id")
        .select("id", "username", "role", "item_id", "item_name", "category", "quantity")
        .orderBy("username", "item_name", "id", "item_id")
    )


def holdings_value(inventory: DataFrame, items: DataFrame) -> DataFrame:
    """Number of held items and their worth at shop price, per user."""
    prices = items.select("id", "price")
    return (
        inventory.join(prices, F.col("item_id") == F.col("id"))
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("item_rows"),
            F.sum(F.col("price") * F.col("quantity")).alias("total_value"),
        )
    )


def labelled_inventory(rows: DataFrame) -> DataFrame:
    """Display form of ``all_users_inventory``: dashes where a user holds nothing."""
    return rows.select(
        "id", "username", "role", *[or_blank(F.col(c)).alias(c) for c in ("item_name", "category", "quantity")]
    )
