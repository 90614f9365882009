"""Market offers, trades and user histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.functions.text import SHOP_PARTY, TRADE_LABELS, TRADE_OTHER, date_label, label_for
from tradeloom.plans.joins import top_per_key

HISTORY = ("user_id", "type", "date", "item_name", "quantity", "price_per_unit", "total_amount", "other_party")


def active_offers(
    offers: DataFrame,
    items: DataFrame,
    users: DataFrame,
    exclude_seller: int | None = None,
    item_id: int | str | None = None,
    seller_id: int | None = None,
) -> DataFrame:
    """Open offers with item and seller names, cheapest and then oldest first.

    All filters apply to the offers before any join.
    """
    open_offers = offers.filter(F.col("status") == "active")
    if exclude_seller is not None:
        open_offers = open_offers.filter(F.col("seller_id") != exclude_seller)
    if item_id not in (None, ""):
        open_offers = open_offers.filter(F.col("item_id") == int(item_id))
    if seller_id is not None:
        open_offers = open_offers.filter(F.col("seller_id") == seller_id)
    goods = items.select(F.col("id").alias("_item"), "name", "description", "category")
    sellers = users.select(F.col("id").alias("_seller"), F.col("username").alias("seller_name"))
    return (
        open_offers.join(goods, F.col("item_id") == F.col("_item"))
        .join(sellers, F.col("seller_id") == F.col("_seller"))
        .drop("_item", "_seller")
        .orderBy("price_per_unit", "created_at", "id")
    )


def trade_details(trades: DataFrame, participants: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Trades with buyer and seller turned into columns.

    One join to the users serves both roles; the roles are then picked by
    conditional maxima per trade.
    """
    people = users.select(F.col("id").alias("_user"), "username")
    named = participants.select("transaction_id", "user_id", "role").join(
        people, F.col("user_id") == F.col("_user"), "left"
    )

    def of(role: str, column: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(column)))

    sides = named.groupBy("transaction_id").agg(
        of("buyer", "user_id").alias("buyer_id"),
        of("buyer", "username").alias("buyer_name"),
        of("seller", "user_id").alias("seller_id"),
        of("seller", "username").alias("seller_name"),
    )
    goods = items.select(F.col("id").alias("_item"), F.col("name").alias("item_name"))
    return (
        trades.join(sides, F.col("id") == F.col("transaction_id"))
        .join(goods, F.col("item_id") == F.col("_item"))
        .select(
            "id", "offer_id", "item_id", "item_name", "quantity", "price_per_unit", "total_amount",
            "transaction_date", "buyer_id", "buyer_name", "seller_id", "seller_name",
        )
    )


def _trade_rows(trades: DataFrame, participants: DataFrame) -> DataFrame:
    """One row per trade and participant with the id of the other party.

    The other party is the participant with the lowest id, or the highest one
    for the lowest: two mergeable extremes per trade instead of pairs.
    """
    ends = participants.groupBy(F.col("transaction_id").alias("_trade")).agg(
        F.min("user_id").alias("low"), F.max("user_id").alias("high")
    )
    user = F.col("user_id")
    other = F.when(user != F.col("low"), F.col("low")).when(user != F.col("high"), F.col("high"))
    return (
        trades.join(participants.select("transaction_id", "user_id", "role"), F.col("id") == F.col("transaction_id"))
        .join(ends, F.col("transaction_id") == F.col("_trade"))
        .select(
            "user_id",
            F.when(F.col("role") == "buyer", "purchase").otherwise("sale").alias("type"),
            F.col("transaction_date").alias("date"),
            "item_id",
            "quantity",
            "price_per_unit",
            "total_amount",
            other.alias("other_id"),
            F.col("id").alias("row_id"),
            F.lit(0).alias("source_rank"),
        )
    )


def _shop_rows(transactions: DataFrame) -> DataFrame:
    """Shop purchases in the form of trade rows."""
    nothing = F.lit(None).cast("bigint")
    return transactions.filter(F.col("transaction_type") == "purchase").select(
        "user_id",
        F.lit("shop_purchase").alias("type"),
        F.col("transaction_date").alias("date"),
        "item_id",
        "quantity",
        "price_per_unit",
        "total_amount",
        nothing.alias("other_id"),
        nothing.alias("row_id"),
        F.lit(1).alias("source_rank"),
    )


def _newest(rows: DataFrame, items: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """Each user's newest ``n`` rows of known items, by user and newest first.

    Rows of unknown items are left out before the cut; names are looked up after
    it, so that only the rows of the report meet them.
    """
    ties = ("source_rank", "row_id", "type", "item_id", "quantity", "price_per_unit", "total_amount")
    order = [F.desc("date"), *[F.asc(column) for column in ties]]
    goods = items.select(F.col("id").alias("_item"), F.col("name").alias("item_name"))
    known = rows.join(goods.select("_item"), F.col("item_id") == F.col("_item"), "left_semi")
    cut = top_per_key(known, ["user_id"], order, n)
    people = users.select(F.col("id").alias("_user"), "username")
    party = F.when(F.col("source_rank") == 1, F.lit(SHOP_PARTY)).otherwise(F.col("username"))
    return (
        cut.join(goods, F.col("item_id") == F.col("_item"))
        .join(people, F.col("other_id") == F.col("_user"), "left")
        .withColumn("other_party", party)
        .orderBy("user_id", *order)
        .select(*HISTORY)
    )


def trade_history(
    trades: DataFrame, participants: DataFrame, items: DataFrame, users: DataFrame, n: int = 50
) -> DataFrame:
    """Each user's newest ``n`` trades."""
    return _newest(_trade_rows(trades, participants), items, users, n)


def full_history(
    trades: DataFrame,
    participants: DataFrame,
    transactions: DataFrame,
    items: DataFrame,
    users: DataFrame,
    n: int = 50,
) -> DataFrame:
    """Each user's newest ``n`` market trades and shop purchases together.

    On equal times market rows come before shop rows, and then lower ids.
    """
    return _newest(_trade_rows(trades, participants).unionByName(_shop_rows(transactions)), items, users, n)


def labelled_history(history: DataFrame) -> DataFrame:
    """Display form of a history: kind and time as text."""
    return history.select(
        "user_id",
        label_for(F.col("type"), TRADE_LABELS, TRADE_OTHER).alias("type_label"),
        date_label("date").alias("date_text"),
        "item_name", "quantity", "price_per_unit", "total_amount", "other_party",
    )
