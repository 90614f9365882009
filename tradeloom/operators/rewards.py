"""Logged game rewards: the daily quota, what an action costs, and its effect on balances and holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.operators.ledger import CHEST_COST
from tradeloom.operators.replay import REWARD, Replay, number_requests, replay


def first_spins(log: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Ids of the wheel spins that are each user's first of a calendar day.

    ``history`` holds earlier log rows; a day with a logged spin has none left.
    """
    day = F.to_date("created_at").alias("day")
    spins = log.filter(F.col("action_type") == "wheel").select("user_id", day, "created_at", "id")
    first = spins.groupBy("user_id", "day").agg(F.min(F.struct("created_at", "id")).alias("first"))
    if history is not None:
        used = history.filter(F.col("action_type") == "wheel").select("user_id", day).distinct()
        first = first.join(used, ["user_id", "day"], "left_anti")
    return first.select("first.id")


def play(
    log: DataFrame, users: DataFrame, items: DataFrame, inventory: DataFrame, history: DataFrame | None = None, **options
) -> tuple[DataFrame, Replay]:
    """(every logged action with accepted and reason, the replay behind it).

    ``log`` has the outcome of each action: coins (reward_type, reward_value) or
    the id of an item.

    Spins beyond the daily quota are refused before any money moves. A chest
    needs its price, a lost hunt needs the loss; coins and items are then booked
    in the order of the actions. Rows with ``accepted`` are the new log rows.
    """
    allowed = first_spins(log, history).withColumn("first", F.lit(True))
    marked = log.join(allowed, "id", "left").withColumn(
        "over_quota", (F.col("action_type") == "wheel") & F.col("first").isNull()
    )
    played = number_requests(marked.filter(~F.col("over_quota")).drop("first", "over_quota"), ["created_at", "id"])
    coins = F.when(F.col("reward_type") == "coins", F.col("reward_value")).otherwise(0)
    chest = F.col("action_type") == "chest"
    requests = played.select(
        "seq",
        F.lit(REWARD).alias("kind"),
        "user_id",
        F.when(F.col("reward_type") == "item", F.col("reward_value")).alias("item_id"),
        F.when(chest, CHEST_COST).when(coins < 0, F.abs(coins)).otherwise(0).alias("need"),
        (coins - F.when(chest, CHEST_COST).otherwise(0)).alias("coins"),
        F.col("created_at").alias("at"),
    )
    no_offers = log.sparkSession.createDataFrame(
        [], "id bigint, seller_id bigint, item_id bigint, price_per_unit bigint, quantity bigint, status string, created_at timestamp_ntz"
    )
    result = replay(requests, users, items, inventory, no_offers, **options)
    columns = ["id", "user_id", "action_type", "created_at", "result", "reward_type", "reward_value"]
    settled = played.join(result.decisions.select("seq", "accepted", "reason"), "seq").select(*columns, "accepted", "reason")
    refused = marked.filter("over_quota").select(
        *columns, F.lit(False).alias("accepted"), F.lit("already_spun").alias("reason")
    )
    return settled.unionByName(refused), result
