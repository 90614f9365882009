from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tradeloom.operators import rewards

T0 = dt.datetime(2024, 1, 1, 8)
ACTIONS = "id bigint, user_id bigint, action_type string, created_at timestamp_ntz"


def test_quota_costs_and_ledger(spark):
    def at(hours):
        return T0 + dt.timedelta(hours=hours)

    actions = spark.createDataFrame(
        [
            (1, 1, "wheel", at(0)), (2, 1, "wheel", at(1)), (3, 1, "wheel", at(20)),  # one spin a day
            (4, 2, "chest", at(0)), (5, 2, "chest", at(1)),  # the second one is too dear
            (6, 3, "hunt", at(0)), (7, 3, "hunt", at(1)),  # a loss that cannot be paid
            (8, 4, "wheel", at(2)),  # spun before
            (9, 9, "chest", at(0)),
        ],
        ACTIONS,
    )
    wheel, chest = F.col("action_type") == "wheel", F.col("action_type") == "chest"
    actions = actions.withColumns(
        {
            "result": F.lit("win"),
            "reward_type": F.when(chest, "item").otherwise("coins"),
            "reward_value": F.when(wheel, 10).when(chest, 1).otherwise(-200).cast("bigint"),
        }
    )
    users = spark.createDataFrame([(1, -7), (2, 150), (3, 250), (4, 0)], "id bigint, balance bigint")
    items = spark.createDataFrame([(1, 5, 0)], "id bigint, price bigint, stock bigint")
    held = spark.createDataFrame([], "user_id bigint, item_id bigint, quantity bigint, purchased_at timestamp_ntz")
    history = spark.createDataFrame([(0, 4, "wheel", at(-1))], ACTIONS)
    log, result = rewards.play(actions, users, items, held, history)
    assert {r.id: r.reason for r in log.collect()} == {
        1: None, 2: "already_spun", 3: None, 4: None, 5: "short_balance", 6: None, 7: "short_balance", 8: "already_spun",
        9: "unknown_user",
    }
    assert {r.id: r.balance for r in result.users.collect()} == {1: 13, 2: 50, 3: 50, 4: 0}
    assert [(r.user_id, r.item_id, r.quantity, r.purchased_at) for r in result.inventory.collect()] == [(2, 1, 1, at(0))]


def test_rewards_of_unknown_items_are_refused(spark):
    log = spark.createDataFrame(
        [(1, 1, "wheel", T0, "win", "item", 7), (2, 1, "hunt", T0, "win", "coins", 5)],
        ACTIONS + ", result string, reward_type string, reward_value bigint",
    )
    users = spark.createDataFrame([(1, 0)], "id bigint, balance bigint")
    items = spark.createDataFrame([(1, 5, 0)], "id bigint, price bigint, stock bigint")
    held = spark.createDataFrame([], "user_id bigint, item_id bigint, quantity bigint, purchased_at timestamp_ntz")
    done, result = rewards.play(log, users, items, held)
    assert {r.id: r.reason for r in done.collect()} == {1: "unknown_item", 2: None}
    assert result.inventory.count() == 0
