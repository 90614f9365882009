"""Schemas, column defaults and integrity rules of the logical tables.

Money is held in whole minor units (bigint) so that sums never depend on the
order in which partitions are added up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONG, INT, TEXT, TIME = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(id=LONG, username=TEXT, role=TEXT, balance=LONG, created_at=TIME),
    "items": _schema(
        id=LONG, name=TEXT, description=TEXT, price=LONG, category=TEXT, rarity=TEXT,
        level_required=INT, slot=TEXT, durability=INT, bonus_stats=TEXT, stock=LONG,
        image_url=TEXT, created_at=TIME,
    ),
    "inventory": _schema(id=LONG, user_id=LONG, item_id=LONG, quantity=LONG, purchased_at=TIME),
    "transactions": _schema(
        id=LONG, user_id=LONG, item_id=LONG, quantity=LONG, transaction_type=TEXT,
        price_per_unit=LONG, total_amount=LONG, transaction_date=TIME,
    ),
    "offers": _schema(
        id=LONG, seller_id=LONG, item_id=LONG, quantity=LONG, price_per_unit=LONG,
        status=TEXT, created_at=TIME, sold_at=TIME,
    ),
    "trades": _schema(
        id=LONG, offer_id=LONG, item_id=LONG, quantity=LONG, price_per_unit=LONG,
        total_amount=LONG, transaction_date=TIME,
    ),
    "participants": _schema(id=LONG, transaction_id=LONG, user_id=LONG, role=TEXT),
    "game_stats": _schema(
        id=LONG, user_id=LONG, action_type=TEXT, result=TEXT, reward_type=TEXT,
        reward_value=LONG, created_at=TIME,
    ),
}

# Column defaults of the data model.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"role": "user", "balance": 1000},
    "items": {
        "rarity": "common", "level_required": 1, "slot": "other", "durability": 100, "stock": 0,
    },
    "inventory": {"quantity": 1},
    "transactions": {},
    "offers": {"status": "active"},
    "trades": {},
    "participants": {},
    "game_stats": {},
}


@dataclass(frozen=True)
class Rules:
    """Integrity rules of one table; every row that breaks one is a violation."""

    key: str = "id"
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    at_least: dict[str, int] = field(default_factory=dict)
    one_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    longest: dict[str, int] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)


RULES: dict[str, Rules] = {
    "users": Rules(not_null=("username",), unique=(("username",),), longest={"username": 100, "role": 50}),
    "items": Rules(
        not_null=("name", "price", "stock"),
        at_least={"price": 0, "stock": 0},
        longest={"name": 200, "category": 50, "rarity": 50, "slot": 50, "image_url": 500},
    ),
    "inventory": Rules(
        not_null=("user_id", "item_id"),
        unique=(("user_id", "item_id"),),
        at_least={"quantity": 1},
        parents={"user_id": "users", "item_id": "items"},
    ),
    "transactions": Rules(
        not_null=("user_id", "item_id", "quantity", "transaction_type"),
        one_of={"transaction_type": ("purchase", "sale", "admin_grant", "admin_remove")},
        parents={"user_id": "users", "item_id": "items"},
    ),
    "offers": Rules(
        not_null=("seller_id", "item_id", "quantity", "price_per_unit"),
        at_least={"quantity": 1, "price_per_unit": 0},
        one_of={"status": ("active", "sold", "cancelled")},
        parents={"seller_id": "users", "item_id": "items"},
    ),
    "trades": Rules(
        not_null=("offer_id", "item_id", "quantity", "price_per_unit", "total_amount"),
        parents={"offer_id": "offers", "item_id": "items"},
    ),
    "participants": Rules(
        not_null=("transaction_id", "user_id", "role"),
        unique=(("transaction_id", "user_id"),),
        one_of={"role": ("buyer", "seller")},
        parents={"transaction_id": "trades", "user_id": "users"},
    ),
    "game_stats": Rules(not_null=("user_id", "action_type"), parents={"user_id": "users"}),
}
