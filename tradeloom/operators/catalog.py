"""Item catalog, searches, lookups and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.functions.text import (
    BLANK,
    CATEGORY_LABELS,
    RARITY_LABELS,
    RARITY_OTHER,
    ROLE_LABELS,
    ROLE_OTHER,
    SLOT_LABELS,
    SLOT_OTHER,
    contains_text,
    label_for,
    preview,
)

BROWSE_SORTS = ("price", "name", "created_at")
SEARCH_SORTS = ("name", "price", "level_required")
QUICK_SORTS = ("name", "price")
USER_COLUMNS = ("id", "username", "role", "balance", "created_at")


def _sorted(df: DataFrame, sort_by: str | None, order: str, allowed: tuple[str, ...], key: Column | None = None) -> DataFrame:
    """Sort by an allowed column, then by id; any other column name leaves the rows unsorted."""
    if sort_by not in allowed:
        return df
    direction = order.lower()
    if direction not in ("asc", "desc"):
        raise ValueError(f"order must be asc or desc, not {order!r}")
    key = F.col(sort_by) if key is None else key
    return df.orderBy(key.asc() if direction == "asc" else key.desc(), F.asc("id"))


def _availability(choice: str | None) -> list[Column]:
    if choice == "in_stock":
        return [F.col("stock") > 0]
    if choice == "out_stock":
        return [F.col("stock") == 0]
    return []


def _where(df: DataFrame, tests: list[Column]) -> DataFrame:
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def browse(
    items: DataFrame,
    category: str | None = None,
    availability: str = "all",
    sort_by: str | None = "name",
    order: str = "asc",
    show_out_of_stock: bool = True,
) -> DataFrame:
    """Catalog page: optional category and availability, whitelisted sort."""
    tests = [F.col("category") == category] if category else []
    if not show_out_of_stock:
        tests.append(F.col("stock") > 0)
    return _sorted(_where(items, tests + _availability(availability)), sort_by, order, BROWSE_SORTS)


def quick_search(
    items: DataFrame,
    text: str = "",
    category: str | None = None,
    availability: str = "all",
    sort_by: str = "name",
    order: str = "asc",
) -> DataFrame:
    """Substring search on the name; names sort without regard to case."""
    tests = [F.col("category") == category] if category else []
    if text.strip():
        tests.append(contains_text("name", text.strip()))
    key = F.lower("name") if sort_by == "name" else None
    return _sorted(_where(items, tests + _availability(availability)), sort_by, order, QUICK_SORTS, key)


def advanced_search(
    items: DataFrame,
    name: str | None = None,
    category: str | None = None,
    rarity: str | None = None,
    slot: str | None = None,
    price_min: int | None = None,
    price_max: int | None = None,
    level_min: int | None = None,
    level_max: int | None = None,
    availability: str | None = None,
    sort_by: str = "name",
    order: str = "asc",
) -> DataFrame:
    """Conjunction of the given filters; an unset filter is ``None`` or empty text, 0 is a bound."""
    tests = [contains_text("name", name)] if name else []
    for column, wanted in (("category", category), ("rarity", rarity), ("slot", slot)):
        if wanted:
            tests.append(F.col(column) == wanted)
    for column, low, high in (("price", price_min, price_max), ("level_required", level_min, level_max)):
        if low not in (None, ""):
            tests.append(F.col(column) >= low)
        if high not in (None, ""):
            tests.append(F.col(column) <= high)
    return _sorted(_where(items, tests + _availability(availability)), sort_by, order, SEARCH_SORTS)


def stock_bands(items: DataFrame, threshold: int = 5) -> DataFrame:
    """All items by id with a stock band: out, low or ok."""
    band = F.when(F.col("stock") == 0, "out").when(F.col("stock") <= threshold, "low").otherwise("ok")
    return items.withColumn("stock_status", band).orderBy("id")


def low_stock(items: DataFrame, threshold: int = 5) -> DataFrame:
    """Items that are nearly sold out."""
    return items.filter((F.col("stock") > 0) & (F.col("stock") <= threshold))


def out_of_stock(items: DataFrame) -> DataFrame:
    """Items waiting for delivery."""
    return items.filter(F.col("stock") == 0)


def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a table whose key appears in a table of ids.

    The ids are made distinct first: a semi join cannot split a key that is
    repeated in its right side.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias("_wanted")).distinct()
    return table.join(wanted, F.col(key) == F.col("_wanted"), "left_semi")


def balances(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Balance per requested user id, 0 for an unknown one."""
    wanted = ids.select(F.col(ids.columns[0]).alias("user_id"))
    known = users.select(F.col("id").alias("user_id"), "balance")
    return wanted.join(known, "user_id", "left").select("user_id", F.coalesce("balance", F.lit(0)).alias("balance"))


def list_users(users: DataFrame, sort_by: str | None = "id") -> DataFrame:
    """Users without secrets, by id, by username or unordered."""
    return _sorted(users.select(*USER_COLUMNS), sort_by, "asc", ("id", "username"))


def pick_list(items: DataFrame) -> DataFrame:
    """Item choices by name."""
    return items.select("id", "name", "category").orderBy("name", "id")


def labelled(
    items: DataFrame,
    categories: dict[str, str] = CATEGORY_LABELS,
    rarities: dict[str, str] = RARITY_LABELS,
    rarity_other: str = RARITY_OTHER,
    slots: dict[str, str] = SLOT_LABELS,
    slot_other: str = SLOT_OTHER,
) -> DataFrame:
    """Display form of items: labels with fallbacks and shortened descriptions."""
    return items.select(
        "id",
        "name",
        label_for(F.col("category"), categories, F.coalesce("category", F.lit(BLANK))).alias("category_label"),
        label_for(F.col("rarity"), rarities, rarity_other).alias("rarity_label"),
        label_for(F.col("slot"), slots, slot_other).alias("slot_label"),
        preview("description", 60).alias("card_text"),
        preview("description", 50, ellipsis=True).alias("short_text"),
    )


def labelled_users(users: DataFrame, roles: dict[str, str] = ROLE_LABELS, role_other: str = ROLE_OTHER) -> DataFrame:
    """Display form of users: role labels with a fallback."""
    return users.select("id", "username", label_for(F.col("role"), roles, role_other).alias("role_label"), "balance")
