"""Text, label and semi-structured helpers built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Display labels of the stored codes and their fallbacks.
CATEGORY_LABELS = {
    "weapon": "Оружие",
    "armor": "Броня",
    "potion": "Зелья",
    "cosmetic": "Косметика",
}
RARITY_LABELS = {
    "common": "📦 Обычный",
    "rare": "🔵 Редкий",
    "epic": "🟣 Эпический",
}
RARITY_OTHER = "🟠 Легендарный"
SLOT_LABELS = {
    "weapon": "⚔️ Оружие",
    "head": "🪖 Голова",
    "body": "🛡️ Тело",
    "accessory": "💍 Аксессуар",
}
SLOT_OTHER = "📦 Другое"
ROLE_LABELS = {"admin": "Админ", "moderator": "Модератор"}
ROLE_OTHER = "Игрок"
TRADE_LABELS = {"purchase": "Покупка у игрока", "sale": "Продажа игроку"}
TRADE_OTHER = "Покупка в магазине"
DATE_UNKNOWN = "Неизвестно"
SHOP_PARTY = "Магазин"
BLANK = "-"


def contains_text(column: str, text: str) -> Column:
    """Case-insensitive literal substring test; wildcards have no meaning."""
    return F.lower(F.col(column)).contains(text.lower())


def label_for(column: Column, labels: dict[str, str], fallback: Column | str) -> Column:
    """Label of a code. ``labels`` is a handful of fixed entries, inlined as a map literal."""
    pairs = [F.lit(part) for entry in labels.items() for part in entry]
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    found = F.try_element_at(F.create_map(*pairs), column) if pairs else F.lit(None)
    return F.coalesce(found, other)


def or_blank(column: Column) -> Column:
    """Dash for a missing or empty value, and for a number that is zero."""
    text = column.cast("string")
    return F.when(text.isNull() | text.isin("", "0"), BLANK).otherwise(text)


def date_label(column: str, pattern: str = "yyyy-MM-dd HH:mm", missing: str = DATE_UNKNOWN) -> Column:
    """Formatted time, or fixed text where there is none."""
    return F.coalesce(F.date_format(column, pattern), F.lit(missing))


def preview(column: str, size: int, ellipsis: bool = False) -> Column:
    """Leading ``size`` characters for display, with dots when something was left out."""
    head = F.substring(F.col(column), 1, size)
    if not ellipsis:
        return head
    return F.when(F.length(column) > size, F.concat(head, F.lit("..."))).otherwise(F.col(column))


def json_object(column: str) -> Column:
    """JSON object text as a string map; anything unreadable is an empty map."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return F.coalesce(parsed, F.from_json(F.lit("{}"), "map<string,string>"))


def json_pairs(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per key of a JSON object column: (kept columns, stat, amount_text, amount)."""
    return df.select(*keep, F.explode(json_object(column)).alias("stat", "amount_text")).select(
        *keep, "stat", "amount_text", F.expr("try_cast(amount_text AS BIGINT)").alias("amount")
    )
