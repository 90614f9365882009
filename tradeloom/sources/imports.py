"""Validated imports. Good rows and rejected rows together are the whole input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom.sources.ranges import array_elements, csv_fields
from tradeloom.tables import RULES

# Fields of an imported item and the value of an absent one.
ITEM_FIELDS: dict[str, object] = {
    "name": "",
    "description": "",
    "price": 0,
    "category": "other",
    "rarity": "common",
    "level_required": 1,
    "slot": "other",
    "durability": 100,
    "bonus_stats": "{}",
    "stock": 0,
    "image_url": "",
}
# Role and balance of an imported user whose file lacks the column.
USER_FIELDS: dict[str, object] = {"role": "user", "balance": 1000}

WIDE = {"price", "stock"}


def _first_reason(reasons: list[tuple[Column, str]]) -> Column:
    """Name of the first failed check, null when all pass."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for failed, name in reasons])


def _too_long(table: str) -> Column:
    tests = [F.length(column) > size for column, size in RULES[table].longest.items()]
    return F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), tests), F.lit(False))


def _whole(text: Column, kind: str) -> Column:
    """Whole number in a text, rounding a fraction; null when there is none."""
    return F.round(text.try_cast("decimal(30,6)")).try_cast(kind)


def read_item_objects(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """Raw item objects as string maps: (source, position, object); a null object is unreadable.

    ``array`` is one JSON array per file, read in ranges by many tasks. Its
    elements are read one by one, so a bad one is a reject of its own; a file
    that is no array is one reject, an empty array none.
    ``parts`` is one array over the part files of a folder, as ``export_array`` writes it.
    ``lines`` is one object per line.
    """
    if layout in ("array", "parts"):
        elements = array_elements(spark, path, as_one=layout == "parts")
        return elements.select("source", "position", F.from_json("element", "map<string,string>").alias("object"))
    if layout == "lines":
        lines = spark.read.text(path).filter(F.trim("value") != "")
        return lines.select(
            F.col("_metadata.file_path").alias("source"),
            F.monotonically_increasing_id().alias("position"),
            F.from_json("value", "map<string,string>").alias("object"),
        )
    raise ValueError(f"unknown layout {layout!r}")


def import_items(spark: SparkSession, path: str, layout: str = "array") -> tuple[DataFrame, DataFrame]:
    """(accepted items, rejected rows with a reason).

    A default stands in for an absent key only; an explicit null stays null and
    is refused where the column needs a value.
    """
    rows = read_item_objects(spark, path, layout)

    def value(name: str, default: object) -> Column:
        given = F.map_contains_key("object", name)
        return F.when(given, F.try_element_at("object", F.lit(name))).otherwise(F.lit(str(default)))

    texts = rows.select(
        "source", "position", F.col("object").isNull().alias("unreadable"),
        *[value(name, default).alias(name) for name, default in ITEM_FIELDS.items()],
    )
    numbers = [name for name, default in ITEM_FIELDS.items() if isinstance(default, int)]
    typed = texts.select(
        "*", *[_whole(F.col(name), "bigint" if name in WIDE else "int").alias(f"{name}_number") for name in numbers]
    )
    rules = RULES["items"]
    reasons = [(F.col("unreadable"), "unreadable")]
    reasons += [(F.col(name).isNull(), f"missing_{name}") for name in rules.not_null]
    reasons += [
        (F.col(name).isNotNull() & F.col(f"{name}_number").isNull(), f"not_a_number_{name}") for name in numbers
    ]
    reasons += [(F.col(f"{name}_number") < low, f"negative_{name}") for name, low in rules.at_least.items()]
    reasons += [(_too_long("items"), "too_long")]
    checked = typed.withColumn("reason", _first_reason(reasons))
    accepted = checked.filter(F.col("reason").isNull()).select(
        *[F.col(f"{name}_number").alias(name) if name in numbers else F.col(name) for name in ITEM_FIELDS]
    )
    rejected = checked.filter(F.col("reason").isNotNull()).select("source", "position", "name", "reason")
    return accepted, rejected


def _raw_users(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """User rows of CSV files: (position, closed, username, role, balance), defaults for columns a file lacks."""
    raw = csv_fields(spark, path, ["username", "role", "balance"])

    def text(name: str) -> Column:
        return F.when(F.col(f"has_{name}"), F.coalesce(name, F.lit(""))).otherwise(F.lit(str(USER_FIELDS.get(name, ""))))

    return raw.select(
        F.struct("file", "range", "piece").alias("position"),
        "closed",
        F.trim(text("username")).alias("username"),
        text("role").alias("role"),
        text("balance").try_cast("bigint").alias("balance"),
    )


def import_users(spark: SparkSession, path: str | list[str], existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted users, rejected rows with a reason) from headed CSV files.

    Files may have different headers: each is read by its own. Fields in quotes
    may hold line breaks. Names are
    compared without regard to case and outer blanks. The first usable row of a
    name wins, in file order; it is found by a mergeable minimum, so a name
    repeated in any share of the rows never gathers in one task. Passwords are
    not read.
    """
    raw = _raw_users(spark, path)
    rows = raw.withColumn(
        "reason",
        _first_reason(
            [
                (~F.col("closed"), "unclosed_quote"),
                (F.col("balance").isNull(), "bad_balance"),
                (F.col("username") == "", "blank_username"),
                (_too_long("users"), "too_long"),
            ]
        ),
    )
    usable = rows.filter(F.col("reason").isNull()).withColumn("name_key", F.lower("username"))
    firsts = (
        usable.groupBy("name_key")
        .agg(F.min(F.struct("position", "username", "role", "balance")).alias("first"))
        .select("name_key", "first.*")
    )
    stored = existing.select(F.lower(F.trim("username")).alias("name_key")).distinct()
    accepted = firsts.join(stored, "name_key", "left_anti")
    taken = usable.join(accepted.select("position"), "position", "left_anti")
    columns = [F.col("position.file").alias("source"), "username", "reason"]
    rejected = (
        rows.filter(F.col("reason").isNotNull())
        .select(*columns)
        .unionByName(taken.withColumn("reason", F.lit("username_exists")).select(*columns))
    )
    return accepted.select("username", "role", "balance"), rejected
