"""Exports: sorted by id across the part files of one folder, written in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.plans.numbering import dense_numbers

# Fixed value: text form of a stored time.
STORED_TIME = "yyyy-MM-dd HH:mm:ss"


def _time_text(column: str) -> Column:
    return F.date_format(column, STORED_TIME)


def item_export(items: DataFrame) -> DataFrame:
    """All item columns with times as text, by id."""
    return items.withColumn("created_at", _time_text("created_at")).orderBy("id")


def user_export(users: DataFrame) -> DataFrame:
    """Users without passwords, blank text where there is no time, by id."""
    created = F.coalesce(_time_text("created_at"), F.lit("")).alias("created_at")
    return users.select("id", "username", "role", "balance", created).orderBy("id")


def export_items(items: DataFrame, path: str) -> None:
    """JSON Lines, nulls kept, text unescaped."""
    item_export(items).write.option("ignoreNullFields", False).json(path)


def export_array(rows: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array over the part files of a folder: by name and one after the other they are its text.

    Rows are numbered in the given order by a sort over all tasks; the first opens the array, the last
    closes it, and each other one begins with a comma. No rows are an empty array.
    """
    spark = rows.sparkSession
    numbered = dense_numbers(rows, order, "_number")
    count = numbered.count()
    if not count:
        spark.range(1).select(F.lit("[]").alias("value")).coalesce(1).write.text(path)
        return
    element = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    text = F.concat(
        F.when(F.col("_number") == 1, "[").otherwise(","), element, F.when(F.col("_number") == count, "]").otherwise("")
    )
    ordered = numbered.select("_number", text.alias("value")).repartitionByRange("_number").sortWithinPartitions("_number")
    ordered.select("value").write.text(path)


def export_users(users: DataFrame, path: str) -> None:
    """CSV with a header in every part file."""
    user_export(users).write.option("header", True).option("emptyValue", "").csv(path)
