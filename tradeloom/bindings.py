"""Logical tables over the star-schema Parquet files used by tests and benchmarks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom.functions.numbers import floor_ratio, whole_units

HOUR_CYCLE = 8760


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def latest(df: DataFrame, column: str) -> dt.datetime:
    """Newest time in a table: one aggregated value, read from one column."""
    return df.agg(F.max(column)).first()[0]


def _coded(column: str, names: dict[str, str], other: Column | None = None) -> Column:
    """Code translated by nested conditions; Spark turns a test on the first name into a test on its code."""
    result = F.lit(None).cast("string") if other is None else other
    for code, name in reversed(names.items()):
        result = F.when(F.col(column).eqNullSafe(code), name).otherwise(result)
    return result


def _since_2024(key: str) -> Column:
    hours = (F.col(key) % HOUR_CYCLE).cast("int")
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=hours)


def items(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_name", F.lit("from"), "p_brand", F.lit("made as a"), "p_type", F.lit("piece for the shop")).alias("description"),
        whole_units("p_retailprice").alias("price"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("rarity"),
        F.col("p_size").alias("level_required"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("slot"),
        F.lit(100).alias("durability"),
        F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit("}")).alias("bonus_stats"),
        (F.col("p_size") % 8).cast("bigint").alias("stock"),
        F.lit("").alias("image_url"),
        _since_2024("p_partkey").alias("created_at"),
    )


def users(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("role"),
        whole_units("c_acctbal").alias("balance"),
        _since_2024("c_custkey").alias("created_at"),
    )


def _lines(spark: SparkSession, root: str) -> DataFrame:
    amount = whole_units("l_extendedprice")
    quantity = F.col("l_quantity").cast("bigint")
    kind = _coded("l_returnflag", {"N": "purchase", "R": "sale", "A": "admin_grant"})
    return read(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item_id"),
        quantity.alias("quantity"),
        kind.alias("transaction_type"),
        amount.alias("total_amount"),
        F.col("l_shipdate").alias("transaction_date"),
    ).withColumn("price_per_unit", floor_ratio("total_amount", "quantity"))


def transactions(spark: SparkSession, root: str, with_user: bool = True) -> DataFrame:
    """Shop log. Without the user no join is needed. Rows carry no unique id."""
    lines = _lines(spark, root)
    if not with_user:
        return lines.drop("order_id")
    owners = read(spark, root, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id")
    )
    return lines.join(owners, "order_id").select(
        "user_id", "item_id", "quantity", "transaction_type", "price_per_unit", "total_amount", "transaction_date"
    )


def order_lines(spark: SparkSession, root: str) -> DataFrame:
    """Orders with the sums of their lines: the common part of offers, trades and participants."""
    totals = (
        read(spark, root, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_partkey").alias("item_id"),
            F.sum("l_quantity").cast("bigint").alias("quantity"),
            F.sum(whole_units("l_extendedprice")).alias("total_amount"),
            F.min("l_suppkey").alias("supplier_id"),
        )
    )
    orders = read(spark, root, "orders")
    return orders.join(totals, orders.o_orderkey == totals.l_orderkey).drop("l_orderkey")


def offers(spark: SparkSession, root: str, lines: DataFrame | None = None) -> DataFrame:
    status = _coded("o_orderstatus", {"O": "active", "F": "sold"}, F.lit("cancelled"))
    return (order_lines(spark, root) if lines is None else lines).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("seller_id"),
        "item_id",
        "quantity",
        whole_units("o_totalprice").alias("price_per_unit"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def trades(spark: SparkSession, root: str, lines: DataFrame | None = None) -> DataFrame:
    return (order_lines(spark, root) if lines is None else lines).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("offer_id"),
        "item_id",
        "quantity",
        floor_ratio("total_amount", "quantity").alias("price_per_unit"),
        "total_amount",
        F.col("o_orderdate").alias("transaction_date"),
    )


def participants(spark: SparkSession, root: str, lines: DataFrame | None = None) -> DataFrame:
    sides = F.explode(
        F.array(
            F.struct(F.col("o_custkey").alias("user_id"), F.lit("buyer").alias("role")),
            F.struct(F.col("supplier_id").alias("user_id"), F.lit("seller").alias("role")),
        )
    )
    return (
        (order_lines(spark, root) if lines is None else lines)
        .select(F.col("o_orderkey").alias("transaction_id"), sides.alias("side"))
        .select("transaction_id", "side.user_id", "side.role")
    )


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Holdings: all granted lines, one row per user and item."""
    return (
        transactions(spark, root)
        .filter(F.col("transaction_type") == "admin_grant")
        .groupBy("user_id", "item_id")
        .agg(F.sum("quantity").alias("quantity"), F.min("transaction_date").alias("purchased_at"))
    )


def game_stats_of(events: DataFrame) -> DataFrame:
    """Events as game log rows."""
    action = _coded("event_type", {"signup": "wheel", "click": "hunt", "purchase": "chest"}, F.col("event_type"))
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        action.alias("action_type"),
        F.when(F.col("value") >= 20, "win").otherwise("lose").alias("result"),
        F.lit("coins").alias("reward_type"),
        F.col("value").cast("bigint").alias("reward_value"),
        F.col("ts").alias("created_at"),
    )


def event_prices_of(events: DataFrame) -> DataFrame:
    """Events as intraday prices: the event type plays the item, the value the price."""
    return events.select(
        F.col("event_type").alias("item_id"),
        whole_units("value").alias("price_per_unit"),
        F.lit(1).cast("bigint").alias("quantity"),
        F.col("ts").alias("transaction_date"),
    )


def event_sales_of(events: DataFrame) -> DataFrame:
    """Events as a sales log with time of day."""
    return events.select(
        "user_id",
        F.col("event_type").alias("transaction_type"),
        F.lit(1).cast("bigint").alias("quantity"),
        whole_units("value").alias("total_amount"),
        F.col("ts").alias("transaction_date"),
    )


def game_stats(spark: SparkSession, root: str) -> DataFrame:
    return game_stats_of(read(spark, root, "events"))


def event_prices(spark: SparkSession, root: str) -> DataFrame:
    return event_prices_of(read(spark, root, "events"))


def event_sales(spark: SparkSession, root: str) -> DataFrame:
    return event_sales_of(read(spark, root, "events"))
