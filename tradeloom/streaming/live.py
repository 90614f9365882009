"""Streaming forms of the sales, price, quota and counter reports.

The event time must be a TIMESTAMP for watermarks; ``with_event_time`` casts it.
Rows later than the watermark are dropped and show up in the progress metric
``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tradeloom.functions.numbers import exact_average
from tradeloom.operators.analytics import game_counters
from tradeloom.streaming.sinks import last_batch, read_batches, write_batch

COUNTERS = ["wheel_spins", "hunt_wins", "hunt_losses", "chests_opened"]


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def _window_columns(df: DataFrame, *rest: str) -> DataFrame:
    return df.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        *rest,
    )


def _hourly(sales: DataFrame, width: str, delay: str) -> DataFrame:
    bought = sales.filter(F.col("transaction_type") == "purchase")
    return (
        with_event_time(bought, "transaction_date", delay)
        .groupBy(F.window("transaction_date", width).alias("window"))
        .agg(F.count(F.lit(1)).alias("sales_count"), F.sum("total_amount").alias("total_amount"))
    )


def live_sales(sales: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Sales count and revenue per tumbling window."""
    return _window_columns(_hourly(sales, width, delay), "sales_count", "total_amount")


def live_trailing(sales: DataFrame, span: str = "24 hours", step: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Totals of the trailing span, refreshed every step.

    Rows are first summed per step; only those sums are copied into the
    overlapping windows.
    """
    steps = _hourly(sales, step, delay)
    spans = steps.groupBy(F.window(F.window_time("window"), span, step).alias("window")).agg(
        F.sum("sales_count").alias("sales_count"), F.sum("total_amount").alias("total_amount")
    )
    return _window_columns(spans, "sales_count", "total_amount")


def live_candles(prices: DataFrame, width: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Average, lowest and highest price and quantity per item and tumbling window."""
    candles = (
        with_event_time(prices, "transaction_date", delay)
        .groupBy(F.window("transaction_date", width).alias("window"), "item_id")
        .agg(
            exact_average("price_per_unit").alias("avg_price"),
            F.min("price_per_unit").alias("min_price"),
            F.max("price_per_unit").alias("max_price"),
            F.sum("quantity").alias("total_sold"),
        )
    )
    return _window_columns(candles, "item_id", "avg_price", "min_price", "max_price", "total_sold")


def daily_first(actions: DataFrame, delay: str = "1 day", salts: int | None = None) -> DataFrame:
    """One row per user and day, emitted at the first action of the day.

    Actions are first thinned out in ``salts`` parts of each user and day, as many as
    shuffle partitions by default, so that a user with a large share of them is spread
    over the tasks and only a few rows reach the final one. A stream that is
    restarted keeps the number it began with.
    """
    salts = salts or int(actions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    day = F.date_trunc("day", F.col("created_at").cast("timestamp")).alias("day")
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")
    days = actions.select("user_id", day, salt).withWatermark("day", delay)
    first = days.dropDuplicates(["user_id", "day", "salt"]).dropDuplicates(["user_id", "day"])
    return first.select("user_id", F.to_date("day").alias("day"))


def running_counters(actions: DataFrame, path: str) -> DataStreamWriter:
    """Game counters per user; each batch stores the new totals of the users it touched."""
    counters = game_counters(actions)
    return counters.writeStream.outputMode("update").foreachBatch(lambda df, batch: write_batch(df, path, batch))


def latest_counters(spark: SparkSession, path: str, snapshot: DataFrame | None = None, after: int = -1) -> DataFrame:
    """Current totals: each user's row of the highest batch, else of the compacted ``snapshot``."""
    schema = "user_id bigint, " + ", ".join(f"{name} bigint" for name in COUNTERS)
    rows = read_batches(spark, path, schema, after=after)
    if snapshot is not None:
        rows = rows.unionByName(snapshot.withColumn("batch", F.lit(after).cast("bigint")))
    newest = F.max_by(F.struct(*COUNTERS), "batch").alias("newest")
    return rows.groupBy("user_id").agg(newest).select("user_id", "newest.*")


def compact_counters(
    spark: SparkSession, path: str, target: str, snapshot: DataFrame | None = None, after: int = -1
) -> int:
    """Write the current totals as a snapshot; the number of the last batch in it."""
    last = max(after, last_batch(spark, path))
    latest_counters(spark, path, snapshot, after).write.parquet(target)
    return last


def final_watermark(events: DataFrame, column: str = "transaction_date", delay: str = "10 minutes") -> str | None:
    """Watermark of a stream after all of ``events``, in the session's time zone; None without events."""
    last = F.max(F.col(column).cast("timestamp")) - F.expr(f"INTERVAL {delay}")
    return events.agg(last.cast("timestamp_ntz").cast("string")).first()[0]


def with_last_windows(emitted: DataFrame, whole: DataFrame, watermark: str | None, *keys: str) -> DataFrame:
    """Windows a stream has emitted, and those of the ended source that it never will.

    ``whole`` is the same report over the source as a table. A window stays open
    in the stream until a later event passes its end, so those that end beyond
    the final ``watermark`` come from there; others the stream lost stay lost.
    """
    on = ["window_start", "window_end", *keys]
    open_yet = whole.where(F.col("window_end") > F.lit(watermark).cast("timestamp_ntz"))
    return emitted.unionByName(open_yet.join(emitted.select(*on), on, "left_anti").select(*emitted.columns))
