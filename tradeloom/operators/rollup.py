"""One mergeable rollup of sales and prices per item and quarter of an hour, and the reports read from it.

Counts, sums, least and greatest values of parts add up to those of the whole, so the same rollup is kept by
batches and by streams, and folded to hours, days and months. A trailing report begins in the midst of
a quarter of an hour; the rows of that one come from the facts, all others from the rollup.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from tradeloom.functions.periods import PRICE_GRAIN, SALES_GRAIN, bucket, dynamics_period, label, period_days, trailing
from tradeloom.sources.versions import VersionedTable

KEY = ["item_id", "start"]
SUMS = ["rows", "price_sum", "quantity", "sales_count", "sales_amount"]
FINEST = dt.timedelta(minutes=15)


def _merge(names: dict[str, Column | str]) -> list[Column]:
    sums = [F.sum(names[name]).cast("bigint").alias(name) for name in SUMS]
    return [*sums, F.min(names["min_price"]).alias("min_price"), F.max(names["max_price"]).alias("max_price")]


def rolled_up(facts: DataFrame) -> DataFrame:
    """The rollup of (item_id, transaction_date, price_per_unit, quantity[, transaction_type, total_amount])."""
    bought = F.col("transaction_type") == "purchase" if "transaction_type" in facts.columns else F.lit(False)
    amount = F.col("total_amount") if "total_amount" in facts.columns else F.lit(0)
    price = F.col("price_per_unit")
    measures = {
        "rows": F.lit(1), "price_sum": price, "quantity": F.col("quantity"), "sales_count": bought.cast("int"),
        "sales_amount": F.when(bought, amount).otherwise(0), "min_price": price, "max_price": price,
    }
    start = bucket("transaction_date", "quarter_hour").cast("timestamp_ntz")
    return facts.groupBy("item_id", start.alias("start")).agg(*_merge(measures))


def merged(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Two rollups as one."""
    both = rows.unionByName(more.select(*rows.columns))
    return both.groupBy(*KEY).agg(*_merge({name: name for name in [*SUMS, "min_price", "max_price"]}))


def rollup_table(spark: SparkSession, path: str, facts: DataFrame, **options) -> VersionedTable:
    """The rollup of facts of this shape, kept in versions; additions are rollups of further facts."""
    schema = T.StructType([*rolled_up(facts).schema.fields])
    return VersionedTable(spark, path, schema, KEY, merged, schema, **options)


def keep_rollup(facts: DataFrame, table: VersionedTable) -> DataStreamWriter:
    """A stream of facts into the versioned rollup that exists."""
    return facts.writeStream.foreachBatch(lambda df, batch: table.add(rolled_up(df), batch))


def _recent(rollup: DataFrame, facts: DataFrame | None, days: int | None, as_of: dt.datetime | None) -> DataFrame:
    """The rollup of a trailing period: whole quarters from the rollup, the first part of one from the facts."""
    if days is None:
        return rollup
    since = (as_of or dt.datetime.now()) - dt.timedelta(days=days)
    midnight = since.replace(hour=0, minute=0, second=0, microsecond=0)
    whole = midnight - FINEST * ((midnight - since) // FINEST)
    kept = trailing(rollup, "start", 0, whole)
    if facts is None or whole == since:
        return kept
    edge = trailing(facts, "transaction_date", 0, since).filter(F.col("transaction_date") < F.lit(str(whole)).cast("timestamp_ntz"))
    return kept.unionByName(rolled_up(edge).select(*kept.columns))


def sales_dynamics(
    rollup: DataFrame, period: str = "week", as_of: dt.datetime | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """Sales count and revenue per hour, day or month of a trailing period."""
    period = dynamics_period(period)
    grain = SALES_GRAIN[period]
    return (
        _recent(rollup, facts, period_days(period), as_of)
        .groupBy(bucket("start", grain).alias("date"))
        .agg(F.sum("sales_count").alias("sales_count"), F.sum("sales_amount").alias("total_amount"))
        .filter("sales_count > 0")
        .orderBy("date")
        .withColumn("date", label("date", grain))
    )


def price_history(
    rollup: DataFrame, period: str = "week", as_of: dt.datetime | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """Price buckets per item: 15 minutes, days or months by period."""
    period = dynamics_period(period)
    grain = PRICE_GRAIN[period]
    return (
        _recent(rollup, facts, period_days(period), as_of)
        .groupBy("item_id", bucket("start", grain).alias("date"))
        .agg(
            F.round(F.sum("price_sum") / F.sum("rows"), 4).alias("avg_price"),
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
            F.sum("quantity").alias("total_sold"),
        )
        .orderBy("item_id", "date")
        .withColumn("date", label("date", grain))
    )
