"""Dense row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeloom.plans.workspace import stored

ROW_BITS = 33


def dense_numbers(df: DataFrame, order: list[Column | str], name: str, start: int | Column = 1) -> DataFrame:
    """Add ``name`` = start, start + 1, ... in the given order.

    The rows are range-partitioned and sorted in parallel; each partition's
    first number is the count of rows before it. Only one row per partition
    passes through the offset window. The sorted rows are stored once, so the
    counts and the numbers always come from the same partitioning.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_place", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    first = start if isinstance(start, Column) else F.lit(start)
    within = F.col("_place") - F.shiftleft(F.col("_part"), ROW_BITS)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (first + F.col("_offset") + within).cast("bigint"))
        .drop("_part", "_place", "_offset")
    )
