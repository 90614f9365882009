"""Batch-numbered folders: a repeated micro-batch replaces its own output and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(
    spark: SparkSession, path: str, schema: str, before: int | None = None, after: int = -1
) -> DataFrame:
    """All rows with their ``batch``; only batches above ``after`` and below ``before`` when it is given.

    The batch is a folder, so other batches are not read.
    """
    if before is not None and before <= after + 1:
        return spark.createDataFrame([], f"{schema}, batch bigint")
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path).filter(F.col("batch") > after)
    return rows if before is None else rows.filter(F.col("batch") < before)


def last_batch(spark: SparkSession, path: str) -> int:
    """Highest batch that has rows."""
    found = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    return -1 if found is None else int(found)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything the source holds now, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
