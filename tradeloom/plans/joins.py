"""Join and ranking shapes that stay balanced when one key holds a large share of the rows.

No side is force-broadcast: Spark's size check (``autoBroadcastJoinThreshold``,
from statistics before and from shuffle sizes during the run) decides, and a
sort-merge join with skewed partitions split by AQE is the way beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_all_parents(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Left join of a unique parent table to a many-rows-per-key child table.

    A left outer join cannot split a hot key on its right side. The inner part
    can, and the parents without children come from an anti join against keys
    that were made distinct before the shuffle.
    """
    matched = parents.join(children, parents[key] == children[child_key], "inner")
    present = children.select(F.col(child_key).alias("_present")).distinct()
    alone = parents.join(present, parents[key] == present["_present"], "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each key.

    Up to Spark's limit for it (``spark.sql.optimizer.windowGroupLimitThreshold``), every task
    cuts its own rows of a key to ``n`` before the one shuffle. Beyond that, rows are ranked
    within salted parts of a key first, so that a hot key never arrives whole in one
    task; there are as many parts as shuffle partitions.
    """
    conf = df.sparkSession.conf
    whole = Window.partitionBy(*keys).orderBy(*order)
    if n > int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        salts = int(conf.get("spark.sql.shuffle.partitions"))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= n).drop("_salt", "_rank")
    return df.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n).drop("_rank")
