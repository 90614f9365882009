from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from tradeloom.plans.workspace import CLEANUP, stored


def test_stored_leaves_no_shuffle_files(spark):
    folders = [Path(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for folder in folders for f in folder.rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(CLEANUP, None)
    sums = spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.sum("id").alias("s"))
    table = stored(sums.join(spark.range(60_000).withColumnRenamed("id", "k").repartition(8, "k"), "k"), "sums")
    assert table.count() == 50_000
    left = {f for f in files() - before if f.stat().st_size > 10_000}
    assert not left and spark.conf.get(CLEANUP, None) == setting
