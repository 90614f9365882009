"""Wall-clock time of the headline queries on the benchmark tables.

Prints one JSON line. Each query is run once to warm up and then twice more;
its figure is the median of those. All rows are computed and counted.

Environment: BENCH_SF_DIR (folder of Parquet tables), BENCH_CPUS (cores),
BENCH_QUERIES (comma-separated names, default: the headline queries).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from registry.queries import QUERIES  # noqa: E402

HEADLINE = [
    "advanced_search",
    "stock_bands",
    "inventory_detail",
    "all_users_inventory",
    "active_offers",
    "trade_details",
    "trade_history",
    "full_history",
    "total_stats",
    "popular_items",
    "category_stats",
    "sales_dynamics_year",
    "price_history_year",
    "price_candles_15m",
    "game_stats",
    "db_summary",
    "constraint_audit",
    "upsert_inventory",
    "patch_items",
    "ledger_fold",
    "stream_candles",
]
# Replays run many jobs each and are measured once after the warm-up of the others.
ONCE = ["replay_purchases", "replay_market", "stream_balance_guard"]


def run(spark: SparkSession, name: str, root: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else [*HEADLINE, *ONCE]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        if name in ONCE:
            seconds[name] = round(run(spark, name, root), 3)
            continue
        run(spark, name, root)
        seconds[name] = round(statistics.median(run(spark, name, root) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(root).name.removeprefix("sf"),
                "cpus": int(cpus),
                "shuffle_partitions": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
