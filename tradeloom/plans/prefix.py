"""Running sums per key that no single task has to compute for a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 16


def hot_buckets(df: DataFrame, keys: list[str], rows: int) -> list[int]:
    """Hash buckets of keys with more than ``rows`` rows; no key outside of them has more.

    Every task counts per bucket before the shuffle. The list has less than one number per ``rows`` rows.
    """
    sizes = df.groupBy(F.expr(f"pmod(hash({', '.join(keys)}), {BUCKETS})").alias("bucket")).count()
    return [row.bucket for row in sizes.filter(F.col("count") > int(rows)).select("bucket").collect()]


def running_before(
    df: DataFrame, keys: list[str], order: str, values: list[str], block_rows: int, hot: list[int] | None = None
) -> DataFrame:
    """Add ``before_<value>``: the sum over rows of the same key with a smaller ``order``.

    Keys of at most ``block_rows`` rows are summed by one shuffle. ``hot`` names the buckets of all others (found
    here when it is not given), whose order is cut in blocks.
    """
    by = ", ".join(keys)
    if hot is None:
        hot = hot_buckets(df, keys, block_rows)
    if not hot:
        return _summed(df, by, order, values)
    inside = F.expr(f"pmod(hash({by}), {BUCKETS})").isin(hot)
    return _summed(df.filter(~inside), by, order, values).unionAll(
        _summed_in_blocks(df.filter(inside), keys, order, values, block_rows)
    )


EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _summed(df: DataFrame, by: str, order: str, values: list[str]) -> DataFrame:
    return df.selectExpr(
        "*",
        *[f"coalesce(sum({v}) OVER (PARTITION BY {by} ORDER BY {order} {EARLIER}), 0) AS before_{v}" for v in values],
    )


def _summed_in_blocks(df: DataFrame, keys: list[str], order: str, values: list[str], block_rows: int) -> DataFrame:
    """``order`` is a dense number, so cutting it every ``block_rows`` bounds the
    rows of one key and block. Sums run inside blocks; block totals (one row per
    key and block) give each block's start.
    """
    by = ", ".join(keys)
    blocked = df.selectExpr("*", f"greatest({order}, 0) div {int(block_rows)} AS _block")
    rows = blocked.selectExpr(
        "*",
        *[
            f"coalesce(sum({v}) OVER (PARTITION BY {by}, _block ORDER BY {order} {EARLIER}), 0) AS before_{v}"
            for v in values
        ],
    )
    totals = blocked.groupBy(*keys, "_block").agg({v: "sum" for v in values})
    starts = totals.selectExpr(
        *keys,
        "_block",
        *[
            f"coalesce(sum(`sum({v})`) OVER (PARTITION BY {by} ORDER BY _block {EARLIER}), 0) AS _start_{v}"
            for v in values
        ],
    )
    joined = rows.join(starts, [*keys, "_block"])
    return joined.selectExpr(*df.columns, *[f"before_{v} + _start_{v} AS before_{v}" for v in values])
