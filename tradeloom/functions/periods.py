"""Trailing periods and time buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# Length in days of each named period.
PERIOD_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}

# Bucket width used for each named period.
SALES_GRAIN = {"day": "hour", "week": "day", "month": "day", "year": "month"}
PRICE_GRAIN = {"day": "quarter_hour", "week": "day", "month": "day", "year": "month"}

# Text form of a bucket.
LABEL_FORMAT = {
    "quarter_hour": "yyyy-MM-dd HH:mm:00",
    "hour": "yyyy-MM-dd HH:00",
    "day": "yyyy-MM-dd",
    "month": "yyyy-MM",
}


def period_days(period: str) -> int | None:
    """Days in a named period; None for ``'all'``; an unknown name is an error."""
    if period == "all":
        return None
    if period not in PERIOD_DAYS:
        raise ValueError(f"unknown period {period!r}; expected one of {['all', *PERIOD_DAYS]}")
    return PERIOD_DAYS[period]


def dynamics_period(period: str) -> str:
    """Bucketed reports treat ``'all'`` as the year view."""
    return "year" if period_days(period) is None else period


def trailing(df: DataFrame, column: str, days: int | None, as_of: dt.datetime | None) -> DataFrame:
    """Rows no older than ``days`` before ``as_of``: inclusive, without an upper bound.

    A given ``as_of`` becomes a literal of the column's own type, so that the
    bound reaches the scan and can skip files and row groups.
    """
    if days is None:
        return df
    kind = df.schema[column].dataType
    if as_of is None:
        bound = (F.localtimestamp() - F.expr(f"INTERVAL {int(days)} DAY")).cast(kind)
    else:
        bound = F.lit(str(as_of - dt.timedelta(days=days))).cast(kind)
    return df.filter(F.col(column) >= bound)


def bucket(column: str, grain: str) -> Column:
    """Bucket start as a compact value; format it with ``label`` after grouping."""
    ts = F.col(column)
    if grain == "quarter_hour":
        return F.window(ts, "15 minutes")["start"]
    if grain == "hour":
        return F.date_trunc("hour", ts)
    if grain == "day":
        return F.to_date(ts)
    if grain == "month":
        return F.trunc(F.to_date(ts), "month")
    raise ValueError(f"unknown grain {grain!r}")


def label(column: str, grain: str) -> Column:
    """Text label of a bucket start."""
    return F.date_format(F.col(column), LABEL_FORMAT[grain])
