"""Exact arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole_units(column: str) -> Column:
    """A two-decimal amount as whole minor units."""
    return F.round(F.col(column) * 100).cast("bigint")


def exact_average(column: str, digits: int = 4) -> Column:
    """Average from an exact integer sum, so partition order cannot change it."""
    return F.round(F.sum(column) / F.count(column), digits)


def total(column: str) -> Column:
    """Sum that is 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def half_price(price: str) -> Column:
    """Price paid by the shop for a returned item: half, rounded down."""
    return F.expr(f"({price} - pmod({price}, 2)) div 2")


def floor_ratio(total: str, count: str) -> Column:
    """Whole-number quotient of two non-negative integer columns."""
    return F.expr(f"{total} div {count}")


def try_int(text: str) -> Column:
    """Whole number in a text column, null where it is none."""
    return F.expr(f"try_cast({text} AS BIGINT)")
