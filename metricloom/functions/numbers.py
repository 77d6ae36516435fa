"""Numeric columns: safe arithmetic, rounding rules, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.arrays import as_column


def ratio(a, b) -> Column:
    """Real division; NULL for a zero or NULL divisor (plain ``/`` raises under ANSI)."""
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))


def round_half_up(col, digits: int) -> Column:
    """SQL rounding: ties away from zero."""
    return F.round(as_column(col), digits)


def round_half_even(col, digits: int) -> Column:
    """Data-frame rounding: ties to the even neighbour."""
    return F.bround(as_column(col), digits)


def parse_number(col, type_: str = "double") -> Column:
    """Text to number: thousands commas dropped; text that is not written in digits gives NULL."""
    text = F.trim(F.replace(as_column(col), F.lit(","), F.lit("")))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast(type_))


def whole(col) -> Column:
    """Integer part, truncated towards zero; NULL for NaN and beyond the range of long."""
    return as_column(col).try_cast("bigint")


def percent_difference(a, b) -> Column:
    """100 * |a - b| / a."""
    return F.lit(100.0) * F.abs(ratio(as_column(a) - as_column(b), a))


def overage(used, included) -> Column:
    """Amount above the allowance once it is reached; unused or unknown usage gives 0."""
    u, inc = as_column(used), as_column(included)
    return F.when(u >= inc, u - inc).otherwise(F.lit(0))
