"""Date and timestamp columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.arrays import as_column
from metricloom.functions.text import label_of

# Labels of months, weekdays and seasons used in reports.
MONTH_LABELS = {1: "янв", 2: "фев", 3: "мар", 4: "апр", 5: "май", 6: "июн",
                7: "июл", 8: "авг", 9: "сен", 10: "окт", 11: "ноя", 12: "дек"}
WEEKDAY_LABELS = {0: "Monday", 1: "Tuesday", 2: "Wednesday", 3: "Thursday",
                  4: "Friday", 5: "Saturday", 6: "Sunday"}
SEASON_LABELS = {0: "зима", 1: "весна", 2: "лето", 3: "осень"}


def day(col) -> Column:
    """Calendar day of a timestamp."""
    return as_column(col).cast("date")


def month_start(col) -> Column:
    """First day of the month, as a date."""
    return F.trunc(day(col), "month")


def week_start(col) -> Column:
    """Monday of the week, as a date."""
    return F.trunc(day(col), "week")


def month_label(col) -> Column:
    """Short localised month name."""
    return label_of(F.month(as_column(col)), MONTH_LABELS)


def quarter_label(col) -> Column:
    """Quarter as ``2014-Q3``; NULL date gives NULL."""
    c = as_column(col)
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def weekday_label(col) -> Column:
    """English weekday name."""
    return label_of(F.weekday(as_column(col)), WEEKDAY_LABELS)


def is_weekend(col) -> Column:
    """Saturday or Sunday."""
    return F.weekday(as_column(col)) >= 5


def season(col) -> Column:
    """Season of the month: December to February is winter, and so on."""
    return label_of(F.floor((F.month(as_column(col)) % 12) / 3).cast("int"), SEASON_LABELS)


def days_between(later, earlier) -> Column:
    """Whole days between two dates."""
    return F.datediff(day(later), day(earlier))


def elapsed_days(later, earlier) -> Column:
    """Completed 24-hour days between two timestamps (floor, also for negative spans)."""
    micros = F.timestamp_diff("MICROSECOND", as_column(earlier), as_column(later))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def midpoint(first, last) -> Column:
    """Day halfway between two dates, rounded down."""
    return F.date_add(day(first), F.floor(days_between(last, first) / 2).cast("int"))


def parse_date(col, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to date in a fixed format; anything else gives NULL."""
    return F.try_to_date(as_column(col), fmt)


def within_days(later, earlier, limit: int) -> Column:
    """True when the span is at most ``limit`` whole days."""
    return days_between(later, earlier) <= limit


def in_days(col, first: str, last: str) -> Column:
    """True for moments from the first through the whole last day.

    Written as a half-open range on the column itself, so it can be pushed to the scan; a
    cast to date around the column could not.
    """
    c = as_column(col)
    after = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
    return (c >= F.lit(first).cast("timestamp_ntz")) & (c < after)
