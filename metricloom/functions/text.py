"""Text columns: normalising, matching, labelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.arrays import as_column


def collapse_spaces(col) -> Column:
    """Runs of spaces become one space."""
    return F.regexp_replace(as_column(col), " +", " ")


def lower_trim(col) -> Column:
    """Lower case without spaces at the ends."""
    return F.trim(F.lower(as_column(col)))


def capitalise(col) -> Column:
    """First letter upper, everything after it lower (``initcap`` would raise every word)."""
    c = as_column(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def clean_name(col) -> Column:
    """Display form of a name: capitalised first, then trimmed, then single-spaced."""
    return collapse_spaces(F.trim(capitalise(col)))


def clean_address(col) -> Column:
    """Comparison form of an address: lower case, trimmed, single-spaced."""
    return collapse_spaces(lower_trim(col))


def contains_any(col, patterns) -> Column:
    """1 when the text holds one of the literal patterns, else 0; NULL text gives 0."""
    c = as_column(col)
    hit = reduce(lambda a, b: a | b, [c.contains(p) for p in patterns])
    return F.coalesce(hit.cast("int"), F.lit(0))


def label_of(col, labels: dict, default=None) -> Column:
    """Replace a code by its label from a small fixed dictionary; others get ``default``."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), as_column(col))
    return found if default is None else F.coalesce(found, F.lit(default))
