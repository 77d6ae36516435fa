"""Array and map columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(col) -> Column:
    """A column from its name, or the column itself."""
    return F.col(col) if isinstance(col, str) else col


def lists_to_map(keys, values, sep: str = ",") -> Column:
    """Two delimited strings of equal length become one map."""
    return F.map_from_arrays(F.split(as_column(keys), sep), F.split(as_column(values), sep))


def rename_key(col, old: str, new: str) -> Column:
    """The same map with one key renamed."""
    return F.transform_keys(as_column(col), lambda k, v: F.when(k == old, F.lit(new)).otherwise(k))


def keys_with_value(col, value) -> Column:
    """Sorted keys of a map whose value equals ``value``."""
    return F.array_sort(F.map_keys(F.map_filter(as_column(col), lambda k, v: v == value)))


def count_above(col, threshold) -> Column:
    """Number of array elements strictly above the threshold."""
    return F.size(F.filter(as_column(col), lambda x: x > threshold))


def share_above(col, threshold) -> Column:
    """Share of array elements strictly above the threshold; NULL for an empty array."""
    return F.try_divide(count_above(col, threshold), F.size(as_column(col)))
