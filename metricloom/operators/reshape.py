"""Wide to tall, tall to wide, stacking."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, index, column: str, values, agg: Column, fill=None) -> DataFrame:
    """One row per index, one column per listed value (listing them saves a pass over the data)."""
    out = df.groupBy(*(index if isinstance(index, (list, tuple)) else [index])).pivot(column, list(values)).agg(agg)
    return out if fill is None else out.fillna(fill, subset=[str(v) for v in values])


def crosstab(df: DataFrame, row: str, column: str, values) -> DataFrame:
    """Counts of every combination, absent ones as 0."""
    return pivot(df, row, column, values, F.count(F.lit(1)), fill=0)


def stack_columns(df: DataFrame, columns, name: str = "column", value: str = "value", ids=()) -> DataFrame:
    """Several like-typed columns become (name, value) rows."""
    return df.unpivot(list(ids), list(columns), name, value)


def stack_tagged(frames: dict, tag: str) -> DataFrame:
    """Aligned results under one another, each row tagged with its origin."""
    return reduce(DataFrame.unionByName, [d.withColumn(tag, F.lit(n)) for n, d in frames.items()])


def columns_like(df: DataFrame, pattern: str) -> list:
    """Sorted names of the columns whose name matches a pattern."""
    return sorted(c for c in df.columns if re.search(pattern, c))


def zip_lists(df: DataFrame, **arrays) -> DataFrame:
    """Parallel arrays become rows, one per position; names give the output columns."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return df.select(F.explode(zipped).alias("_z")).select(
        *[F.col("_z")[n].alias(n) for n in arrays])
