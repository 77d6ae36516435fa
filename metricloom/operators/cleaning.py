"""Preparing raw tables: headers, missing values, duplicates, types."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from metricloom.operators.attach import null_safe_join, with_scalars
from metricloom.operators.ordering import arg_max


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trimmed lower-case column names with underscores for spaces."""
    return df.toDF(*[re.sub(" ", "_", c.strip().lower()) for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL, the only missing value used by the operators."""
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def any_missing(columns) -> Column:
    """True when at least one of the columns is NULL."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def drop_missing(df: DataFrame, columns) -> DataFrame:
    """Rows with a value in every listed column."""
    return df.dropna(subset=list(columns))


def fill_missing(df: DataFrame, values: dict) -> DataFrame:
    """NULL replaced by a constant or sentinel per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def fill_from(df: DataFrame, column: str, expression: Column) -> DataFrame:
    """NULL replaced by an expression over the same row (NULL again if a part is NULL)."""
    return df.withColumn(column, F.coalesce(F.col(column), expression))


def group_mode(df: DataFrame, column: str, by=()) -> DataFrame:
    """Most frequent value per key, smallest value on ties; NULL is not a value."""
    counts = (df.filter(F.col(column).isNotNull()).groupBy(*by, column)
              .agg(F.count(F.lit(1)).alias("_k")))
    return arg_max(counts, column, "_k", by).drop("_k")


def fill_with_group_mode(df: DataFrame, column: str, by) -> DataFrame:
    """NULL replaced by the most frequent value of the row's group; stays NULL if it has none."""
    modes = group_mode(df, column, by).withColumnRenamed(column, "_mode")
    out = null_safe_join(df, modes, by, "left")
    return out.withColumn(column, F.coalesce(column, "_mode")).select(*df.columns)


def fill_with_mode(df: DataFrame, column: str, missing: Column | None = None) -> DataFrame:
    """Missing values replaced by the most frequent value of the whole column."""
    missing = F.col(column).isNull() if missing is None else missing
    mode = group_mode(df.filter(~missing), column).withColumnRenamed(column, "_mode")
    out = with_scalars(df, mode)
    return out.withColumn(column, F.when(missing, F.col("_mode")).otherwise(F.col(column))).select(*df.columns)


def fill_with_group_mean(df: DataFrame, column: str, by) -> DataFrame:
    """NULL replaced by the mean of the row's group."""
    means = df.groupBy(*by).agg(F.avg(column).alias("_mean"))
    out = null_safe_join(df, means, by, "left")
    return out.withColumn(column, F.coalesce(column, "_mean")).select(*df.columns)


def keep_one(df: DataFrame, subset, order, keep: str = "first") -> DataFrame:
    """One row per distinct ``subset``: the first or last in an explicit order; NULL is the least value.

    Two phases. The best value of the leading order column, a number or a time, is a hash aggregate that combines
    map-side; a semi join leaves the rows that have it, one for most keys. Only these are put in order, by the rest of
    the order and then the other columns, and every map task passes on one row of a key: a value with very many
    copies never meets in one task. A leading column of another type is ordered in the second phase.
    """
    subset, order = list(subset), list(order)
    lead, rows = order[0], df
    fixed = (NumericType, DateType, TimestampType, TimestampNTZType, BooleanType)
    if isinstance(df.schema[lead].dataType, fixed):
        best = df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in subset]).agg(
            (F.min(lead) if keep == "first" else F.max(lead)).alias("_best"), F.bool_or(F.col(lead).isNull()).alias("_null"))
        best = best.withColumn("_best", F.when(~F.col("_null"), F.col("_best"))).drop("_null") if keep == "first" else best.drop("_null")
        same = [df[c].eqNullSafe(best[f"_k_{c}"]) for c in subset] + [df[lead].eqNullSafe(best["_best"])]
        rows = df.join(best, reduce(lambda x, y: x & y, same), "left_semi")
    rest = [*order, *[c for c in df.columns if c not in subset and c not in order], *subset]
    columns = [F.asc_nulls_first(c) if keep == "first" else F.desc_nulls_last(c) for c in rest]
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*subset).orderBy(*columns)))
    return ranked.filter("_rn = 1").drop("_rn")


def merge_near_duplicates(df: DataFrame, key, measures) -> DataFrame:
    """Rows equal on ``key`` become one with summed measures and the smallest of the rest."""
    key, measures = list(key), list(measures)
    rest = [c for c in df.columns if c not in key and c not in measures]
    out = df.groupBy(*key).agg(*[F.sum(m).alias(m) for m in measures], *[F.min(c).alias(c) for c in rest])
    return out.select(*df.columns)


INT_WIDTHS = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31))   # fixed: signed ranges


def narrowest_types(df: DataFrame, columns) -> DataFrame:
    """Smallest whole-number type that holds each column's range: (column, min, max, type)."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"_lo_{c}").alias("min_value"),
                      F.col(f"_hi_{c}").alias("max_value")) for c in columns]
    edges = df.agg(*[F.min(c).cast("bigint").alias(f"_lo_{c}") for c in columns],
                   *[F.max(c).cast("bigint").alias(f"_hi_{c}") for c in columns])
    long = edges.select(F.inline(F.array(*parts)))
    fit = F.lit("bigint")
    for name, bound in reversed(INT_WIDTHS):
        fit = F.when((F.col("min_value") >= -bound) & (F.col("max_value") < bound), F.lit(name)).otherwise(fit)
    return long.withColumn("fits_type", fit)
