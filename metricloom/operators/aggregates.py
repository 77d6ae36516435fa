"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numbers import ratio
from metricloom.operators.attach import null_safe_join, with_scalars, with_share
from metricloom.operators.cleaning import drop_missing
from metricloom.operators.quantiles import quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def summarise(df: DataFrame, by, dropna_keys: bool = False, **aggs: Column) -> DataFrame:
    """Several named aggregates per group; ``dropna_keys`` leaves out groups with a NULL key."""
    by = list(by)
    rows = drop_missing(df, by) if dropna_keys and by else df
    return rows.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])


def value_counts(df: DataFrame, *columns, dropna: bool = True, normalize: bool = False) -> DataFrame:
    """Rows per value (or value combination) as ``n_rows``; optionally also ``share`` of the total."""
    out = summarise(df, columns, dropna, n_rows=F.count(F.lit(1)))
    return with_share(out, "n_rows", "share") if normalize else out


def with_empty_groups(df: DataFrame, domain: DataFrame, keys, fill: dict) -> DataFrame:
    """Every key of a domain table, with fill values where the summary has no row."""
    out = null_safe_join(domain.select(*keys), df, keys, "left")
    return out.select(*keys, *[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c)
                               for c in df.columns if c not in keys])


def distinct_of(df: DataFrame, by, entity: str, **flags: Column) -> DataFrame:
    """Distinct entities per group, and how many of them ever meet each condition.

    One row per (group, entity) first, so any number of conditional distinct counts costs a
    single shuffle of distinct pairs and no row is multiplied. A group whose entities are all
    NULL stays, with zeros.
    """
    by = list(by)
    per = df.groupBy(*by, entity).agg(F.lit(1).alias("_one"), *[F.max(f.cast("int")).alias(n) for n, f in flags.items()])
    known = F.col(entity).isNotNull()
    return per.groupBy(*by).agg(
        F.count(entity).alias("entities"),
        *[F.coalesce(F.sum(F.when(known, F.col(n))), F.lit(0)).cast("bigint").alias(n) for n in flags])


def distinct_counts(df: DataFrame, by, columns, rsd: float | None = None) -> DataFrame:
    """Distinct values of several columns per group, one narrow pass each.

    A single aggregate with several distinct counts copies every row once per column before
    the first shuffle. ``rsd`` switches to sketches of that relative error, in one pass.
    """
    by = list(by)
    if rsd is not None:
        return df.groupBy(*by).agg(*[F.approx_count_distinct(c, rsd).alias(f"n_{c}") for c in columns])
    parts = [df.select(*by, c).distinct().groupBy(*by).agg(F.count(c).alias(f"n_{c}")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = null_safe_join(out, p, by) if by else with_scalars(out, p)
    return out


def period_rollup(df: DataFrame, period: Column, user: str, **sums: Column) -> DataFrame:
    """Per period: distinct users and summed measures, in one pass without a distinct count.

    Each measure must be a sum or count; it is taken per (period, user) first.
    """
    per_user = df.groupBy(period.alias("period"), user).agg(*[c.alias(n) for n, c in sums.items()])
    return per_user.groupBy("period").agg(F.count(user).alias("users"), *[F.sum(n).alias(n) for n in sums])


def describe(df: DataFrame, columns, by=(), method: str = "exact") -> DataFrame:
    """count, mean, std, min, q25, q50, q75, max for each column, overall or per group."""
    by = list(by)
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in columns]
    rows = drop_missing(df, by) if by else df
    long = rows.select(*by, F.inline(F.array(*parts)))
    keys = [*by, "column"]
    stats = long.groupBy(*keys).agg(
        F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"), F.max("_x").alias("max"))
    return null_safe_join(stats, quantiles(long, "_x", QUARTILES, keys, method=method), keys, "left")


def column_totals(df: DataFrame, columns) -> DataFrame:
    """Tall ranking of wide measures: total and number of non-zero values, in one pass."""
    one = df.agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)],
                 *[F.count_if(F.col(c) != 0).alias(f"_k{i}") for i, c in enumerate(columns)])
    parts = [F.struct(F.lit(c).alias("measure"), F.col(f"_s{i}").alias("total"), F.col(f"_k{i}").alias("non_zero"))
             for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*parts)))


def drill_down(df: DataFrame, levels, **aggs: Column) -> DataFrame:
    """Totals at every level of a hierarchy; ``level`` is how many levels are fixed (0 = all)."""
    levels = list(levels)
    depth = sum((F.lit(1) - F.grouping(c).cast("int")) for c in levels[1:]) + F.lit(1) - F.grouping(levels[0]).cast("int")
    return df.rollup(*levels).agg(depth.alias("level"), *[a.alias(n) for n, a in aggs.items()])


def share_where(condition: Column) -> Column:
    """Share of rows meeting a condition; a NULL condition counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def rate(a: Column, b: Column) -> Column:
    """Ratio of two aggregates."""
    return ratio(a, b)
