"""Percentile limits and interquartile fences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.operators.aggregates import share_where
from metricloom.operators.attach import attached, scalar_of, with_scalars
from metricloom.operators.ordering import top_k
from metricloom.operators.quantiles import quantile_table, quantiles


def percentile_limits(df: DataFrame, columns, low: float = 0.01, high: float = 0.99, method: str = "exact") -> DataFrame:
    """One row holding ``<column>_low`` and ``<column>_high``, values taken from the data."""
    tall = quantile_table(df, columns, {"lo": low, "hi": high}, kind="discrete", method=method)
    pick = lambda c, side: F.max(F.when(F.col("column") == c, F.col(side)))
    return tall.agg(*[pick(c, s).alias(f"{c}_{n}") for c in columns for s, n in (("lo", "low"), ("hi", "high"))])


def within_limits(df: DataFrame, limits: DataFrame, below_high=(), above_low=(), null_passes=()) -> DataFrame:
    """Rows strictly inside one-row limits; columns in ``null_passes`` may also be NULL."""
    lim = F.col("_lim")
    tests = {c: F.col(c) < lim[f"{c}_high"] for c in below_high}
    for c in above_low:
        above = F.col(c) > lim[f"{c}_low"]
        tests[c] = tests[c] & above if c in tests else above
    keep = [t | F.col(c).isNull() if c in null_passes else t for c, t in tests.items()]
    return df.withColumn("_lim", scalar_of(limits)).filter(reduce(lambda a, b: a & b, keep)).drop("_lim")


def iqr_fences(df: DataFrame, value: str, by=(), reach: float = 1.5, min_rows: int = 4) -> DataFrame:
    """Lower and upper fence per group; groups under ``min_rows`` values have none."""
    by = list(by)
    q = quantiles(df, value, {"_q1": 0.25, "_q3": 0.75}, by, count="_n")
    iqr = F.col("_q3") - F.col("_q1")
    return q.filter(F.col("_n") >= min_rows).select(
        *by, (F.col("_q1") - reach * iqr).alias("lower"), (F.col("_q3") + reach * iqr).alias("upper"))


def flag_outliers(df: DataFrame, value: str, by=(), name: str = "is_outlier", **fences) -> DataFrame:
    """Every row with a flag; rows without a value or without fences are not outliers."""
    limits = iqr_fences(df, value, by, **fences)
    joined = attached(df, limits, by, "left") if by else with_scalars(df, limits)
    outside = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return joined.withColumn(name, F.coalesce(outside, F.lit(False))).select(*df.columns, name)


def outlier_share(df: DataFrame, value: str, by, **fences) -> DataFrame:
    """Per group: rows with a value, outliers among them, percent."""
    flagged = flag_outliers(df.filter(F.col(value).isNotNull()), value, by, **fences)
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_outlier").alias("n_outliers"),
        (share_where(F.col("is_outlier")) * 100).alias("outlier_percent"))


def top_outlier_shares(df: DataFrame, value: str, by, k: int = 20, **fences) -> DataFrame:
    """The groups with the largest percent of outliers, with their ``position``; ties by the group's own order."""
    by = list(by)
    top = top_k(outlier_share(df, value, by, **fences).filter(F.col("n_outliers") > 0), k, "-outlier_percent", *by)
    order = Window.orderBy(F.desc("outlier_percent"), *by)             # at most ``k`` rows
    return top.withColumn("position", F.row_number().over(order))


def trim_upper(df: DataFrame, value: str, by, high: float = 0.99) -> DataFrame:
    """Negative values go, then everything above the group's quantile of the rest."""
    valid = df.filter(F.col(value) >= 0)
    limits = quantiles(valid, value, {"_limit": high}, by)
    return attached(valid, limits, by).filter(F.col(value) <= F.col("_limit")).select(*df.columns)


def blank_outliers(df: DataFrame, value: str, by, **fences) -> DataFrame:
    """Outliers become NULL; rows stay."""
    flagged = flag_outliers(df, value, by, "_out", **{"min_rows": 1, **fences})
    return flagged.withColumn(value, F.when(~F.col("_out"), F.col(value))).select(*df.columns)


def keep_large_groups(df: DataFrame, key: str, total: Column, at_least=None, share: float | None = None) -> DataFrame:
    """Rows of the keys whose total (a sum or count) reaches a minimum, or a share of all keys' totals."""
    keys = df.groupBy(key).agg(total.alias("_t"))
    least = F.lit(at_least) if share is None else keys.agg(F.sum("_t")).scalar() * F.lit(share)
    return df.join(keys.filter(F.col("_t") >= least).select(key), key, "left_semi")
