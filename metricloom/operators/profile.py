"""The numbers behind distribution charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.numbers import ratio
from metricloom.operators.aggregates import QUARTILES, with_empty_groups
from metricloom.operators.attach import attached, with_scalars
from metricloom.operators.quantiles import quantiles


def _bin_index(x: Column, low: Column, width: Column, bins) -> Column:
    return F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor(ratio(x - low, width)), bins - 1)).cast("bigint")


def histogram(df: DataFrame, value: str, bins: int | None = None, by=(), empty: bool = True) -> DataFrame:
    """Equal-width bins over the whole range, the last one closed on the right.

    ``bins=None`` uses one bin per unit of the range (for whole-number columns). Without
    ``by`` empty bins are kept; ``empty=False`` leaves them out, for units over a wide range.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    raw = rows.agg(F.min("_x").alias("_lo0"), F.max("_x").alias("_hi0"))
    flat = F.col("_lo0") == F.col("_hi0")
    edges = raw.select(F.when(flat, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
                       F.when(flat, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    count = F.lit(bins) if bins else F.greatest((F.col("_hi") - F.col("_lo")).cast("bigint"), F.lit(1))
    edges = edges.select("_lo", ((F.col("_hi") - F.col("_lo")) / count).alias("_w"), count.cast("bigint").alias("_bins"))
    binned = with_scalars(rows, edges).withColumn("bin", _bin_index(F.col("_x"), F.col("_lo"), F.col("_w"), F.col("_bins")))
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n_rows"))
    if not by and empty:
        step = 1 << 16                                  # two short sequences instead of one as long as the range
        coarse = edges.select("_bins", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_bins") - 1, F.lit(step).cast("bigint"))).alias("_at"))
        domain = coarse.select(F.explode(F.sequence("_at", F.least(F.col("_at") + (step - 1), F.col("_bins") - 1))).alias("bin"))
        counts = with_empty_groups(counts, domain, ["bin"], {"n_rows": 0})
    out = with_scalars(counts, edges)
    left = F.col("_lo") + F.col("bin") * F.col("_w")
    return out.select(*by, "bin", left.alias("bin_left"), (left + F.col("_w")).alias("bin_right"), "n_rows")


def log_histogram(df: DataFrame, value: str, edges: int = 30, low_exponent: float = 0.1) -> DataFrame:
    """Bins of equal width in log10 from ``10**low_exponent`` to the maximum, with density."""
    rows = df.filter(F.col(value) > 0).select(F.log10(F.col(value).cast("double")).alias("_x"))
    bins = edges - 1
    top = rows.agg(F.max("_x").alias("_hi")).select(((F.col("_hi") - low_exponent) / bins).alias("_w"))
    inside = with_scalars(rows.filter(F.col("_x") >= low_exponent), top)
    counts = (inside.withColumn("bin", _bin_index(F.col("_x"), F.lit(low_exponent), F.col("_w"), F.lit(bins)))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows")))
    domain = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    full = with_scalars(with_empty_groups(counts, domain, ["bin"], {"n_rows": 0}), top)
    full = with_scalars(full, counts.agg(F.sum("n_rows").alias("_n")))
    left = F.pow(F.lit(10.0), F.lit(low_exponent) + F.col("bin") * F.col("_w"))
    right = F.pow(F.lit(10.0), F.lit(low_exponent) + (F.col("bin") + 1) * F.col("_w"))
    return full.select("bin", left.alias("bin_left"), right.alias("bin_right"), "n_rows",
                       ratio(F.col("n_rows"), F.col("_n") * (right - left)).alias("density"))


def density_curve(df: DataFrame, value: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density on an even grid over the range, bandwidth by Scott's rule.

    Equal values are merged first; every grid point is then one running sum of a single
    aggregate, so nothing is paired up or moved.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    shape = rows.agg(F.count("_x").alias("_n"), F.stddev_samp("_x").alias("_s"),
                     F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).select(
        "_n", "_lo", ((F.col("_hi") - F.col("_lo")) / (points - 1)).alias("_step"),
        (F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_h"))
    counts = with_scalars(rows.groupBy("_x").agg(F.count(F.lit(1)).alias("_k")), shape)
    z = lambda i: (F.col("_lo") + F.lit(float(i)) * F.col("_step") - F.col("_x"))
    sums = counts.agg(F.array(*[F.sum(F.col("_k") * F.exp(F.lit(-0.5) * ratio(z(i), "_h") * ratio(z(i), "_h"))) for i in range(points)]).alias("_sums"))
    out = with_scalars(sums.select(F.posexplode("_sums").alias("point", "_sum")), shape)
    return out.select("point", (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"),
                      ratio("_sum", F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi)).alias("density"))


def box_stats(df: DataFrame, value: str, by=(), whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (extreme values inside the fences) and number of points outside."""
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    q = quantiles(rows, "_x", QUARTILES, by)
    reach = whisker * (F.col("q75") - F.col("q25"))
    marked = attached(rows, q, by) if by else with_scalars(rows, q)
    inside = F.col("_x").between(F.col("q25") - reach, F.col("q75") + reach)
    return marked.groupBy(*by, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def linear_trend(df: DataFrame, period: str, measure: str) -> DataFrame:
    """Least-squares line over the positions of ordered report periods (a bounded table)."""
    ranked = df.withColumn("_i", F.row_number().over(Window.orderBy(period)) - 1)
    line = ranked.agg(F.regr_slope(measure, "_i").alias("slope"), F.regr_intercept(measure, "_i").alias("intercept"))
    out = with_scalars(ranked, line)
    return out.withColumn("trend", F.col("intercept") + F.col("slope") * F.col("_i")).drop("_i")
