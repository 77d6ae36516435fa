"""Statistical tests closed on aggregated rows.

Every test reduces the data to a few numbers per group in one map-side-combined aggregate; the
formula then runs on that row. ``alternative`` is ``greater``, ``less`` or ``two-sided``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.arrays import as_column
from metricloom.functions.distributions import normal_cdf, normal_quantile, normal_sf, student_sf
from metricloom.functions.numbers import ratio
from metricloom.operators.ordering import running_counts


def _p_value(upper_tail, statistic: Column, alternative: str) -> Column:
    if alternative == "greater":
        return upper_tail(statistic)
    if alternative == "less":
        return upper_tail(-statistic)
    if alternative == "two-sided":
        return F.lit(2.0) * upper_tail(F.abs(statistic))
    raise ValueError(f"unknown alternative {alternative!r}")


def verdict(p_value, alpha: float = 0.05) -> Column:
    """True when the null hypothesis is rejected at level alpha."""
    return as_column(p_value) < alpha


def sample_stats(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """One row: size, mean and sample variance of each of two groups; NULL values are skipped."""
    def of(g, tag):
        x = F.when(F.col(group) == g, F.col(value).cast("double"))
        return [F.count(x).alias(f"n_{tag}"), F.avg(x).alias(f"mean_{tag}"), F.var_samp(x).alias(f"var_{tag}")]
    return df.filter(F.col(group).isin(first, second)).agg(*of(first, 1), *of(second, 2))


def t_test(df: DataFrame, value: str, group: str, first, second, alternative: str = "greater",
           equal_var: bool = True) -> DataFrame:
    """Two-sample t-test, pooled variance (Student) or separate variances (Welch)."""
    n1, n2 = F.col("n_1"), F.col("n_2")
    a, b = ratio("var_1", n1), ratio("var_2", n2)
    if equal_var:
        df_ = (n1 + n2 - 2).cast("double")
        pooled = ratio((n1 - 1) * F.col("var_1") + (n2 - 1) * F.col("var_2"), df_)
        se = F.sqrt(pooled * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2)))
    else:
        df_ = ratio((a + b) * (a + b), ratio(a * a, n1 - 1) + ratio(b * b, n2 - 1))
        se = F.sqrt(a + b)
    out = sample_stats(df, value, group, first, second).select(
        "n_1", "n_2", "mean_1", "mean_2", ratio(F.col("mean_1") - F.col("mean_2"), se).alias("t"), df_.alias("df"))
    return out.withColumn("p_value", _p_value(lambda t: student_sf(t, F.col("df")), F.col("t"), alternative))


def t_test_one_sample(df: DataFrame, value: str, popmean: float, alternative: str = "greater") -> DataFrame:
    """Mean of one sample against a fixed number."""
    stats = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("_v"))
    out = stats.select("n", "mean", ratio(F.col("mean") - popmean, F.sqrt(ratio("_v", "n"))).alias("t"),
                       (F.col("n") - 1).alias("df"))
    return out.withColumn("p_value", _p_value(lambda t: student_sf(t, F.col("df")), F.col("t"), alternative))


def mann_whitney(df: DataFrame, value: str, group: str, first, second, alternative: str = "greater") -> DataFrame:
    """Rank-sum test by the normal approximation with tie and continuity correction.

    Rows collapse to (value, count per group); ranks follow from running counts, so neither
    the rows nor their ranks are ever sorted in one place.
    """
    x = df.filter(F.col(value).isNotNull() & F.col(group).isin(first, second))
    counts = x.groupBy(F.col(value).alias("_x")).agg(
        F.count_if(F.col(group) == first).alias("_a"), F.count_if(F.col(group) == second).alias("_b"))
    ranked = running_counts(counts, "_x", ["_a", "_b"])
    ties = (F.col("_a") + F.col("_b")).cast("double")
    rank = F.col("_a_before") + F.col("_b_before") + (ties + 1) / 2
    sums = ranked.agg(F.sum("_a").alias("n_1"), F.sum("_b").alias("n_2"),
                      F.sum(F.col("_a") * rank).alias("_r"), F.sum(ties * ties * ties - ties).alias("_ties"))
    n1, n2 = F.col("n_1").cast("double"), F.col("n_2").cast("double")
    n = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - ratio("_ties", n * (n - 1))))
    shift = u - n1 * n2 / 2
    correction = {"greater": F.lit(-0.5), "less": F.lit(0.5), "two-sided": F.signum(shift) * -0.5}[alternative]
    out = sums.select("n_1", "n_2", u.alias("u_1"), (n1 * n2 - u).alias("u_2"), ratio(shift + correction, sigma).alias("z"))
    p = F.least(F.lit(1.0), _p_value(normal_sf, F.col("z"), alternative))
    return out.withColumn("p_value", F.when(F.col("z").isNotNull(), p))


def proportions_z(df: DataFrame, hits_1: str, n_1: str, hits_2: str, n_2: str, alternative: str = "greater") -> DataFrame:
    """Difference of two proportions with pooled variance, on rows that hold the four counts."""
    p1, p2 = ratio(hits_1, n_1), ratio(hits_2, n_2)
    pooled = ratio(F.col(hits_1) + F.col(hits_2), F.col(n_1) + F.col(n_2))
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (ratio(F.lit(1.0), n_1) + ratio(F.lit(1.0), n_2)))
    out = df.withColumn("z", ratio(p1 - p2, se))
    return out.withColumn("p_value", _p_value(normal_sf, F.col("z"), alternative))


def normal_approximation_holds(hits, n, at_least: int = 10) -> Column:
    """More than ``at_least`` expected successes and failures."""
    h, size = as_column(hits), as_column(n)
    return (h > at_least) & (size - h > at_least)


def proportion_effect(p_1, p_2) -> Column:
    """Arcsine distance between two proportions."""
    angle = lambda p: F.lit(2.0) * F.asin(F.sqrt(as_column(p)))
    return angle(p_1) - angle(p_2)


def sample_size(effect, alpha: float = 0.05, power: float = 0.8, ratio_: float = 1.0) -> Column:
    """Rows needed in the first group for a two-sided test of two proportions."""
    z = normal_quantile(F.lit(1 - alpha / 2)) + normal_quantile(F.lit(power))
    step = ratio(z, effect)
    return step * step * F.lit(1 + 1 / ratio_)


def test_days(per_group, daily_users) -> Column:
    """Whole days until two groups of the needed size have been seen."""
    return F.ceil(ratio(as_column(per_group) * 2, daily_users))


def normal_model(df: DataFrame, value: str, above: float, low: float, high: float) -> DataFrame:
    """Normal fitted to a column: P(X > above) and P(low < X < high)."""
    fit = df.agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"))
    z = lambda x: ratio(F.lit(float(x)) - F.col("mu"), "sigma")
    return fit.select("mu", "sigma", normal_sf(z(above)).alias("p_above"),
                      (normal_cdf(z(high)) - normal_cdf(z(low))).alias("p_between"))


def normal_model_quantile(df: DataFrame, value: str, p: float) -> DataFrame:
    """Normal fitted to a column: the value below which a share p is expected."""
    fit = df.agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"))
    return fit.withColumn("quantile", F.col("mu") + F.col("sigma") * normal_quantile(F.lit(p)))


def planned_test(daily: DataFrame, users: str, base: float, target: float) -> DataFrame:
    """Sample size per group and test length from the mean of a daily-users table."""
    mean = daily.agg(F.bround(F.avg(users), 0).alias("mean_daily_users"))
    out = mean.withColumn("per_group", sample_size(-proportion_effect(F.lit(base), F.lit(target))))
    return out.withColumn("days", test_days("per_group", "mean_daily_users"))


