"""Tails and quantiles of the normal and Student distributions as Columns.

They close a test on rows that are already aggregated, so each call is one Simpson sum over a
literal sequence; nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.arrays import as_column

STEPS = 4000          # Simpson intervals, even
FAR = 40.0            # the normal tail beyond this is below the smallest double


def _simpson(lower: Column, upper: Column, integrand) -> Column:
    h = (upper - lower) / F.lit(float(STEPS))
    weight = lambda i: F.when((i == 0) | (i == STEPS), F.lit(1.0)).when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0))
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0),
        lambda acc, i: acc + weight(i) * integrand(lower + h * i.cast("double")))
    return total * h / F.lit(3.0)


def _mirrored(x: Column, tail) -> Column:
    """Upper tail at x from a tail function that is accurate for x >= 0."""
    t = tail(F.least(F.abs(x), F.lit(FAR)))
    return F.when(x >= 0, t).when(x < 0, F.lit(1.0) - t)


def normal_sf(z) -> Column:
    """P(Z > z) for the standard normal."""
    density = lambda x: F.exp(F.lit(-0.5) * x * x)
    # what lies 12 beyond t is below double precision relative to the tail at t
    return _mirrored(as_column(z), lambda t: _simpson(t, t + F.lit(12.0), density) / F.lit(math.sqrt(2 * math.pi)))


def normal_cdf(z) -> Column:
    """P(Z <= z) for the standard normal."""
    return normal_sf(-as_column(z))


# Coefficients of a published approximation of the error function's tail, good to 1.2e-7 of its value.
TAIL = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_between(low, high) -> Column:
    """P(low < Z <= high) for the standard normal, to 1.2e-7 of either tail: for sums of very many of them."""
    def cdf(z):
        v = F.abs(z) / F.lit(math.sqrt(2.0))

        def tail(t):
            power = F.lit(TAIL[-1])
            for c in TAIL[-2::-1]:
                power = F.lit(c) + t * power
            return t * F.exp(power - v * v) / F.lit(2.0)
        below = F.transform(F.array(F.lit(1.0) / (v / F.lit(2.0) + F.lit(1.0))), tail)[0]
        return F.transform(F.array(below), lambda x: F.when(z >= 0, F.lit(1.0) - x).otherwise(x))[0]

    ends = F.array(F.struct(as_column(high).alias("z"), F.lit(1.0).alias("sign")), F.struct(as_column(low).alias("z"), F.lit(-1.0).alias("sign")))
    return F.aggregate(ends, F.lit(0.0), lambda acc, end: acc + end["sign"] * cdf(end["z"]))


def _log_cosh(y: Column) -> Column:
    half = F.sinh(F.least(y, F.lit(20.0)) / 2)
    return F.when(y > 20, y - math.log(2.0)).otherwise(F.log1p(half * half * 2))


def student_sf(t, df) -> Column:
    """P(T > t) for Student's t with ``df`` degrees of freedom (need not be whole).

    With ``x = sqrt(df) * sinh(y)`` the density is ``cosh(y) ** -df``, which has no long tail at any ``df``:
    its logarithm falls by 40 within the same distance of any lower end, or sooner by the slope there, so the sum covers
    all that a double can hold.
    NULL without degrees of freedom.
    """
    nu = F.when(as_column(df) > 0, as_column(df).cast("double"))
    x = as_column(t).cast("double")
    reach = F.lit(40.0) / nu
    reach = F.when(reach > 20, reach + math.log(2.0)).otherwise(F.log1p(F.expm1(F.least(reach, F.lit(20.0))) + F.sqrt(F.expm1(F.least(reach, F.lit(20.0)) * 2))))
    size = F.abs(x) / F.sqrt(nu)
    start = F.when(size > 1e8, F.log(size) + math.log(2.0)).otherwise(F.log1p(size + size * size / (1 + F.sqrt(1 + size * size))))
    near = lambda low: F.least(reach, F.try_divide(F.lit(40.0), nu * F.tanh(low)))
    fall = lambda low: _simpson(low, low + near(low), lambda y: F.exp(-nu * (_log_cosh(y) - _log_cosh(low))))
    tail = fall(start) * F.exp(-nu * _log_cosh(start)) / (fall(F.lit(0.0)) * 2)
    return F.when(x >= 0, tail).otherwise(F.lit(1.0) - tail)


# Coefficients of a published rational approximation of the normal quantile.
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00, 1.0)


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p) -> Column:
    """z with P(Z <= z) = p, refined by one Newton step; NULL outside (0, 1)."""
    q = as_column(p).cast("double")
    low = F.least(q, F.lit(1.0) - q)
    r = F.sqrt(F.lit(-2.0) * F.log(low))
    tail = _poly(_C, r) / _poly(_D, r)
    c = q - 0.5
    middle = c * _poly(_A, c * c) / _poly(_B, c * c)
    z = F.when(low >= 0.02425, middle).when(q < 0.5, tail).otherwise(-tail)
    density = F.exp(F.lit(-0.5) * z * z) / F.lit(math.sqrt(2 * math.pi))
    return F.when((q > 0) & (q < 1), z - (normal_cdf(z) - q) / density)
