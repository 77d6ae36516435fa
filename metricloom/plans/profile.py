"""Chart data: histograms, densities, box plots, trends, association."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from metricloom.functions.dates import month_start
from metricloom.functions.distributions import TAIL
from metricloom.operators import association, profile
from metricloom.plans.registry import query


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("DST1", """WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders),
  c AS (SELECT least(floor((o_totalprice - lo) / w), 29)::BIGINT AS b, count(*) AS n FROM orders, e GROUP BY 1)
  SELECT i AS bin, round(lo + i * w, 6) AS bin_left, round(lo + i * w + w, 6) AS bin_right, coalesce(n, 0) AS n_rows FROM range(30) r(i) CROSS JOIN e LEFT JOIN c ON b = i""")
def histogram_of_totals(t):
    return rounded(profile.histogram(t.orders, "o_totalprice", 30), ["bin_left", "bin_right"])


@query("DST1", """WITH e AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part), c AS (SELECT least(p_size - lo, hi - lo - 1)::BIGINT AS b, count(*) AS n FROM part, e GROUP BY 1)
  SELECT i AS bin, (lo + i)::DOUBLE AS bin_left, (lo + i + 1)::DOUBLE AS bin_right, coalesce(n, 0) AS n_rows FROM e, range(e.hi - e.lo) r(i) LEFT JOIN c ON b = i""")
def histogram_per_unit(t):
    return profile.histogram(t.part, "p_size")


@query("DST1", """WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events)
  SELECT event_type, least(floor((value - lo) / w), 19)::BIGINT AS bin, round(lo + least(floor((value - lo) / w), 19) * w, 6) AS bin_left,
  round(lo + least(floor((value - lo) / w), 19) * w + w, 6) AS bin_right, count(*) AS n_rows FROM events, e GROUP BY ALL""")
def histogram_by_group(t):
    return rounded(profile.histogram(t.events, "value", 20, by=["event_type"]), ["bin_left", "bin_right"])


@query("DST2", """WITH x AS (SELECT log10(value) AS x FROM events WHERE value > 0), e AS (SELECT (max(x) - 0.1) / 29 AS w FROM x),
  c AS (SELECT least(floor((x - 0.1) / w), 28)::BIGINT AS b, count(*) AS n FROM x, e WHERE x >= 0.1 GROUP BY 1)
  SELECT i AS bin, round(pow(10, 0.1 + i * w), 6) AS bin_left, round(pow(10, 0.1 + (i + 1) * w), 6) AS bin_right, coalesce(n, 0) AS n_rows,
  round(coalesce(n, 0) / ((SELECT sum(n) FROM c) * (pow(10, 0.1 + (i + 1) * w) - pow(10, 0.1 + i * w))), 6) AS density FROM range(29) r(i) CROSS JOIN e LEFT JOIN c ON b = i""")
def log_histogram_of_values(t):
    return rounded(profile.log_histogram(t.events, "value"), ["bin_left", "bin_right", "density"])


@query("DST3", """WITH s AS (SELECT count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h, min(value) AS lo, (max(value) - min(value)) / 49 AS w FROM events)
  SELECT i::INT AS point, round(any_value(lo + i * w), 6) AS x, round(sum(exp(-0.5 * pow((lo + i * w - value) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 8) AS density
  FROM events, s, range(50) r(i) GROUP BY i""")
def density_of_values(t):
    return profile.density_curve(t.events, "value").withColumns({"x": F.round("x", 6), "density": F.round("density", 8)})


BOX = """WITH q AS (SELECT {k}, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75 FROM ({s}) GROUP BY 1)
  SELECT {k}, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, min(x) FILTER (WHERE i) AS whisker_low, max(x) FILTER (WHERE i) AS whisker_high, count(*) FILTER (WHERE NOT i) AS n_outliers
  FROM (SELECT *, x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS i FROM ({s}) JOIN q USING ({k})) GROUP BY ALL"""


@query("DST4", BOX.format(k="event_type", s="SELECT event_type, value AS x FROM events"))
def box_plot_by_group(t):
    return rounded(profile.box_stats(t.events, "value", ["event_type"]), ["q25", "q50", "q75"])


@query("DST4", BOX.format(k="one", s="SELECT 1 AS one, value * value AS x FROM events").replace("SELECT one, round", "SELECT round"))
def box_plot_overall(t):
    return rounded(profile.box_stats(t.events.withColumn("sq", F.col("value") * F.col("value")), "sq"), ["q25", "q50", "q75"])


@query("DST5", """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS i FROM m)
  SELECT month, n, round((SELECT regr_slope(n, i) FROM r), 6) AS slope, round((SELECT regr_intercept(n, i) FROM r), 6) AS intercept,
  round((SELECT regr_intercept(n, i) + regr_slope(n, i) * r.i FROM r AS z), 6) AS trend FROM r""".replace(
      "(SELECT regr_intercept(n, i) + regr_slope(n, i) * r.i FROM r AS z)", "(SELECT regr_intercept(n, i) FROM r) + (SELECT regr_slope(n, i) FROM r) * i"))
def trend_of_monthly_orders(t):
    months = t.orders.groupBy(month_start("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    return rounded(profile.linear_trend(months, "month", "n"), ["slope", "intercept", "trend"])


FEATURES = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "o_totalprice", "c_acctbal"]


def features(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return association.bin_numeric(joined.select(*FEATURES), ["o_totalprice", "c_acctbal"])


BINNED = """SELECT o_orderstatus, o_orderpriority, c_mktsegment, least(floor((o_totalprice - pl) / pw), 9)::INT::VARCHAR AS o_totalprice,
  least(floor((c_acctbal - al) / aw), 9)::INT::VARCHAR AS c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey,
  (SELECT min(o_totalprice) AS pl, (max(o_totalprice) - min(o_totalprice)) / 10 AS pw, min(c_acctbal) AS al, (max(c_acctbal) - min(c_acctbal)) / 10 AS aw FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _chi2_sql(a, b):
    return f"""SELECT '{a}' AS left_column, '{b}' AS right_column, n AS n_rows, left_levels, right_levels, round(greatest(n * (t - 1), 0), 4) AS chi2,
      round(sqrt(greatest(t - 1, 0) / (least(left_levels, right_levels) - 1)), 6) AS cramers_v FROM (SELECT sum(k)::BIGINT AS n, count(DISTINCT {a}) AS left_levels, count(DISTINCT {b}) AS right_levels,
      sum(k * k / (na * nb)::DOUBLE) AS t FROM (SELECT *, sum(k) OVER (PARTITION BY {a}) AS na, sum(k) OVER (PARTITION BY {b}) AS nb FROM (SELECT {a}, {b}, count(*) AS k FROM b GROUP BY 1, 2)))"""


@query("DST6", f"WITH b AS ({BINNED}) " + " UNION ALL ".join(_chi2_sql(a, b) for a, b in combinations(FEATURES, 2)))
def association_by_cramers_v(t):
    out = association.chi_square(association.pair_counts(features(t), FEATURES))
    return out.withColumns({"chi2": F.round("chi2", 4), "cramers_v": F.round("cramers_v", 6)})


def _fit_sql(a, b):
    return f"""SELECT '{a}' AS left_column, '{b}' AS right_column, n, r, k, greatest(n * (t - 1), 0) AS chi2, greatest((r - 1) * (k - 1) - (all_small - seen_small), 0) AS noise, n * (least(r, k) - 1) AS top
      FROM (SELECT sum(m)::BIGINT AS n, count(DISTINCT {a}) AS r, count(DISTINCT {b}) AS k, sum(m * m / (na * nb)::DOUBLE) AS t, count(*) FILTER (na * nb < (SELECT count(*) FROM b)) AS seen_small
        FROM (SELECT *, sum(m) OVER (PARTITION BY {a}) AS na, sum(m) OVER (PARTITION BY {b}) AS nb FROM (SELECT {a}, {b}, count(*) AS m FROM b GROUP BY 1, 2))),
      (SELECT count(*) AS all_small FROM (SELECT count(*) AS na FROM b GROUP BY {a}), (SELECT count(*) AS nb FROM b GROUP BY {b}) WHERE na * nb < (SELECT count(*) FROM b))"""


def _normal_sql(high, low):
    """P(low < Z <= high) by the approximation of ``normal_between``."""
    def cdf(z):
        t = f"(1 / (1 + abs({z}) / {2 * math.sqrt(2)!r}))"
        power = repr(TAIL[-1])
        for c in TAIL[-2::-1]:
            power = f"({c!r}::DOUBLE + {t} * {power})"
        tail = f"{t} * exp({power} - {z} * {z} / 2) / 2"
        return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"
    return f"({cdf(high)} - {cdf(low)})"


def _spread_sql(state, keys):
    """``keys, spread`` of rows that have ``r, k`` levels and a correlation ``rho``; two-dimensional sums over bins and quadrature points."""
    half, root = "(5.0::DOUBLE / r)", "sqrt(1 - rho * rho)"
    return f"""SELECT {keys}, sum((p - f) * (p - f) / greatest(f, 1e-300)) AS spread FROM (SELECT {keys}, i, j, sum(v * {_normal_sql("z1", "z0")}) AS p, sum(v * {_normal_sql("y1", "y0")}) AS f
      FROM (SELECT *, w * exp(-x * x / 2) * {half} / sqrt(2 * pi()) AS v, (y1 - rho * x) / {root} AS z1, (y0 - rho * x) / {root} AS z0
        FROM (SELECT *, -5 + {half} * (2 * i + 1) + {half} * u AS x, -5 + 10.0::DOUBLE / k * j AS y0, -5 + 10.0::DOUBLE / k * (j + 1) AS y1
          FROM {state}, range(64) AS a(i), range(64) AS c(j), q WHERE i < r AND j < k)) GROUP BY {keys}, i, j) GROUP BY {keys}"""


# the plain bisection of the range: 20 halvings divide it as the operator's rounds do
PHI_K = f"""WITH RECURSIVE b AS ({BINNED}), q(u, w) AS (VALUES {", ".join(f"({u!r}::DOUBLE, {w!r}::DOUBLE)" for u, w in association.nodes(association.NODES))}),
  fit AS MATERIALIZED ({" UNION ALL ".join(_fit_sql(a, b) for a, b in combinations(FEATURES, 2))}),
  sought AS (SELECT *, {association.TOP_RHO}::DOUBLE AS rho FROM fit WHERE top > 0 AND chi2 > noise AND noise < top AND chi2 < top),
  s AS (SELECT left_column, right_column, r, k, (chi2 - noise) / (top - noise) * spread AS target, 0::DOUBLE AS low, {association.TOP_RHO}::DOUBLE AS high, 0 AS n
      FROM ({_spread_sql("sought", "left_column, right_column, r, k, chi2, noise, top")})
    UNION ALL SELECT left_column, right_column, r, k, target, CASE WHEN spread < target THEN (low + high) / 2 ELSE low END, CASE WHEN spread < target THEN high ELSE (low + high) / 2 END, n + 1
      FROM ({_spread_sql("(SELECT *, (low + high) / 2 AS rho FROM s WHERE n < 20)", "left_column, right_column, r, k, target, low, high, n")})),
  phi AS (SELECT left_column, right_column, n AS n_rows, round(chi2, 4) AS chi2, round(sqrt(chi2 / n / (least(r, k) - 1)), 6) AS cramers_v,
      CASE WHEN top <= 0 THEN NULL WHEN chi2 <= noise OR noise >= top THEN 0 WHEN chi2 >= top THEN 1 ELSE round((low + high) / 2, 4) END AS phi_k
    FROM fit LEFT JOIN (SELECT left_column, right_column, low, high FROM s WHERE n = 20) USING (left_column, right_column))"""


@query("DST6", f"{PHI_K} SELECT * FROM phi")
def association_by_phi_k(t):
    out = association.phi_k(association.pair_counts(features(t), FEATURES))
    return out.withColumns({"chi2": F.round("chi2", 4), "cramers_v": F.round("cramers_v", 6)})


@query("DST6", f"WITH b AS ({BINNED}) SELECT 'o_totalprice' AS target, CASE left_column WHEN 'o_totalprice' THEN right_column ELSE left_column END AS feature, cramers_v FROM ("
       + " UNION ALL ".join(_chi2_sql(a, b) for a, b in combinations(FEATURES, 2) if "o_totalprice" in (a, b)) + ") ORDER BY cramers_v DESC, feature LIMIT 1")
def strongest_feature(t):
    pairs = association.chi_square(association.pair_counts(features(t), FEATURES)).withColumn("cramers_v", F.round("cramers_v", 6))
    return association.strongest_with(pairs, "o_totalprice", "cramers_v")


@query("DST6", f"""{PHI_K} SELECT 'o_totalprice' AS target, CASE left_column WHEN 'o_totalprice' THEN right_column ELSE left_column END AS feature, phi_k
  FROM phi WHERE phi_k IS NOT NULL AND 'o_totalprice' IN (left_column, right_column) ORDER BY phi_k DESC, feature LIMIT 1""")
def strongest_feature_by_phi_k(t):
    return association.strongest_with(association.phi_k(association.pair_counts(features(t), FEATURES)), "o_totalprice", "phi_k")
