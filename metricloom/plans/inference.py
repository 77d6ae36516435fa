"""Statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import day
from metricloom.functions.numbers import ratio
from metricloom.operators import experiments, inference
from metricloom.plans.bindings import SPLIT, split
from metricloom.plans.registry import query

# The checks integrate with 6000 steps where the library takes 4000 and a different normaliser.


def _area(f: str, low: str, high: str, steps: int = 6000) -> str:
    return (f"list_sum(list_transform(range({steps} + 1), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
            + f.replace("@", f"({low} + i * (({high} - {low}) / {steps}))") + f")) * (({high}) - ({low})) / {3 * steps}")


def _student(t: str, nu: str) -> str:
    f = f"exp(-({nu} + 1) / 2 * ln(1 + @ * @ / {nu}))"
    return f"({_area(f, t, '45')}) / ({_area(f, '-45', '45', 12000)})"


def _normal(z: str) -> str:
    return f"({_area('exp(-0.5 * @ * @)', z, '45')}) / sqrt(2 * pi())"


def rounded(df, digits=6, skip=()):
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema
                           if f.dataType.simpleString() == "double" and f.name not in skip})


def _moments(where_1, where_2, table="events", x="value"):
    return f"""SELECT count(*) FILTER (WHERE {where_1}) AS n_1, count(*) FILTER (WHERE {where_2}) AS n_2, avg({x}) FILTER (WHERE {where_1}) AS mean_1,
      avg({x}) FILTER (WHERE {where_2}) AS mean_2, var_samp({x}) FILTER (WHERE {where_1}) AS v1, var_samp({x}) FILTER (WHERE {where_2}) AS v2 FROM {table}"""


REPORT = "n_1, n_2, round(mean_1, 6) AS mean_1, round(mean_2, 6) AS mean_2, round(t, 6) AS t, round(df, 6) AS df, round({p}, 6) AS p_value"
CLICKS = _moments("event_type = 'click'", "event_type = 'purchase'")


@query("INF1 INF10", f"""SELECT *, p_value < 0.05 AS rejected FROM (SELECT {REPORT.format(p=_student('t', 'df'))} FROM (SELECT *, (n_1 + n_2 - 2)::DOUBLE AS df,
  (mean_1 - mean_2) / sqrt(((n_1 - 1) * v1 + (n_2 - 1) * v2) / (n_1 + n_2 - 2) * (1 / n_1 + 1 / n_2)) AS t FROM ({CLICKS})))""")
def student_t_test(t):
    out = rounded(inference.t_test(t.events, "value", "event_type", "click", "purchase"))
    return out.withColumn("rejected", inference.verdict("p_value"))


@query("INF1", f"""SELECT {REPORT.format(p='2 * ' + _student('abs(t)', 'df'))} FROM (SELECT *, (n_1 + n_2 - 2)::DOUBLE AS df,
  (mean_1 - mean_2) / sqrt(((n_1 - 1) * v1 + (n_2 - 1) * v2) / (n_1 + n_2 - 2) * (1 / n_1 + 1 / n_2)) AS t FROM ({CLICKS}))""")
def student_t_test_two_sided(t):
    return rounded(inference.t_test(t.events, "value", "event_type", "click", "purchase", alternative="two-sided"))


@query("INF2", f"""SELECT n, round(mean, 6) AS mean, round(t, 6) AS t, df, round({_student('t', 'df')}, 6) AS p_value
  FROM (SELECT count(value) AS n, avg(value) AS mean, (avg(value) - 49) / sqrt(var_samp(value) / count(value)) AS t, count(value) - 1 AS df FROM events)""")
def one_sample_t_test(t):
    return rounded(inference.t_test_one_sample(t.events, "value", 49.0))


PER_USER = f"SELECT user_id, grp, count(*)::DOUBLE AS metric FROM ({SPLIT}) GROUP BY 1, 2"
WELCH = """SELECT *, (a + b) * (a + b) / (a * a / (n_1 - 1) + b * b / (n_2 - 1)) AS df, (mean_1 - mean_2) / sqrt(a + b) AS t FROM (SELECT *, v1 / n_1 AS a, v2 / n_2 AS b FROM ({s}))"""


@query("INF3 EXP9", f"SELECT {REPORT.format(p=_student('t', 'df'))} FROM (" + WELCH.format(s=_moments("grp = 'A'", "grp = 'B'", f"({PER_USER})", "metric")) + ")")
def welch_t_test_per_user(t):
    per_user = experiments.per_user_metric(split(t), "user_id", "grp", F.count("*"))
    return rounded(inference.t_test(per_user, "metric", "grp", "A", "B", equal_var=False))


@query("INF3", f"SELECT {REPORT.format(p='1 - ' + _student('t', 'df'))} FROM (" + WELCH.format(s=CLICKS) + ")")
def welch_t_test_less(t):
    return rounded(inference.t_test(t.events, "value", "event_type", "click", "purchase", alternative="less", equal_var=False))


def _mann_whitney(a, b, tail, x="value", table="events", g="event_type"):
    shift = {"greater": "- 0.5", "two-sided": "- 0.5 * sign(u - n_1 * n_2 / 2)"}[tail]
    p = {"greater": _normal("z"), "two-sided": "least(1, 2 * " + _normal("abs(z)") + ")"}[tail]
    return f"""WITH r AS (SELECT {g} AS g, {x} AS x, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS rk FROM {table} WHERE {g} IN ('{a}', '{b}')),
      ties AS (SELECT sum(k * k * k - k)::DOUBLE AS s FROM (SELECT count(*)::DOUBLE AS k FROM r GROUP BY x)),
      c AS (SELECT count(*) FILTER (WHERE g = '{a}') AS n_1, count(*) FILTER (WHERE g = '{b}') AS n_2, sum(rk) FILTER (WHERE g = '{a}') AS ra FROM r),
      u AS (SELECT n_1, n_2, ra - n_1 * (n_1 + 1) / 2 AS u, sqrt(n_1::DOUBLE * n_2 / 12 * (n_1 + n_2 + 1 - s / ((n_1 + n_2) * (n_1 + n_2 - 1)))) AS sd FROM c, ties)
      SELECT n_1, n_2, u::DOUBLE AS u_1, (n_1 * n_2 - u)::DOUBLE AS u_2, round(z, 6) AS z, round({p}, 6) AS p_value FROM (SELECT *, (u - n_1 * n_2 / 2 {shift}) / sd AS z FROM u)"""


@query("INF4", _mann_whitney("click", "purchase", "greater"))
def mann_whitney_greater(t):
    return rounded(inference.mann_whitney(t.events, "value", "event_type", "click", "purchase"))


@query("INF4", _mann_whitney("view", "error", "two-sided", "floor(value)"))
def mann_whitney_with_ties(t):
    e = t.events.withColumn("value", F.floor("value"))
    return rounded(inference.mann_whitney(e, "value", "event_type", "view", "error", "two-sided"))


COUNTS = """SELECT count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 250000) AS m_a, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_a,
  count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 250000) AS m_b, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_b FROM orders"""


def status_counts(t):
    big = F.col("o_totalprice") > 250000
    of = lambda s: F.col("o_orderstatus") == s
    return t.orders.agg(F.count_if(of("F") & big).alias("m_a"), F.count_if(of("F")).alias("n_a"),
                        F.count_if(of("O") & big).alias("m_b"), F.count_if(of("O")).alias("n_b"))


@query("INF5 INF10", f"""SELECT m_a, n_a, m_b, n_b, round(z, 6) AS z, round({_normal('z')}, 6) AS p_value, {_normal('z')} < 0.05 AS rejected
  FROM (SELECT *, (m_b / n_b - m_a / n_a) / sqrt((m_a + m_b) / (n_a + n_b) * (1 - (m_a + m_b) / (n_a + n_b)) * (1 / n_a + 1 / n_b)) AS z FROM ({COUNTS}))""")
def two_proportions_z_test(t):
    out = rounded(inference.proportions_z(status_counts(t), "m_b", "n_b", "m_a", "n_a"))
    return out.withColumn("rejected", inference.verdict("p_value"))


@query("INF6", f"SELECT m_a, n_a, (m_a > 10 AND n_a - m_a > 10) AS holds_a, (m_b > 10 AND n_b - m_b > 10) AS holds_b FROM ({COUNTS})")
def normal_approximation_check(t):
    c = status_counts(t)
    return c.select("m_a", "n_a", inference.normal_approximation_holds("m_a", "n_a").alias("holds_a"),
                    inference.normal_approximation_holds("m_b", "n_b").alias("holds_b"))


@query("INF7", f"SELECT round(2 * asin(sqrt(m_b / n_b)) - 2 * asin(sqrt(m_a / n_a)), 8) AS effect FROM ({COUNTS})")
def proportion_effect_size(t):
    c = status_counts(t)
    return c.select(F.round(inference.proportion_effect(ratio("m_b", "n_b"), ratio("m_a", "n_a")), 8).alias("effect"))


# Normal quantiles at 0.975, 0.8 and 0.9.
Z975, Z80, Z90 = 1.959963984540054, 0.8416212335729143, 1.2815515655446004


@query("INF8", f"SELECT round(2 * pow(({Z975} + {Z80}) / (2 * asin(sqrt(p * 1.03)) - 2 * asin(sqrt(p))), 2), 4) AS per_group FROM (SELECT m_a / n_a AS p FROM ({COUNTS}))")
def needed_sample_size(t):
    p = ratio("m_a", "n_a")
    effect = inference.proportion_effect(p * 1.03, p)
    return status_counts(t).select(F.round(inference.sample_size(effect), 4).alias("per_group"))


@query("INF9", f"""SELECT mean_daily_users, round(2 * pow(({Z975} + {Z80}) / (2 * asin(sqrt(0.33)) - 2 * asin(sqrt(0.3))), 2), 4) AS per_group,
  ceil(2 * 2 * pow(({Z975} + {Z80}) / (2 * asin(sqrt(0.33)) - 2 * asin(sqrt(0.3))), 2) / mean_daily_users)::BIGINT AS days
  FROM (SELECT round_even(avg(u), 0) AS mean_daily_users FROM (SELECT count(DISTINCT user_id) AS u FROM events GROUP BY ts::DATE))""")
def planned_test_length(t):
    daily = t.events.groupBy(day("ts")).agg(F.count_distinct("user_id").alias("users"))
    return inference.planned_test(daily, "users", 0.3, 0.33).withColumn("per_group", F.round("per_group", 4))


FIT = "SELECT avg(value) AS mu, stddev_samp(value) AS sigma FROM events WHERE event_type = 'view'"


@query("INF11", f"""SELECT round(mu, 6) AS mu, round(sigma, 6) AS sigma, round({_normal('((60 - mu) / sigma)')}, 6) AS p_above,
  round({_normal('((40 - mu) / sigma)')} - {_normal('((60 - mu) / sigma)')}, 6) AS p_between FROM ({FIT})""")
def normal_model_probabilities(t):
    return rounded(inference.normal_model(t.events.filter(F.col("event_type") == "view"), "value", 60, 40, 60))


@query("INF12", f"SELECT round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(mu + sigma * {Z90}, 6) AS quantile FROM ({FIT})")
def normal_model_percentile(t):
    return rounded(inference.normal_model_quantile(t.events.filter(F.col("event_type") == "view"), "value", 0.9))
