import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.operators import experiments, inference


def test_two_proportions_golden(spark):
    """4787 of 15162 against 4851 of 15416: the published p-value is 0.578352."""
    df = spark.createDataFrame([(4851, 15416, 4787, 15162)], "m_b long, n_b long, m_a long, n_a long")
    r = inference.proportions_z(df, "m_b", "n_b", "m_a", "n_a").first()
    assert r.p_value == pytest.approx(0.5783523649, abs=1e-8)
    checks = df.select(inference.normal_approximation_holds("m_a", "n_a").alias("a"), inference.verdict(F.lit(r.p_value)).alias("v")).first()
    assert checks.a is True and checks.v is False


def test_sample_size_and_duration_golden(spark):
    effect = inference.proportion_effect(F.lit(0.309), F.lit(0.3))
    n = spark.range(1).select(inference.sample_size(effect).alias("n"), inference.test_days(F.lit(41040), F.lit(9907)).alias("d")).first()
    assert n.n == pytest.approx(41040.79, abs=0.01) and n.d == 9
    effect = inference.proportion_effect(F.lit(0.33), F.lit(0.3))
    assert spark.range(1).select(inference.sample_size(effect).alias("n")).first().n == pytest.approx(3761.6, abs=0.05)


@pytest.fixture
def groups(spark):
    rng = np.random.default_rng(11)
    a, b = rng.gamma(2, 3, 900).round(1), rng.gamma(2.2, 3, 700).round(1)
    data = [("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("a", None), ("c", 1000.0)]
    return a, b, spark.createDataFrame(data, "g string, v double").repartition(5)


def test_t_tests_use_only_known_values_of_the_two_groups(groups):
    a, b, df = groups
    r = inference.t_test(df, "v", "g", "b", "a", equal_var=True).first()
    n1, n2 = len(b), len(a)
    pooled = ((n1 - 1) * b.var(ddof=1) + (n2 - 1) * a.var(ddof=1)) / (n1 + n2 - 2)
    assert (r.n_1, r.n_2) == (n1, n2) and r.df == n1 + n2 - 2
    assert r.t == pytest.approx((b.mean() - a.mean()) / math.sqrt(pooled * (1 / n1 + 1 / n2)))
    w = inference.t_test(df, "v", "g", "b", "a", equal_var=False).first()
    va, vb = a.var(ddof=1) / n2, b.var(ddof=1) / n1
    assert w.df == pytest.approx((va + vb) ** 2 / (va ** 2 / (n2 - 1) + vb ** 2 / (n1 - 1)))
    two = inference.t_test(df, "v", "g", "b", "a", "two-sided").first().p_value
    less = inference.t_test(df, "v", "g", "b", "a", "less").first().p_value
    assert r.p_value + less == pytest.approx(1.0) and two == pytest.approx(2 * min(r.p_value, less))


def test_mann_whitney_against_ranks(groups):
    a, b, df = groups
    ranks = pd.Series(np.concatenate([a, b])).rank()
    u = ranks[:len(a)].sum() - len(a) * (len(a) + 1) / 2
    ties = pd.Series(np.concatenate([a, b])).value_counts()
    n1, n2 = len(a), len(b)
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * (n + 1 - (ties ** 3 - ties).sum() / (n * (n - 1))))
    r = inference.mann_whitney(df, "v", "g", "a", "b").first()
    assert r.u_1 == u and r.u_1 + r.u_2 == n1 * n2
    assert r.z == pytest.approx((u - n1 * n2 / 2 - 0.5) / sigma)
    assert r.p_value == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), abs=1e-9)


def test_mann_whitney_small_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 5.0)], "g string, v double")
    r = inference.mann_whitney(df, "v", "g", "a", "b", "less").first()
    assert (r.u_1, r.u_2) == (0.5, 3.5)


def test_one_sample(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "v double")
    r = inference.t_test_one_sample(df, "v", 2.0).first()
    assert r.t == pytest.approx(0.5 / math.sqrt(5 / 3 / 4)) and r.df == 3


def test_normal_model(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "v double")
    r = inference.normal_model(df, "v", 30, 20, 40).first()
    assert r.p_above == pytest.approx(0.5) and r.p_between == pytest.approx(math.erf(10 / r.sigma / math.sqrt(2)))
    assert inference.normal_model_quantile(df, "v", 0.5).first().quantile == pytest.approx(30)


def test_unknown_alternative(spark):
    with pytest.raises(ValueError):
        inference.t_test(spark.createDataFrame([("a", 1.0)], "g string, v double"), "v", "g", "a", "b", "bigger")


def test_users_in_both_groups_and_sizes(spark, rows):
    df = spark.createDataFrame([("u1", "A"), ("u1", "B"), ("u2", "A"), ("u2", "A"), ("u3", "B"), (None, "B")], "u string, g string")
    assert rows(experiments.users_in_several(df, "u", "g")) == [("u1", 2)]
    r = experiments.group_sizes(df, "u", "g", "A", "B").first()
    assert (r.users_1, r.users_2, r.difference_percent) == (2, 2, 0.0)
    assert rows(experiments.without_users(df, experiments.users_in_several(df, "u", "g"), "u")) == sorted(
        [(None, "B"), ("u2", "A"), ("u2", "A"), ("u3", "B")], key=repr)


def test_roster_dedupes_before_choosing_the_test(spark, rows):
    df = spark.createDataFrame([("u1", 1, "other"), ("u1", 2, "mine"), ("u2", 1, "mine")], "u string, n int, test string")
    assert rows(experiments.roster(df, "u", ["n"], "test", "mine").select("u")) == [("u2",)]


def test_lifetime_window_edges(spark, rows):
    ts = ["2024-01-01 10:00:00", "2024-01-08 09:59:00", "2024-01-08 10:00:00"]
    df = spark.createDataFrame([("u", t) for t in ts], "u string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert [r.lifetime for r in experiments.within_lifetime(df, "u", "t", 7).orderBy("t").collect()] == [0, 6]


def test_readout(spark):
    df = spark.createDataFrame([("u1", "A", "view"), ("u1", "A", "buy"), ("u2", "A", "view"), ("u3", "B", "buy"), ("u4", "B", None)],
                               "u string, g string, e string")
    r = experiments.readout(df, "u", "g", F.col("e") == "buy", "A", "B").first()
    assert (r.n_a, r.hits_a, r.n_b, r.hits_b, r.uplift_points) == (2, 1, 2, 1, 0.0)
    none = experiments.readout(df, "u", "g", F.col("e") == "nothing", "A", "B").first()
    assert none.p_b == 0.0 and none.uplift_percent is None


def test_balance_shares(spark):
    df = spark.createDataFrame([("u1", "A", "ios"), ("u1", "A", "ios"), ("u2", "A", "web"), ("u3", "B", "web")], "u string, g string, d string")
    got = {(r.g, r.d): (r.users, r.share) for r in experiments.group_balance(df, "u", "g", "d").collect()}
    assert got == {("A", "ios"): (1, 0.5), ("A", "web"): (1, 0.5), ("B", "web"): (1, 1.0)}
