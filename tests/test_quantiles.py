import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricloom.operators import quantiles as quantile_module
from metricloom.operators.aggregates import describe
from metricloom.operators.quantiles import quantile_table, quantiles

PROBS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def discrete(values, p):
    s = np.sort(values)
    return s[max(int(np.ceil(p * len(s))) - 1, 0)]


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of the rows, one value a third of that key; far more rows than the sketch."""
    rng = np.random.default_rng(5)
    n = 60_000
    key = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c"], n))
    value = np.round(rng.lognormal(3, 1.5, n), 4)
    value[(key == "hot") & (rng.random(n) < 0.33)] = 7.0
    pdf = pd.DataFrame({"k": key, "v": value})
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


@pytest.mark.parametrize("accuracy", [200, 10_000])
def test_exact_linear_with_hot_key(hot, accuracy):
    pdf, df = hot
    got = {r.k: r for r in quantiles(df, "v", PROBS, ["k"], accuracy=accuracy).collect()}
    for k, g in pdf.groupby("k"):
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(g.v, p), rel=1e-12), (k, name)


@pytest.mark.parametrize("accuracy", [200, 10_000])
def test_exact_discrete_with_hot_key(hot, accuracy):
    pdf, df = hot
    got = {r.k: r for r in quantiles(df, "v", PROBS, ["k"], kind="discrete", accuracy=accuracy, count="n").collect()}
    for k, g in pdf.groupby("k"):
        assert got[k]["n"] == len(g)
        for name, p in PROBS.items():
            assert got[k][name] == discrete(g.v.values, p), (k, name)


def test_exact_overall_matches_builtin(hot):
    _, df = hot
    assert quantiles(df, "v", PROBS, accuracy=500).first() == quantiles(df, "v", PROBS, method="builtin").first()


def test_counts_method(hot):
    _, df = hot
    for kind in ("linear", "discrete"):
        a = {r.k: tuple(r) for r in quantiles(df, "v", PROBS, ["k"], kind=kind, method="counts", count="n").collect()}
        assert a == {r.k: tuple(r) for r in quantiles(df, "v", PROBS, ["k"], kind=kind, accuracy=300, count="n").collect()}


def test_sorted_input_and_single_value(spark):
    df = spark.range(50_000).select(F.col("id").cast("double").alias("v"), F.lit(3).alias("c"))
    assert quantiles(df, "v", {"m": 0.5}, accuracy=100).first()["m"] == 24999.5
    assert quantiles(df, "c", {"m": 0.5, "top": 1.0, "low": 0.0}, kind="discrete", accuracy=100).first() == (3, 3, 3)


def test_null_values_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0), (None, 6.0), ("b", None)], "k string, v double")
    got = {r.k: r.m for r in quantiles(df, "v", {"m": 0.5}, ["k"]).collect()}
    assert got == {"a": 1.0, None: 5.5}


def test_several_columns(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None)], "a int, b double")
    got = {r.column: r.m for r in quantile_table(df, ["a", "b"], {"m": 0.5}).collect()}
    assert got == {"a": 2.0, "b": 15.0}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-20, 20), min_size=1, max_size=60), p=st.floats(0, 1))
def test_any_list(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert quantiles(df, "v", {"q": p}, accuracy=10).first()["q"] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_describe_like_a_data_frame(spark):
    pdf = pd.DataFrame({"g": ["x"] * 5 + ["y"] * 3, "v": [1.0, 2, 2, 8, None, 4, 4, 5]})
    df = spark.createDataFrame([(g, None if pd.isna(v) else v) for g, v in pdf.values], "g string, v double")
    want = pdf.groupby("g").v.describe()
    for r in describe(df, ["v"], ["g"]).collect():
        w = want.loc[r.g]
        assert (r["count"], r["mean"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]) == pytest.approx(
            (w["count"], w["mean"], w["min"], w["25%"], w["50%"], w["75%"], w["max"]))
        assert r["std"] == pytest.approx(w["std"])


def test_approximate_stays_near(hot):
    pdf, df = hot
    got = {r.k: r.m for r in quantiles(df, "v", {"m": 0.5}, ["k"], method="approx").collect()}
    for k, g in pdf.groupby("k"):
        assert abs((g.v <= got[k]).mean() - 0.5) < 0.18        # a value held by a third of the key moves the share


def test_unknown_options(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError):
        quantiles(df, "v", {"m": 0.5}, kind="nearest")
    with pytest.raises(ValueError):
        quantiles(df, "v", {"m": 0.5}, method="guess")


def test_bracket_pass_keeps_only_a_slice_of_the_rows(spark):
    """At 200k different values the second pass shuffles the bracket, not the column."""
    df = spark.range(200_000).select(F.rand(1).alias("v"))
    q = quantiles(df, "v", {"m": 0.5}, accuracy=1000)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "percentile_cont" not in plan and "collect" not in plan
    values = np.sort(df.toPandas().v.values)
    assert q.first()["m"] == pytest.approx(np.median(values), rel=1e-12)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 9_999, 10_001, 1_000_000])
def test_cells_of_a_group_stay_few(spark, n, monkeypatch):
    """What the last window orders hardly grows with a group of different values, and small groups are narrowed alike."""
    seen = []
    real = quantile_module._pick
    monkeypatch.setattr(quantile_module, "_pick", lambda cells, *rest: seen.append(cells.groupBy("g", "_n").count().agg(F.max("count")).first()[0]) or real(cells, *rest))
    df = spark.range(n).select(F.lit("a").alias("g"), F.xxhash64("id").cast("double").alias("v"))
    got = quantiles(df, "v", PROBS, ["g"]).first()
    values = df.toPandas().v.values
    assert [got[name] for name in PROBS] == pytest.approx([np.quantile(values, p) for p in PROBS.values()], rel=1e-12)
    assert seen[0] <= min(n, 150)
