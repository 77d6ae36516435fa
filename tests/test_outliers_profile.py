import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.functions.distributions import normal_between
from metricloom.operators import association, outliers, profile, segments
from metricloom.operators.reshape import columns_like, crosstab, pivot, stack_columns, stack_tagged, zip_lists


def test_limits_are_strict_and_null_passes(spark, rows):
    df = spark.createDataFrame([(i, float(i), float(i) if i % 2 else None) for i in range(1, 101)], "id int, a double, b double")
    lim = outliers.percentile_limits(df, ["a", "b"])
    kept = outliers.within_limits(df, lim, below_high=["a", "b"], above_low=["b"], null_passes=["b"])
    ids = {r.id for r in kept.collect()}
    assert 99 not in ids and 98 in ids and 1 not in ids and 2 in ids       # equal to a limit is out, unknown b stays
    unknown = spark.createDataFrame([(1, None, 5.0)], "id int, a double, b double")
    assert outliers.within_limits(unknown, lim, below_high=["a"]).count() == 0


def test_iqr_flags_and_small_groups(spark):
    pdf = pd.DataFrame({"g": ["big"] * 9 + ["tiny"] * 3, "v": [1.0, 2, 2, 3, 3, 3, 4, 4, 100, 1, 1, 100]})
    df = spark.createDataFrame(pdf)
    assert [r.v for r in outliers.flag_outliers(df, "v", ["g"]).filter("is_outlier").collect()] == [100.0]
    share = {r.g: (r.n_rows, r.n_outliers) for r in outliers.outlier_share(df, "v", ["g"]).collect()}
    assert share == {"big": (9, 1), "tiny": (3, 0)}
    blank = outliers.blank_outliers(df, "v", ["g"], min_rows=4)
    assert blank.count() == 12 and blank.filter("v is null").count() == 1


def test_trim_keeps_the_limit_itself(spark):
    df = spark.createDataFrame([("rub", float(v)) for v in [-5, 0, *range(1, 101)]] + [("kzt", 7.0)], "c string, v double")
    got = [r.v for r in outliers.trim_upper(df, "v", ["c"]).collect()]
    assert min(got) == 0 and max(got) == np.floor(np.quantile(range(0, 101), 0.99)) and 7.0 in got


def test_keep_large_groups(spark, rows):
    df = spark.createDataFrame([(2000, 30), (2000, 20), (2001, 49)], "y int, n int")
    assert rows(outliers.keep_large_groups(df, "y", F.sum("n"), 50)) == [(2000, 20), (2000, 30)]


def test_band_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 3.0, 8.0, 10.0, 10.5, -1.0, None)], "s double")
    band = lambda **kw: [r.b for r in df.select(segments.bands("s", [0, 3, 8, 10], ["low", "mid", "high"], **kw).alias("b")).collect()]
    assert band() == ["low", "mid", "high", "high", None, None, None]
    assert band(include_top=False) == ["low", "mid", "high", None, None, None, None]


def test_up_to_inclusive(spark):
    df = spark.createDataFrame([(30,), (31,), (90,), (180,), (181,), (None,)], "d int")
    got = [r.b for r in df.select(segments.up_to("d", {"m": 30, "q": 90, "h": 180}, "long", "none").alias("b")).collect()]
    assert got == ["m", "q", "q", "h", "long", "none"]


def test_size_class_edges_and_null_key(spark):
    sizes = {"k34": 34, "k35": 35, "k120": 120, "k121": 121}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)] + [(None,)] * 200, "m string")
    out = segments.with_size_class(df, "m").withColumn("to", segments.collapse_small("m"))
    got = {(r.m, r.size_class, r.to, r.key_count) for r in out.distinct().collect()}
    assert got == {("k34", "niche", "niche", 34), ("k35", "mid", "mid", 35), ("k120", "mid", "mid", 120), ("k121", "mass", "k121", 121),
                   (None, None, "niche", None)}


def test_span_groups(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2013, 1, 1), d(2014, 1, 1), 2), (d(2013, 1, 1), d(2014, 1, 2), 2), (d(2013, 1, 1), d(2013, 1, 1), 1), (None, d(2013, 1, 1), 1)],
                               "a date, b date, n int")
    assert [r.s for r in df.select(segments.span_group("a", "b", "n").alias("s")).collect()] == ["up to a year", "over a year", "single", "unknown"]


def test_histogram_against_numpy(spark):
    values = np.random.default_rng(1).normal(size=500).round(2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    counts, edges = np.histogram(values, bins=12)
    got = profile.histogram(df, "v", 12).orderBy("bin").toPandas()
    assert got.n_rows.sum() == 500 and np.allclose(got.bin_left, edges[:-1])
    assert np.abs(got.n_rows.values - counts).sum() <= 2              # a value on an edge may fall to either side
    flat = profile.histogram(spark.createDataFrame([(5.0,)] * 3, "v double"), "v", 4).orderBy("bin").toPandas()
    assert flat.n_rows.sum() == 3 and flat.bin_left[0] == 4.5


def test_log_histogram_density_integrates_to_one(spark):
    values = np.random.default_rng(1).lognormal(2, 1, 400)
    df = spark.createDataFrame([(float(v),) for v in values] + [(0.0,), (-3.0,)], "v double")
    got = profile.log_histogram(df, "v").toPandas()
    assert len(got) == 29 and ((got.bin_right - got.bin_left) * got.density).sum() == pytest.approx(1.0)
    assert got.n_rows.sum() == (values >= 10 ** 0.1).sum()


def test_density_curve(spark):
    values = np.array([1.0, 2.0, 2.0, 4.0, 7.0])
    got = profile.density_curve(spark.createDataFrame([(v,) for v in values.tolist()], "v double"), "v", 25).orderBy("point").toPandas()
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(1, 7, 25)
    want = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got.x, grid) and np.allclose(got.density, want)


def test_box_and_trend(spark):
    r = profile.box_stats(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 50)], "v double"), "v").first()
    assert (r.q25, r.q50, r.q75, r.whisker_low, r.whisker_high, r.n_outliers) == (2, 3, 4, 1, 4, 1)
    t = profile.linear_trend(spark.createDataFrame([(6, 1.0), (7, 3.0), (9, 5.0)], "m int, n double"), "m", "n").orderBy("m").collect()
    assert [r.trend for r in t] == pytest.approx([1.0, 3.0, 5.0]) and t[0].slope == pytest.approx(2.0)


def test_association(spark):
    rng = np.random.default_rng(8)
    n = 6000
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"x": x, "y": 0.7 * x + np.sqrt(1 - 0.49) * rng.normal(size=n), "noise": rng.choice(list("abc"), n)})
    pdf["copy"] = pdf.noise
    binned = association.bin_numeric(spark.createDataFrame(pdf), ["x", "y"])
    cells = association.pair_counts(binned, ["x", "y", "noise", "copy"])
    got = {(r.left_column, r.right_column): r for r in association.phi_k(cells).collect()}
    assert got[("noise", "copy")].cramers_v == pytest.approx(1.0) and got[("noise", "copy")].phi_k == pytest.approx(1.0, abs=0.01)
    assert got[("x", "noise")].phi_k < 0.1
    assert got[("x", "y")].phi_k == pytest.approx(0.7, abs=0.08)
    best = association.strongest_with(association.phi_k(cells), "x", "phi_k").first()
    assert best.feature == "y"


def test_cells_empty_as_expected_and_constant_sides(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": (rng.pareto(1.0, 3000) * 3).astype(int), "b": (rng.pareto(0.7, 3000) * 2).astype(int), "c": 1}).astype(str)
    cells = association.pair_counts(spark.createDataFrame(pdf), ["a", "b", "c"])
    got = {(r.left_column, r.right_column): r._under_one for r in association._empty_as_expected(cells).collect()}
    size = {c: pdf[c].value_counts().to_numpy() for c in pdf}
    assert got == {(x, y): int((np.outer(size[x], size[y]) < 3000).sum()) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))}
    constant = association.phi_k(cells.filter("right_column = 'c'")).collect()
    assert len(constant) == 2 and all(r.phi_k is None for r in constant)


def brute_phi_k(table):
    n, (r, k), na, nb = table.sum(), table.shape, table.sum(axis=1), table.sum(axis=0)
    expected = np.outer(na, nb) / n
    chi2, top = ((table - expected) ** 2 / expected).sum(), n * (min(r, k) - 1)
    noise = max((r - 1) * (k - 1) - ((expected < 1) & (table == 0)).sum(), 0)
    if chi2 <= noise or noise >= top:
        return 0.0
    u, w = np.polynomial.legendre.leggauss(8)
    x, step = (-5 + 5 / r * (2 * np.arange(r)[:, None] + 1 + u)).ravel(), np.linspace(-5, 5, k + 1)
    v = np.tile(w, r) * np.exp(-x * x / 2) * 5 / r / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    cells = lambda rho: (v[:, None] * np.diff(cdf((step - rho * x[:, None]) / math.sqrt(1 - rho * rho)), axis=1)).reshape(r, len(u), k).sum(axis=1)
    flat = cells(0.0)
    spread = lambda rho: ((cells(rho) - flat) ** 2 / np.maximum(flat, 1e-300)).sum()
    low, high = 0.0, 0.9999
    target = (chi2 - noise) / (top - noise) * spread(high)
    for _ in range(14):
        low, high = ((low + high) / 2, high) if spread((low + high) / 2) < target else (low, (low + high) / 2)
    return (low + high) / 2


def test_phi_k_with_very_many_levels_on_one_side(spark):
    rows = spark.range(6000).select((F.col("id") % 2000).cast("string").alias("many"), F.when(F.col("id") % 2000 < 500, "p").when(F.col("id") % 2000 < 1600, "q").otherwise("r").alias("few"))
    half = rows.withColumn("few", F.when(F.rand(2) < 0.7, F.col("few")).otherwise("q"))
    got = association.phi_k(association.pair_counts(half, ["many", "few"])).first().phi_k
    assert got == pytest.approx(brute_phi_k(pd.crosstab(*half.toPandas().T.to_numpy()).to_numpy()), abs=1e-3) and 0.3 < got < 1


def test_normal_between(spark):
    ends = [(-9.0, -3.0), (-1.0, 0.0), (0.0, 0.0), (0.2, 1.7), (3.0, 12.0), (-40.0, 40.0)]
    got = spark.createDataFrame(ends, "a double, b double").select(normal_between("a", "b")).collect()
    upper = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    assert [r[0] for r in got] == pytest.approx([upper(a) - upper(b) for a, b in ends], abs=2.5e-7)


def test_chi_square_by_hand(spark):
    df = spark.createDataFrame([("a", "u")] * 10 + [("a", "v")] * 20 + [("b", "u")] * 30 + [("b", "v")] * 40 + [(None, "u")], "p string, q string")
    r = association.chi_square(association.pair_counts(df, ["p", "q"])).first()
    assert (r.n_rows, r.left_levels, r.right_levels) == (100, 2, 2) and r.chi2 == pytest.approx(0.79365, abs=1e-5)


def test_reshape(spark, rows):
    df = spark.createDataFrame([("x", "a", 1), ("x", "a", 2), ("y", "b", 5)], "r string, c string, n int")
    assert rows(pivot(df, "r", "c", ["a", "b"], F.sum("n"), fill=0)) == [("x", 3, 0), ("y", 0, 5)]
    assert rows(crosstab(df, "r", "c", ["a", "b"])) == [("x", 2, 0), ("y", 0, 1)]
    wide = spark.createDataFrame([(1, 10, 20), (2, None, 40)], "id int, p_ratio int, q_ratio int")
    assert columns_like(wide, "_ratio") == ["p_ratio", "q_ratio"]
    assert rows(stack_columns(wide, ["p_ratio", "q_ratio"], ids=["id"])) == [(1, "p_ratio", 10), (1, "q_ratio", 20), (2, "p_ratio", None), (2, "q_ratio", 40)]
    assert rows(stack_tagged({"l": df.select("n"), "r": df.select("n").filter("n = 5")}, "side"))[-1] == (5, "r")
    lists = spark.createDataFrame([(["m", "s"], [1250, 857])], "cities array<string>, users array<int>")
    assert rows(zip_lists(lists, city="cities", n="users")) == [("m", 1250), ("s", 857)]


def test_shares_of_a_total_as_thresholds(spark, rows):
    df = spark.createDataFrame([("a", 6), ("a", 0), ("b", 3), ("c", 1), (None, 90)], "k string, n int")
    assert rows(outliers.keep_large_groups(df.filter("k is not null"), "k", F.sum("n"), share=0.3).select("n")) == [(0,), (3,), (6,)]
    classed = segments.with_size_class(df, "k", 0.3, 0.25, shares=True)
    assert rows(classed.select("k", "key_count", "size_class")) == [("a", 2, "mass"), ("a", 2, "mass"), ("b", 1, "mid"), ("c", 1, "mid"), (None, None, None)]
    assert rows(segments.size_class_summary(df, "k", 0.3, 0.25, shares=True).select("size_class", "n_keys", "n_rows")) == [("mass", 1, 2), ("mid", 2, 2)]
