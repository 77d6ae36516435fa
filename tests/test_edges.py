"""Cases the bundled tables never hold: unknown users, empty and constant groups, odd numbers, wide ranges."""

import math

import pytest
from pyspark.sql import functions as F

from metricloom.functions import distributions, numbers
from metricloom.operators import aggregates, association, inference, ordering, outliers, profile, segments


def one(df):
    return df.first().asDict()


def test_groups_of_unknown_users_stay(spark, rows):
    df = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("a", None, True), ("b", None, True), (None, 2, False)], "d string, u int, hit boolean")
    got = aggregates.distinct_of(df, ["d"], "u", hits=F.col("hit"))
    assert rows(got) == sorted([("a", 1, 1), ("b", 0, 0), (None, 1, 0)], key=repr)


@pytest.mark.parametrize("text, want", [("1,234.5", 1234.5), (" -7 ", -7.0), ("+.5", 0.5), ("3.", 3.0), ("1e3", 1000.0), ("NaN", None), ("Infinity", None), ("1d", None), ("2f", None),
                                        ("", None), (".", None), ("0x1", None), (None, None)])
def test_numbers_are_written_in_digits(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(numbers.parse_number("s")).first()[0] == want


def test_whole_part_of_odd_numbers(spark, rows):
    df = spark.createDataFrame([(float("nan"),), (1e300,), (-2.9,), (None,)], "x double")
    assert [r[0] for r in df.select(numbers.whole("x")).collect()] == [None, None, -2, None]


@pytest.mark.parametrize("nu", [1.0, 2.0, 4.0, 30.0, 31.0, 1000.0, 1e6])
@pytest.mark.parametrize("t", [0.0, 0.5, 3.0, 35.0, 39.0, 45.0, 300.0, -3.0])
def test_student_tail_is_not_cut(spark, nu, t):
    got = spark.range(1).select(distributions.student_sf(F.lit(t), F.lit(nu))).first()[0]
    assert got == pytest.approx(student_tail(t, nu), rel=1e-7, abs=1e-300)


def student_tail(t, nu):
    """By the incomplete beta function, as a continued fraction."""
    if t < 0:
        return 1 - student_tail(-t, nu)
    a, b, x = nu / 2, 0.5, nu / (nu + t * t)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - a * math.log1p(t * t / nu) + (b * (math.log(t * t) - math.log(nu + t * t)) if t else -math.inf)
    if t == 0:
        return 0.5

    def fraction(a, b, x):
        c, d, f = 1.0, 1 - (a + b) * x / (a + 1), 0.0
        d = 1 / (d or 1e-300)
        f = d
        for m in range(1, 20000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                f *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return f
    if x < (a + 1) / (a + b + 2):
        return 0.5 * math.exp(log_front) * fraction(a, b, x) / a
    return 0.5 - 0.5 * math.exp(log_front) * fraction(b, a, 1 - x) / b


def test_tests_on_degenerate_groups_give_null(spark):
    counts = spark.createDataFrame([(0, 0, 3, 10)], "a long, n long, b long, m long")
    assert one(inference.proportions_z(counts, "a", "n", "b", "m"))["z"] is None
    flat = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", 2.0), ("y", 2.0)], "g string, v double")
    for equal in (True, False):
        assert one(inference.t_test(flat, "v", "g", "x", "y", equal_var=equal))["t"] is None
    assert one(inference.t_test(flat, "v", "g", "x", "nobody"))["p_value"] is None
    assert one(inference.mann_whitney(flat.limit(1), "v", "g", "x", "y"))["p_value"] is None
    assert one(inference.t_test_one_sample(flat.filter("g = 'none'"), "v", 1.0))["t"] is None
    assert spark.range(1).select(inference.sample_size(F.lit(0.0))).first()[0] is None
    assert one(inference.normal_model(flat.filter("g = 'x'"), "v", 1, 0, 2))["p_above"] is None


def test_profiles_of_constant_columns(spark):
    flat = spark.createDataFrame([(10.0 ** 0.1,)] * 3, "v double")
    assert {r["density"] for r in profile.density_curve(flat, "v", 5).collect()} == {None}
    assert sum(r["n_rows"] for r in profile.log_histogram(flat, "v", 4).collect()) == 3
    assert {r["density"] for r in profile.log_histogram(flat.select((F.col("v") * 0 + 1).alias("v")), "v", 4).collect()} == {None}


def test_unit_bins_over_a_wide_range(spark):
    wide = spark.createDataFrame([(0,), (0,), (3_000_000_000,), (None,)], "v long")
    assert sorted((r["bin"], r["n_rows"]) for r in profile.histogram(wide, "v", empty=False).collect()) == [(0, 2), (2_999_999_999, 1)]
    some = spark.createDataFrame([(0,), (200_000,)], "v long")
    assert profile.histogram(some, "v").count() == 200_000


def test_equal_measures_choose_the_first_name(spark):
    pairs = [("t", "ac", 0.5), ("ab", "t", 0.5), ("t", "zz", 0.4), ("t", "aa", None), ("t", "a", float("nan"))]
    for order in (pairs, pairs[::-1]):
        assert one(association.strongest_with(spark.createDataFrame(order, "left_column string, right_column string, m double"), "t", "m"))["feature"] == "ab"


def test_groups_ranked_by_outliers(spark):
    values = [("a", float(x)) for x in [1, 2, 3, 4, 100]] + [("b", float(x)) for x in [1, 2, 3, 4, 5]] + [("c", float(x)) for x in [1, 2, 3, 4, 5, 6, 7, 90]] + [("d", float(x)) for x in [1, 2, 3, 4, 100]]
    got = outliers.top_outlier_shares(spark.createDataFrame(values, "k string, v double"), "v", ["k"], k=3).orderBy("position").collect()
    assert [(r["position"], r["k"], r["n_outliers"]) for r in got] == [(1, "a", 1), (2, "d", 1), (3, "c", 1)]


def test_shares_of_many_segments(spark):
    out = segments.share_by_segment(spark.range(1000).withColumn("s", F.col("id") % 200), "s", n=F.count("*"))
    assert {round(r["n_percent"], 6) for r in out.collect()} == {0.5}
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString() or "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_positions_follow_the_sort(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x")).repartition(7)
    got = ordering.with_position(ordering.order_by(df, "-x")).collect()
    assert sorted((r["position"], r["x"]) for r in got) == [(i + 1, 4999 - i) for i in range(5000)]
