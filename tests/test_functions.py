import datetime as dt
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from metricloom.functions import arrays, dates, distributions, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_capitalise_lowers_the_rest_and_runs_before_trim(spark):
    assert one(spark, text.capitalise(F.lit("aB cD"))) == "Ab cd"
    assert one(spark, text.clean_name(F.lit("  кафе   МЫ "))) == "кафе мы"      # first character is a space
    assert one(spark, text.clean_address(F.lit(" Улица  Мира, 1 "))) == "улица мира, 1"


def test_contains_any_treats_missing_text_as_no(spark):
    df = spark.createDataFrame([("a 24/7",), ("круглосуточно",), ("10-22",), (None,)], "h string")
    got = [r.x for r in df.select(text.contains_any("h", ["24/7", "круглосуточно"]).alias("x")).collect()]
    assert got == [1, 1, 0, 0]


def test_label_of_unknown_code(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [r.x for r in df.select(text.label_of("c", {"a": "A"}).alias("x")).collect()] == ["A", None, None]
    assert [r.x for r in df.select(text.label_of("c", {"a": "A"}, "?").alias("x")).collect()] == ["A", "?", "?"]


@pytest.mark.parametrize("value, up, even", [(2.5, 3.0, 2.0), (3.5, 4.0, 4.0), (-2.5, -3.0, -2.0)])
def test_two_rounding_rules(spark, value, up, even):
    assert one(spark, numbers.round_half_up(F.lit(value), 0)) == up
    assert one(spark, numbers.round_half_even(F.lit(value), 0)) == even


def test_parse_number(spark):
    df = spark.createDataFrame([("1,234,567",), (" 12.5 ",), ("tbd",), (None,), ("-",)], "s string")
    assert [r.x for r in df.select(numbers.parse_number("s").alias("x")).collect()] == [1234567.0, 12.5, None, None, None]


def test_ratio_by_zero_is_null(spark):
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, numbers.ratio(F.lit(7), F.lit(2))) == 3.5            # no integer division


def test_percent_difference_is_absolute(spark):
    assert one(spark, numbers.percent_difference(F.lit(100), F.lit(120))) == 20.0


def test_overage_at_the_limit_and_unknown(spark):
    df = spark.createDataFrame([(40.0,), (50.0,), (51.5,), (None,)], "u double")
    assert [r.x for r in df.select(numbers.overage("u", F.lit(50.0)).alias("x")).collect()] == [0.0, 0.0, 1.5, 0.0]


def test_date_functions(spark):
    d = F.lit("2024-12-31").cast("date")
    assert one(spark, dates.season(d)) == "зима"
    assert one(spark, dates.season(F.lit("2024-03-01").cast("date"))) == "весна"
    assert one(spark, dates.quarter_label(d)) == "2024-Q4"
    assert one(spark, dates.weekday_label(d)) == "Tuesday"
    assert one(spark, dates.week_start(d)) == dt.date(2024, 12, 30)
    assert one(spark, dates.month_label(d)) == "дек"
    assert one(spark, dates.is_weekend(F.lit("2024-12-28").cast("date"))) is True
    assert one(spark, dates.parse_date(F.lit("2024-13-01"))) is None
    assert one(spark, dates.midpoint(F.lit("2020-01-01").cast("date"), F.lit("2020-01-04").cast("date"))) == dt.date(2020, 1, 2)


def test_closed_day_range_keeps_the_last_day_and_is_pushed(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in ("2018-12-31 10:00:00", "2019-01-01 00:00:00", "2015-01-01 00:00:00", "2014-12-31 23:59:59")], "t string")
    df.select(F.col("t").cast("timestamp_ntz").alias("t")).write.parquet(str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t")).filter(dates.in_days("t", "2015-01-01", "2018-12-31"))
    assert kept.count() == 2
    assert "GreaterThanOrEqual(t,2015-01-01T00:00), LessThan(t,2019-01-01T00:00)" in kept._jdf.queryExecution().executedPlan().toString()


def test_elapsed_days_floor(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    first = ts("2024-01-01 10:00:00")
    assert one(spark, dates.elapsed_days(ts("2024-01-08 09:59:59"), first)) == 6
    assert one(spark, dates.elapsed_days(ts("2024-01-08 10:00:00"), first)) == 7
    assert one(spark, dates.elapsed_days(ts("2024-01-01 09:00:00"), first)) == -1


def test_maps_and_arrays(spark):
    m = arrays.lists_to_map(F.lit("apple,milk,potatoe"), F.lit("fruit,dairy,vegetable"))
    fixed = arrays.rename_key(m, "potatoe", "potato")
    assert one(spark, arrays.keys_with_value(fixed, "vegetable")) == ["potato"]
    prices = F.array(*[F.lit(x) for x in (990, 1150, 820, 890, 1350, 750, 1040, 1280)])
    assert one(spark, arrays.count_above(prices, 1000)) == 4
    assert one(spark, arrays.share_above(prices, 1000)) == 0.5
    assert one(spark, arrays.share_above(F.array().cast("array<int>"), 1000)) is None


@pytest.mark.parametrize("z", [-6.0, -1.3, 0.0, 0.5, 1.959964, 4.0, 8.0])
def test_normal_tail(spark, z):
    exact = 0.5 * math.erfc(z / math.sqrt(2))
    assert one(spark, distributions.normal_sf(F.lit(z))) == pytest.approx(exact, rel=1e-8, abs=1e-15)


@pytest.mark.parametrize("p", [1e-6, 0.01, 0.3, 0.5, 0.8, 0.975, 0.999999])
def test_normal_quantile(spark, p):
    assert one(spark, distributions.normal_quantile(F.lit(p))) == pytest.approx(NormalDist().inv_cdf(p), abs=1e-9)


# closed forms: one degree of freedom is Cauchy; two and four have elementary tails
def student_exact(t, nu):
    if nu == 1:
        return 0.5 - math.atan(t) / math.pi
    if nu == 2:
        return 0.5 - t / (2 * math.sqrt(2 + t * t))
    x = t / math.sqrt(4 + t * t)
    return 0.5 - 0.75 * (x - x ** 3 / 3)


@pytest.mark.parametrize("nu", [1, 2, 4])
@pytest.mark.parametrize("t", [-2.0, 0.0, 0.7, 3.0, 30.0])
def test_student_tail_few_degrees(spark, nu, t):
    assert one(spark, distributions.student_sf(F.lit(t), F.lit(nu))) == pytest.approx(student_exact(t, nu), rel=1e-6, abs=1e-12)


def test_student_tail_many_degrees(spark):
    assert one(spark, distributions.student_sf(F.lit(2.0), F.lit(35.5))) == pytest.approx(0.02659825573, abs=1e-10)
    normal = 0.5 * math.erfc(1.5 / math.sqrt(2))
    assert one(spark, distributions.student_sf(F.lit(1.5), F.lit(1e7))) == pytest.approx(normal, abs=1e-7)
