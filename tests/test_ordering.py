import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.operators.attach import with_group_totals, with_scalars, with_share
from metricloom.operators.ordering import (
    _ranged, arg_max, order_by, range_count, running_counts, top_k, top_n_per_group, with_ordinal, with_position, with_previous,
)


def events(spark):
    rng = np.random.default_rng(2)
    n = 4000
    pdf = pd.DataFrame({"id": np.arange(n), "u": np.where(rng.random(n) < 0.35, 0, rng.integers(1, 40, n)),
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20 * 24, n), "h")})
    return pdf, spark.createDataFrame(pdf).repartition(5)


RANGES = [1, 4, 37]


@pytest.mark.parametrize("ranges", RANGES)
def test_ordinal_of_a_hot_user(spark, ranges):
    pdf, df = events(spark)
    want = pdf.sort_values(["u", "ts", "id"]).groupby("u").cumcount() + 1
    got = with_ordinal(df, "u", ["ts", "id"], "n", ranges=ranges).toPandas().set_index("id").n
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("ranges", RANGES)
def test_previous_row_crosses_ranges(spark, ranges):
    pdf, df = events(spark)
    want = pdf.sort_values(["u", "ts", "id"]).groupby("u").id.shift()
    got = with_previous(df, "u", ["ts", "id"], "id", "prev", ranges=ranges).toPandas().set_index("id").prev
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_ranges_divide_a_hot_key_and_equal_order_values(spark):
    """Nine tenths of the rows are one user at one time; no range holds more than a few percent, and places are whole."""
    df = spark.range(10_000, numPartitions=4).select("id", F.when(F.col("id") < 9000, 0).otherwise(F.col("id")).alias("u"), F.lit(1).alias("t"))
    held = _ranged(df, "u", ["t"], ranges=32)
    assert held.groupBy("_part").count().agg(F.max("count")).first()[0] < 900
    got = with_ordinal(df, "u", ["t"], "n", ranges=32).where("u = 0").agg(F.count("n"), F.countDistinct("n"), F.max("n"), F.min("n")).first()
    assert tuple(got) == (9000, 9000, 9000, 1)


def test_one_shuffle_of_the_rows(spark):
    """What is left of the plan reads the written ranges; the table is never exchanged again."""
    df = spark.range(1000).withColumn("u", F.col("id") % 7)
    for out in (with_ordinal(df, "u", ["id"], "n"), with_previous(df, "u", ["id"], "id", "p"), running_counts(df, "id", ["u"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "RangePartitioning" not in plan and "rangepartitioning" not in plan and "BroadcastHashJoin" in plan


def test_more_files_make_more_ranges(spark, tmp_path):
    spark.range(200_000).withColumn("x", F.rand(1)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    few, many = range_count(df, 1 << 20), range_count(df.filter("id > 5").groupBy("id").agg(F.sum("x")), 1 << 14)
    assert few == 4 and many > 50
    assert range_count(spark.range(5)) == 4


@pytest.mark.parametrize("ranges", RANGES)
def test_null_and_nan_keys_keep_their_rows(spark, ranges):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "u string, t int")
    assert sorted(r.n for r in with_ordinal(df, "u", ["t"], "n", ranges=ranges).collect()) == [1, 1, 2]
    df = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (0.0, 3), (-0.0, 4), (None, 5), (None, 6)], "u double, t int")
    assert {r.t: r.n for r in with_ordinal(df, "u", ["t"], "n", ranges=ranges).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1, 6: 2}
    assert {r.t: r.p for r in with_previous(df, "u", ["t"], "t", "p", ranges=ranges).collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: 5}
    assert with_ordinal(df.limit(0), "u", ["t"], "n").collect() == []


@pytest.mark.parametrize("ranges", RANGES)
def test_running_counts_over_many_ranges(spark, ranges):
    rng = np.random.default_rng(3)
    values = np.unique(np.round(rng.normal(size=3000), 3))
    pdf = pd.DataFrame({"x": values, "a": rng.integers(0, 5, len(values)), "b": rng.integers(0, 5, len(values))})
    got = running_counts(spark.createDataFrame(pdf).repartition(4), "x", ["a", "b"], ranges=ranges).toPandas().sort_values("x")
    assert (got.a_before.values == np.concatenate([[0], pdf.a.cumsum().values[:-1]])).all()
    assert (got.b_before.values == np.concatenate([[0], pdf.b.cumsum().values[:-1]])).all()


def test_positions_stay_when_the_cache_is_dropped(spark):
    df = spark.range(5000, numPartitions=6).withColumn("x", F.col("id") % 3)
    placed = with_position(order_by(df, "x"))
    first = {r.id: r.position for r in placed.collect()}
    spark.catalog.clearCache()
    assert {r.id: r.position for r in placed.collect()} == first
    assert sorted(first.values()) == list(range(1, 5001))
    assert all(first[i] <= 1667 for i in first if i % 3 == 0)


def test_top_lists_put_null_last(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", 2), ("c", 5), ("d", 5)], "k string, n int")
    assert [r.k for r in top_k(df, 2, "-n", "k").collect()] == ["c", "d"]
    assert [r.k for r in order_by(df, "-n", "k").collect()] == ["c", "d", "b", "a"]
    assert [r.k for r in order_by(df, "n", "k").collect()] == ["b", "c", "d", "a"]


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    top = top_n_per_group(df, 2, ["g"], "-v")
    assert sorted(r.v for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    plan = top_n_per_group(df, 2, ["g"], "-v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_arg_max_takes_smallest_key_on_ties(spark):
    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", None)], "k string, n int")
    assert tuple(arg_max(df, "k", "n").first()) == ("a", 3)


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 3), ("y", "a", 6), (None, "a", 10)], "g string, k string, n int")
    for small in (False, True):
        got = with_share(df, "n", "s", by=["g"], small=small).collect()
        assert {(r.g, r.k): r.s for r in got} == {("x", "a"): 0.25, ("x", "b"): 0.75, ("y", "a"): 1.0, (None, "a"): 1.0}
        assert sum(r.s for r in with_share(df, "n", "s", small=small).collect()) == 1.0


def test_totals_are_taken_before_a_later_filter(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id int, flag int")
    out = with_scalars(df, df.agg(F.count("*").alias("n"))).filter("flag = 0")
    assert out.first()["n"] == 3
    assert with_group_totals(df, ["flag"], k=F.count("*")).filter("id = 2").first()["k"] == 2


def test_no_raw_rows_in_a_global_window(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    plan = with_share(df, "v", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
