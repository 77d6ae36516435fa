from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from metricloom.operators import attach, quantiles
from metricloom.operators.aggregates import describe
from metricloom.operators.outliers import flag_outliers
from metricloom.plans import REGISTRY

N = 40_000


@contextmanager
def shuffled(spark):
    """No table is small enough to be broadcast by its size, and partitions stay as they are dealt."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture
def hot(spark, monkeypatch):
    monkeypatch.setattr(attach, "HOT_ROWS", 500, raising=False)
    with shuffled(spark):
        yield spark.range(N).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, F.lit(None)).otherwise((F.col("id") % 400).cast("string")).alias("k"),
                                    F.col("id").cast("double").alias("v"))


def largest_share(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] / N


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_hot_key_are_dealt_to_many_tasks(hot):
    brackets = hot.groupBy("k").agg(F.count("v").alias("_n"), F.min("v").alias("_lo0"))
    got = quantiles._attached(hot.withColumnRenamed("v", "_v"), brackets, ["k"])
    assert largest_share(got) < 0.5
    assert "SortMergeJoin" not in plan(got)             # which holds and sorts all rows of its tasks


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attached_gives_what_the_plain_join_gives(hot, rows, how):
    table = hot.where("k is null or k <> '20'").groupBy("k").agg(F.sum("v").alias("s"))
    got, want = (join(hot, table, ["k"], how) for join in (attach.attached, attach.null_safe_join))
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_flags_of_a_hot_key_without_sorting_its_rows(hot):
    got = flag_outliers(hot, "v", ["k"])
    assert "SortMergeJoin" not in plan(got)
    assert got.count() == N


def test_describe_gives_hot_columns_without_sorting_their_rows(hot):
    got = describe(hot, ["v"], ["k"])
    assert plan(got).count("SortMergeJoin") <= 1        # of the report's own rows
    found = {r.k: (r["count"], r.q50) for r in got.collect()}
    assert found["hot"] == (N * 9 // 10, 20_000.0)


def test_estimates_meet_rows_of_hot_keys_without_sorting_them(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(attach, "HOT_ROWS", 500, raising=False)
    spark.range(N).select(F.lit("A").alias("l_returnflag"), F.col("id").cast("double").alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    with shuffled(spark):
        got = REGISTRY["approximate_quantiles"].run(spark, str(tmp_path))
        assert "SortMergeJoin" not in plan(got)
        assert [tuple(r) for r in got.collect()] == [("A", N, True)]
