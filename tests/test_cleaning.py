import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricloom.operators import cleaning, quality
from metricloom.operators.aggregates import distinct_counts, distinct_of, drill_down, value_counts, with_empty_groups
from metricloom.operators.attach import null_safe_join


@pytest.fixture
def games(spark):
    """Scores with sentinels, case variants, exact and near duplicates."""
    return spark.createDataFrame([
        ("A", "PS2", 2001.0, "Action", 1.0, "tbd", "K-A"),
        ("A", "PS2", 2001.0, "Action", 1.0, "tbd", "K-A"),
        ("A", "PS2", 2001.0, "ACTION", 0.5, "8.0", None),
        ("B", "DS", None, "action", 2.0, "unknown", "E"),
        ("C", "DS", 2005.0, "puzzle", None, "10", None),
        (None, "DS", 2005.0, "puzzle", 1.0, None, None),
    ], "`Name` string, Platform string, `Year of Release` double, Genre string, `EU sales` double, `User Score` string, Rating string")


def test_headers(games):
    assert cleaning.normalise_headers(games).columns == ["name", "platform", "year_of_release", "genre", "eu_sales", "user_score", "rating"]


def test_nan_becomes_null(spark):
    df = cleaning.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, None)], "a double, b int"))
    assert [tuple(r) for r in df.collect()] == [(None, 1), (2.0, None)]


def test_group_mode_fill(games, rows):
    g = cleaning.normalise_headers(games).withColumn("genre", F.lower("genre"))
    filled = cleaning.fill_with_group_mode(g, "rating", ["genre"])
    got = rows(filled.select("genre", "rating"))
    assert got.count(("action", "K-A")) == 3           # two K-A against one E
    assert got.count(("puzzle", None)) == 2            # a group without any value stays empty


def test_global_mode_replaces_sentinel(spark, rows):
    df = spark.createDataFrame([(-1,), (2007,), (2008,), (2008,), (2007,)], "y int")
    assert rows(cleaning.fill_with_mode(df, "y", F.col("y") == -1)) == [(2007,), (2007,), (2007,), (2008,), (2008,)]


def test_group_mean_fill(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, None), (None, 4.0)], "k string, v double")
    assert rows(cleaning.fill_with_group_mean(df, "v", ["k"])) == sorted(
        [("a", 1.0), ("a", 3.0), ("a", 2.0), (None, 4.0), (None, 4.0)], key=repr)


def test_row_expression_fill_propagates_null(spark, rows):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 1.0, None), (9.0, 1.0, 2.0)], "t double, a double, b double")
    assert [r[0] for r in cleaning.fill_from(df, "t", F.col("a") + F.col("b")).collect()] == [3.0, None, 9.0]


def test_keep_first_and_last_need_an_order(spark, rows):
    df = spark.createDataFrame([("u", 2, "late"), ("u", 1, "early"), ("w", 5, "only"), (None, 3, "x"), (None, 4, "y")],
                               "k string, n int, what string")
    assert rows(cleaning.keep_one(df, ["k"], ["n"]).select("what")) == [("early",), ("only",), ("x",)]
    assert rows(cleaning.keep_one(df, ["k"], ["n"], keep="last").select("what")) == [("late",), ("only",), ("y",)]
    assert cleaning.keep_one(df, ["k"], ["n"]).columns == ["k", "n", "what"]


def test_merge_near_duplicates(games, rows):
    g = cleaning.normalise_headers(games).withColumn("genre", F.lower("genre"))
    merged = cleaning.merge_near_duplicates(g, ["name", "platform", "genre"], ["eu_sales"])
    assert merged.filter("name = 'A'").first()["eu_sales"] == 2.5
    assert merged.count() == 4


def test_narrowest_types(spark, rows):
    df = spark.createDataFrame([(1, -200, 70000, 2**40), (127, 5, 1, 0)], "a long, b long, c long, d long")
    got = {r.column: r.fits_type for r in cleaning.narrowest_types(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": "tinyint", "b": "smallint", "c": "int", "d": "bigint"}


def test_missing_report_counts_and_percent(games):
    got = {r.column: (r.missing_count, r.missing_percent) for r in quality.missing_report(cleaning.normalise_headers(games)).collect()}
    assert got["rating"] == (3, 50.0) and got["name"] == (1, 16.67) and got["platform"] == (0, 0.0)


def test_null_cooccurrence_of_constant_column(games):
    got = quality.missing_cooccurrence(cleaning.normalise_headers(games), ["name", "user_score", "platform"]).collect()
    by = {(r.left_column, r.right_column): r.null_corr for r in got}
    assert by[("name", "user_score")] == pytest.approx(1.0)
    assert by[("name", "platform")] is None


def test_duplicate_summary(games):
    r = quality.duplicate_summary(games).first()
    assert (r.n_rows, r.extra_rows, r.rows_in_duplicates) == (6, 1, 2)
    assert quality.rows_in_duplicates(games, ["Platform", "Rating"]).count() == 4      # two K-A, two with no rating


def test_any_of_ignores_unknown(spark):
    df = spark.createDataFrame([(1, None), (3, 2), (None, None)], "a int, b int")
    cond = quality.any_of([F.col("a") > F.col("b"), F.col("b") > 5])
    assert [r.x for r in df.select(cond.alias("x")).collect()] == [False, True, False]


def test_row_audit(spark):
    df = spark.range(8)
    got = quality.row_audit({"all": df, "even": df.filter("id % 2 = 0")}).orderBy("step").collect()
    assert [(r.stage, r.n_rows, r.removed_percent) for r in got] == [("all", 8, 0.0), ("even", 4, 50.0)]


def test_keys_with_many(spark, rows):
    df = spark.createDataFrame([(1, "smart"), (1, "ultra"), (2, "smart"), (2, None)], "u int, tariff string")
    assert rows(quality.keys_with_many(df, "u", "tariff")) == [(1, 2)]


def test_value_counts_drops_null_by_default(games, rows):
    g = games.select(F.col("Rating").alias("r"))
    assert rows(value_counts(g, "r")) == [("E", 1), ("K-A", 2)]
    assert (None, 3) in rows(value_counts(g, "r", dropna=False))
    assert sum(r.share for r in value_counts(g, "r", normalize=True).collect()) == pytest.approx(1.0)


def test_empty_groups_stay(spark, rows):
    counts = spark.createDataFrame([(3, 5)], "m int, n int")
    domain = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    out = rows(with_empty_groups(counts, domain, ["m"], {"n": 0}))
    assert len(out) == 12 and (3, 5) in out and (12, 0) in out


def test_distinct_of_skips_null_entities(spark):
    df = spark.createDataFrame([("d", "u1", True), ("d", "u1", False), ("d", "u2", None), ("d", None, True)], "d string, u string, o boolean")
    r = distinct_of(df, ["d"], "u", buyers=F.col("o")).first()
    assert (r.entities, r.buyers) == (2, 1)
    r = distinct_counts(df, ["d"], ["u", "o"]).first()
    assert (r.n_u, r.n_o) == (2, 2)


def test_drill_down_levels(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "a", 4)], "c string, e string, n int")
    got = {(r.level, r.c, r.e): r.total for r in drill_down(df, ["c", "e"], total=F.sum("n")).collect()}
    assert got[(0, None, None)] == 7 and got[(1, "x", None)] == 3 and got[(2, "y", "a")] == 4 and len(got) == 6


def test_null_safe_join_matches_null(spark, rows):
    a = spark.createDataFrame([(1, None), (2, "k")], "id int, k string")
    b = spark.createDataFrame([(None, 10), ("k", 20)], "k string, v int")
    assert rows(null_safe_join(a, b, ["k"])) == [(1, None, 10), (2, "k", 20)]


def test_value_range(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 0.0), (dt.date(2024, 3, 1), None)], "d date, v double")
    r = quality.value_range(df, ["d", "v"]).first()
    assert (r.min_d, r.max_d, r.min_v, r.max_v) == (dt.date(2024, 1, 1), dt.date(2024, 3, 1), 0.0, 0.0)


def test_period_rollup_counts_users_once(spark, rows):
    from metricloom.operators.aggregates import period_rollup
    df = spark.createDataFrame([(1, "u", 5.0), (1, "u", 7.0), (1, "w", 1.0), (2, None, 4.0)], "p int, u string, v double")
    assert rows(period_rollup(df, F.col("p"), "u", n=F.count("*"), total=F.sum("v"))) == [(1, 2, 3, 13.0), (2, 0, 1, 4.0)]


def test_sketched_distinct_counts(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").alias("u"))
    assert distinct_counts(df, ["g"], ["u"], rsd=0.02).first()["n_u"] == pytest.approx(20_000, rel=0.08)


def test_keep_one_edges_and_plan(spark, rows):
    df = spark.createDataFrame([("a", None, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 2, "q"), ("b", 2, "p"), (None, 3, "n"), (None, 4, "m")], "k string, n int, what string")
    assert rows(cleaning.keep_one(df, ["k"], ["n"])) == [("a", None, "x"), ("b", 2, "p"), (None, 3, "n")]
    assert rows(cleaning.keep_one(df, ["k"], ["n"], keep="last")) == [("a", 1, "z"), ("b", 2, "q"), (None, 4, "m")]
    assert rows(cleaning.keep_one(df, ["k"], ["what"])) == [("a", None, "x"), ("b", 2, "p"), (None, 4, "m")]
    assert cleaning.keep_one(df.limit(0), ["k"], ["n"]).collect() == []
    plan = cleaning.keep_one(df, ["k"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") == 2
