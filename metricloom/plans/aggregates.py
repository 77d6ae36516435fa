"""Grouped summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from metricloom.functions.dates import day, month_start, week_start
from metricloom.functions.numbers import ratio
from metricloom.operators.aggregates import (
    QUARTILES, column_totals, describe, distinct_counts as count_distinct_values, drill_down, period_rollup, summarise, value_counts,
    with_empty_groups,
)
from metricloom.operators.attach import attached, null_safe_join, with_share
from metricloom.operators.cleaning import group_mode
from metricloom.operators.ordering import arg_max
from metricloom.operators.quantiles import quantiles
from metricloom.plans.bindings import SALES, money, sales
from metricloom.plans.registry import query


@query("AGG1", """SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_extendedprice) AS low,
  max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS mean FROM lineitem""")
def totals_overall(t):
    p = "l_extendedprice"
    return t.lineitem.agg(F.count("*").alias("n"), F.round(F.sum(p), 2).alias("total"), F.min(p).alias("low"),
                          F.max(p).alias("high"), F.round(F.avg(p), 4).alias("mean"))


@query("AGG2", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
  min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1, 2""")
def totals_by_group(t):
    return summarise(t.lineitem, ["l_returnflag", "l_linestatus"], n=F.count("*"), quantity=F.round(F.sum("l_quantity"), 2),
                     low=F.min("l_extendedprice"), high=F.max("l_extendedprice"), mean_discount=F.round(F.avg("l_discount"), 6))


@query("AGG3", """SELECT l_returnflag, count(*) AS n_rows, count(nullif(l_discount, 0)) AS n_discounted FROM lineitem GROUP BY 1""")
def counts_and_nulls(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n_rows"),
                                                  F.count(F.nullif(F.col("l_discount"), F.lit(0.0))).alias("n_discounted"))


@query("AGG4", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def distinct_counts(t):
    out = count_distinct_values(t.events.withColumn("day", day("ts")), ["event_type"], ["user_id", "day"])
    return out.withColumnsRenamed({"n_user_id": "users", "n_day": "days"})


def _near(column: str) -> str:
    return f"abs(approx_count_distinct({column}) - count(DISTINCT {column})) <= 0.2 * count(DISTINCT {column})"


@query("AGG4", f"SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events, {_near('user_id')} AND {_near('event_id')} AS near FROM events GROUP BY 1")
def approximate_distinct_counts(t):
    # beside the exact counts: whether the estimates lie within ten standard errors, on either engine
    keys, columns = ["event_type"], {"user_id": "users", "event_id": "events"}
    guess = count_distinct_values(t.events, keys, list(columns), rsd=0.02).withColumnsRenamed({f"n_{c}": f"g_{c}" for c in columns})
    both = null_safe_join(count_distinct_values(t.events, keys, list(columns)), guess, keys)
    near = reduce(lambda a, b: a & b, [F.abs(F.col(f"g_{c}") - F.col(f"n_{c}")) <= 0.2 * F.col(f"n_{c}") for c in columns])
    return both.select(*keys, *[F.col(f"n_{c}").alias(n) for c, n in columns.items()], near.alias("near"))


@query("AGG5", """SELECT ts::DATE AS d, count(*) FILTER (WHERE event_type = 'error') AS errors,
  count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def filtered_counts(t):
    e = t.events.withColumn("d", day("ts"))
    per_user = e.groupBy("d", "user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"),
                                             F.max((F.col("event_type") == "purchase").cast("int")).alias("b"))
    return per_user.groupBy("d").agg(F.sum("e").alias("errors"), F.sum("b").alias("buyers"), F.count("user_id").alias("users"))


@query("AGG6", """SELECT round(count(CASE WHEN r_name = 'EUROPE' THEN 1 END) * 100.0 / count(*), 4) AS europe_percent
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def conditional_percent(t):
    c = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    return c.agg(F.round(ratio(F.count(F.when(F.col("r_name") == "EUROPE", 1)) * 100, F.count("*")), 4).alias("europe_percent"))


@query("AGG7 WIN3", """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total,
  round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1""")
def share_of_grand_total(t):
    out = with_share(summarise(t.lineitem, ["l_returnflag"], total=F.sum("l_extendedprice")), "total", "share", small=True)
    return out.select("l_returnflag", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


@query("AGG9", """SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS median, quantile_disc(l_extendedprice, 0.99) AS p99,
  quantile_disc(l_extendedprice, 0.01) AS p01 FROM lineitem GROUP BY 1""")
def discrete_percentiles(t):
    return quantiles(t.lineitem, "l_extendedprice", {"median": 0.5, "p99": 0.99, "p01": 0.01}, ["l_returnflag"], kind="discrete")


@query("AGG9", """SELECT quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.99) AS p99 FROM events""")
def discrete_percentiles_overall(t):
    return quantiles(t.events, "value", {"median": 0.5, "p99": 0.99}, kind="discrete")


@query("AGG10", """SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1""")
def interpolated_quantiles(t):
    q = quantiles(t.events, "value", QUARTILES, ["event_type"])
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in QUARTILES])


@query("AGG10", """SELECT l_linenumber, round(median(l_quantity), 6) AS median FROM lineitem GROUP BY 1""")
def median_of_few_values(t):
    # at most 50 different quantities
    q = quantiles(t.lineitem, "l_quantity", {"median": 0.5}, ["l_linenumber"], method="counts")
    return q.withColumn("median", F.round("median", 6))


_GUESSES = ", ".join(f"approx_quantile(l_extendedprice, {p}) AS {c}" for c, p in QUARTILES.items())
_NEAR = " AND ".join(f"abs(count(*) FILTER (WHERE l_extendedprice <= {c})::DOUBLE / count(*) - {p}) <= 0.02" for c, p in QUARTILES.items())


@query("AGG10", f"""WITH g AS (SELECT l_returnflag, {_GUESSES} FROM lineitem GROUP BY 1)
  SELECT l_returnflag, count(*) AS n, {_NEAR} AS near FROM lineitem JOIN g USING (l_returnflag) GROUP BY l_returnflag, {', '.join(QUARTILES)}""")
def approximate_quantiles(t):
    # whether the share of rows up to each estimate lies within 0.02 of the share asked for, on either engine
    rows = attached(t.lineitem, quantiles(t.lineitem, "l_extendedprice", QUARTILES, ["l_returnflag"], method="approx"), ["l_returnflag"])
    shares = [F.abs(F.count_if(F.col("l_extendedprice") <= F.col(c)) / F.count("*") - p) <= 0.02 for c, p in QUARTILES.items()]
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), reduce(lambda a, b: a & b, shares).alias("near"))


@query("AGG11", """SELECT event_type, round(stddev_samp(value), 6) AS std, round(var_samp(value), 6) AS variance FROM events GROUP BY 1""")
def sample_deviation(t):
    return t.events.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.var_samp("value"), 6).alias("variance"))


@query("AGG12", """SELECT p_brand, count(*) AS n_parts, round(avg(p_retailprice), 4) AS mean_price, max(p_size) AS largest,
  count(DISTINCT p_type) AS types FROM part GROUP BY 1""")
def several_named_aggregates(t):
    return summarise(t.part, ["p_brand"], n_parts=F.count("*"), mean_price=F.round(F.avg("p_retailprice"), 4),
                     largest=F.max("p_size"), types=F.count_distinct("p_type"))


@query("AGG13", """SELECT o_custkey, c_name, c_mktsegment, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def dependent_columns_in_key(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_custkey", "c_name", "c_mktsegment").agg(F.count("*").alias("n_orders"))


@query("AGG14", """SELECT p_brand, p_type FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r
  FROM part GROUP BY 1, 2) WHERE r = 1""")
def most_frequent_per_group(t):
    return group_mode(t.part, "p_type", ["p_brand"])


@query("AGG15", """SELECT c_mktsegment, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share
  FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer) WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def counts_per_value(t):
    c = t.customer.withColumn("c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return value_counts(c, "c_mktsegment", normalize=True).withColumn("share", F.round("share", 6))


@query("AGG16", "SELECT p_type, p_brand, count(*) AS n_rows FROM part GROUP BY 1, 2")
def counts_per_value_pair(t):
    return value_counts(t.part, "p_type", "p_brand")


DESCRIBE = """count({x}) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x})::DOUBLE AS min,
  round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, round(quantile_cont({x}, 0.75), 6) AS q75, max({x})::DOUBLE AS max"""


def rounded(df, columns=("mean", "std", "q25", "q50", "q75")):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("AGG17", f"""SELECT 'l_quantity' AS "column", {DESCRIBE.format(x='l_quantity')} FROM lineitem UNION ALL
  SELECT 'l_extendedprice', {DESCRIBE.format(x='l_extendedprice')} FROM lineitem""")
def describe_columns(t):
    return rounded(describe(t.lineitem, ["l_quantity", "l_extendedprice"]))


@query("AGG17", f"""SELECT o_orderstatus, 'o_totalprice' AS "column", {DESCRIBE.format(x='o_totalprice')} FROM orders GROUP BY 1""")
def describe_by_group(t):
    return rounded(describe(t.orders, ["o_totalprice"], ["o_orderstatus"]))


@query("AGG18", """SELECT m::INT AS month, count(o_orderkey) AS n_orders FROM range(1, 13) r(m)
  LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') ON month(o_orderdate) = m GROUP BY 1""")
def months_without_rows(t):
    recent = t.orders.filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    counts = recent.groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n_orders"))
    domain = t.spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return with_empty_groups(counts, domain, ["month"], {"n_orders": 0})


@query("AGG19", """SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_custkey =
  (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def rows_of_the_largest_key(t):
    best = arg_max(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "n")
    return t.orders.join(best, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice", "o_custkey")


@query("AGG20", """SELECT round(avg(users), 6) AS mean_daily_users, round(avg(mean_value), 6) AS mean_of_daily_means
  FROM (SELECT ts::DATE, count(DISTINCT user_id) AS users, avg(value) AS mean_value FROM events GROUP BY 1)""")
def aggregate_of_aggregates(t):
    per_user = t.events.groupBy(day("ts").alias("d"), "user_id").agg(F.sum("value").alias("s"), F.count("value").alias("k"))
    daily = per_user.groupBy("d").agg(F.count("user_id").alias("users"), ratio(F.sum("s"), F.sum("k")).alias("m"))
    return daily.agg(F.round(F.avg("users"), 6).alias("mean_daily_users"), F.round(F.avg("m"), 6).alias("mean_of_daily_means"))


@query("AGG21", """SELECT date_trunc('quarter', o_orderdate)::DATE AS quarter_start, upper(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def group_by_expression(t):
    return t.spark.sql("""SELECT cast(date_trunc('quarter', o_orderdate) AS date) AS quarter_start, upper(o_orderstatus) AS status,
      count(*) AS n FROM {orders} GROUP BY quarter_start, 2""", orders=t.orders)


@query("AGG22", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_pairs(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("AGG23 MET45", " UNION ALL ".join(f"SELECT '{m}' AS measure, round(sum({m}), 2) AS total, count(*) FILTER (WHERE {m} <> 0) AS non_zero FROM lineitem"
                                   for m in MEASURES))
def wide_measures_as_ranking(t):
    return column_totals(t.lineitem, MEASURES).withColumn("total", F.round("total", 2)).orderBy(F.desc("total"))


@query("AGG24", f"""SELECT r_name, n_name, o_orderstatus, (3 - grouping(r_name) - grouping(n_name) - grouping(o_orderstatus))::INT AS level,
  count(*) AS n_lines, round(sum(revenue), 2) AS revenue FROM ({SALES}) GROUP BY ROLLUP (r_name, n_name, o_orderstatus)""")
def hierarchy_totals(t):
    # sum once per finest level, then roll the few sums up, so no sale line is copied per level
    finest = sales(t).groupBy("r_name", "n_name", "o_orderstatus").agg(F.count("*").alias("k"), F.sum("revenue").alias("s"))
    return drill_down(finest, ["r_name", "n_name", "o_orderstatus"], n_lines=F.sum("k"), revenue=F.round(F.sum("s"), 2))


def _rollup(unit):
    return f"""SELECT date_trunc('{unit}', o_orderdate)::DATE AS period, count(*) AS n_orders, count(DISTINCT o_custkey) AS users,
      round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice), 2) / count(*) AS per_order FROM orders GROUP BY 1"""


def _rolled(t, period):
    out = period_rollup(t.orders, period, "o_custkey", n_orders=F.count("*"), total=F.sum("o_totalprice"))
    out = out.withColumn("total", F.round("total", 2))
    return out.withColumn("per_order", ratio("total", "n_orders"))


@query("AGG25", _rollup("week"))
def weekly_rollup(t):
    return _rolled(t, week_start("o_orderdate"))


@query("AGG25", _rollup("month"))
def monthly_rollup(t):
    return _rolled(t, month_start("o_orderdate"))


@query("AGG25", _rollup("year"))
def yearly_rollup(t):
    return _rolled(t, F.trunc("o_orderdate", "year"))


@query("AGG2", """SELECT p_type, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
  FROM lineitem JOIN (SELECT p_partkey, nullif(p_type, 'PROMO') AS p_type FROM part) ON l_partkey = p_partkey WHERE p_type IS NOT NULL GROUP BY 1""")
def groups_without_null_keys(t):
    part = t.part.select("p_partkey", F.nullif(F.col("p_type"), F.lit("PROMO")).alias("p_type"))
    joined = t.lineitem.withColumn("r", money()).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return summarise(joined, ["p_type"], dropna_keys=True, n_lines=F.count("*"), revenue=F.round(F.sum("r"), 2))
