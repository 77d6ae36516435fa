"""Totals beside rows, ranks, running values, sorts and top lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metricloom.functions.dates import WEEKDAY_LABELS, day, days_between, month_start, weekday_label
from metricloom.functions.numbers import ratio
from metricloom.operators.aggregates import value_counts
from metricloom.operators.attach import with_group_totals, with_scalars, with_share
from metricloom.operators.cleaning import fill_with_group_mode
from metricloom.operators.ordering import (
    dense_rank_small, order_by, sorted_by_labels, top_k, top_n_per_group, with_ordinal, with_previous, with_position,
)
from metricloom.operators.product import item_value_in_top
from metricloom.plans.bindings import money
from metricloom.plans.registry import query


@query("WIN1 MET15", """SELECT all_lines, count(*) AS no_discount, round(count(*) / all_lines, 6) AS share
  FROM (SELECT count(*) OVER () AS all_lines, l_discount FROM lineitem) WHERE l_discount = 0 GROUP BY all_lines""")
def total_taken_before_filter(t):
    total = t.lineitem.agg(F.count("*").alias("all_lines"))
    some = t.lineitem.filter(F.col("l_discount") == 0).agg(F.count("*").alias("no_discount"))
    return with_scalars(some, total).withColumn("share", F.round(ratio("no_discount", "all_lines"), 6))


@query("WIN2", """SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS compatriots FROM customer""")
def count_beside_rows(t):
    return with_group_totals(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], compatriots=F.count("*"))


@query("WIN3", """SELECT r_name, c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY r_name), 6) AS share
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def share_inside_region(t):
    c = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    out = with_share(c.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n")), "n", "share", by=["r_name"], small=True)
    return out.withColumn("share", F.round("share", 6))


@query("WIN4", """SELECT d, users, max(users) OVER (ORDER BY d) AS peak FROM (SELECT ts::DATE AS d, count(DISTINCT user_id) AS users FROM events GROUP BY 1)""")
def running_peak(t):
    daily = t.events.groupBy(day("ts").alias("d")).agg(F.count_distinct("user_id").alias("users"))
    return daily.withColumn("peak", F.max("users").over(Window.orderBy("d")))      # one row per day


@query("WIN5", """SELECT m, dd, n, max(n) OVER (PARTITION BY m ORDER BY dd) AS peak FROM
  (SELECT date_trunc('month', o_orderdate)::DATE AS m, day(o_orderdate)::INT AS dd, count(*) AS n FROM orders GROUP BY 1, 2)""")
def running_peak_per_month(t):
    daily = t.orders.groupBy(month_start("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("dd")).agg(F.count("*").alias("n"))
    return daily.withColumn("peak", F.max("n").over(Window.partitionBy("m").orderBy("dd")))


@query("WIN6", """SELECT l_suppkey, n, max(n) OVER () AS largest FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def overall_maximum_beside_rows(t):
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return with_scalars(counts, counts.agg(F.max("n").alias("largest")))


@query("WIN7", """SELECT m, n, dense_rank() OVER (ORDER BY n DESC)::INT AS rank_n, dense_rank() OVER (ORDER BY v DESC)::INT AS rank_value
  FROM (SELECT month(o_orderdate)::INT AS m, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)""")
def two_independent_ranks(t):
    months = t.orders.groupBy(F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("v"))
    return dense_rank_small(dense_rank_small(months, "n", "rank_n"), "v", "rank_value").drop("v")


@query("WIN8", """SELECT DISTINCT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders""")
def per_user_totals(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("WIN9", """SELECT grp, event_type, users, total_in_group, round(users / total_in_group, 6) AS share FROM (SELECT *, (sum(users) OVER (PARTITION BY grp))::BIGINT AS total_in_group
  FROM (SELECT c_mktsegment AS grp, event_type, count(DISTINCT user_id) AS users FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2))""")
def group_total_beside_rows(t):
    e = t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"))
    users = e.groupBy(F.col("c_mktsegment").alias("grp"), "event_type").agg(F.count_distinct("user_id").alias("users"))
    out = with_group_totals(users, ["grp"], total_in_group=F.sum("users"))
    return out.withColumn("share", F.round(ratio("users", "total_in_group"), 6))


@query("WIN10 QUA6", """WITH p AS (SELECT p_partkey, p_brand, nullif(p_type, 'PROMO') AS p_type FROM part),
  m AS (SELECT p_brand AS b, p_type AS mode FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r
    FROM p WHERE p_type IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
  SELECT p_partkey, p_brand, coalesce(p_type, mode) AS p_type FROM p LEFT JOIN m ON p_brand = b""")
def fill_from_group_mode(t):
    p = t.part.select("p_partkey", "p_brand", F.nullif(F.col("p_type"), F.lit("PROMO")).alias("p_type"))
    return fill_with_group_mode(p, "p_type", ["p_brand"])


@query("WIN11", """SELECT l_returnflag, l_suppkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) AS r
  FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r <= 5""")
def top_five_per_group(t):
    counts = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return top_n_per_group(counts, 5, ["l_returnflag"], "-n", "l_suppkey")


@query("WIN12", """SELECT o_orderkey, o_custkey, (o_orderdate::DATE - lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INT AS days_since_prev FROM orders""")
def days_since_previous_order(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    out = with_previous(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", "prev")
    return out.select("o_orderkey", "o_custkey", days_between("o_orderdate", "prev").alias("days_since_prev"))


@query("WIN13", """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_number FROM events""")
def session_number_per_user(t):
    out = with_ordinal(t.events, "user_id", ["ts", "event_id"], "session_number")
    return out.select("event_id", "user_id", "session_number")


@query("SRT1", "SELECT c_mktsegment, c_nationkey, c_acctbal, c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_nationkey, c_acctbal DESC, c_custkey) AS position FROM customer")
def sort_mixed_directions(t):
    return with_position(order_by(t.customer.select("c_mktsegment", "c_nationkey", "c_acctbal", "c_custkey"),
                                  "c_mktsegment", "c_nationkey", "-c_acctbal", "c_custkey"))


@query("SRT2", "SELECT 15::BIGINT AS n_rows, 15::BIGINT AS n_known")
def unordered_sample(t):
    sample = t.events.limit(15)                         # any rows: only their number, and that the table has them, can be said
    known = sample.join(t.events.select("event_id"), "event_id", "left_semi")
    return sample.agg(F.count("*").alias("n_rows")).crossJoin(known.agg(F.count("*").alias("n_known")))


@query("SRT3", """SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 10""")
def top_ten_by_sum(t):
    return top_k(t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")), 10, "-total", "o_custkey")


@query("SRT4", """WITH o AS (SELECT l_suppkey, l_partkey, l_extendedprice * (1 - l_discount) AS a FROM lineitem),
  top AS (SELECT l_suppkey FROM o GROUP BY 1 ORDER BY sum(a) DESC, l_suppkey LIMIT 2)
  SELECT l_suppkey, l_partkey, round(sum(a), 2) AS ltv FROM o JOIN top USING (l_suppkey) GROUP BY 1, 2 ORDER BY ltv DESC, l_partkey LIMIT 5""")
def top_items_of_top_suppliers(t):
    items = item_value_in_top(t.lineitem, "l_suppkey", "l_partkey", money(), 2).withColumn("ltv", F.round("ltv", 2))
    return top_k(items, 5, "-ltv", "l_partkey")


@query("SRT5", """SELECT dayname(o_orderdate) AS weekday, count(*) AS n_rows, row_number() OVER (ORDER BY any_value(isodow(o_orderdate))) AS position FROM orders GROUP BY 1""")
def sort_by_weekday(t):
    counts = value_counts(t.orders.withColumn("weekday", weekday_label("o_orderdate")), "weekday")
    return with_position(sorted_by_labels(counts, "weekday", WEEKDAY_LABELS.values()))


@query("SRT6", "SELECT *, row_number() OVER (ORDER BY p_partkey, p_name, p_brand, p_type, p_size, p_retailprice) AS position FROM part")
def full_row_sort(t):
    return with_position(order_by(t.part, *t.part.columns))
