"""Join shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import day
from metricloom.functions.numbers import ratio
from metricloom.operators.attach import with_group_totals, with_scalars
from metricloom.plans.bindings import money, SALES, VISITS, sales, visits
from metricloom.plans.registry import query


@query("JN1", """SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def join_inner(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("JN2", """SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def join_left(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return (t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines")))


@query("JN3", """SELECT n_name, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY 1""")
def join_left_made_inner_by_filter(t):
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region.filter(F.col("r_name") == "EUROPE"), F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy("n_name").agg(F.count("*").alias("n")))


@query("JN4", """SELECT key, n_name, r_name FROM (SELECT n_regionkey AS key, n_name FROM nation) JOIN (SELECT r_regionkey AS key, r_name FROM region) USING (key)""")
def join_using(t):
    return (t.nation.select(F.col("n_regionkey").alias("key"), "n_name")
            .join(t.region.select(F.col("r_regionkey").alias("key"), "r_name"), on=["key"]))


@query("JN5", """WITH a AS (SELECT l_suppkey AS s, date_trunc('month', l_shipdate)::DATE AS m, sum(l_quantity) AS shipped FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
  b AS (SELECT l_suppkey AS s, date_trunc('month', l_shipdate)::DATE AS m, sum(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
  SELECT a.s, a.m, shipped, returned FROM a JOIN b ON a.s = b.s AND a.m = b.m""")
def join_composite_key(t):
    def part(flag, name):
        return (t.lineitem.filter(F.col("l_returnflag") == flag)
                .groupBy(F.col("l_suppkey").alias("s"), F.trunc("l_shipdate", "month").alias("m")).agg(F.sum("l_quantity").alias(name)))
    return part("N", "shipped").join(part("R", "returned"), ["s", "m"])


@query("JN6", """SELECT d, n_orders, rate FROM (SELECT o_orderdate::DATE AS d, count(*) AS n_orders FROM orders GROUP BY 1)
  LEFT JOIN (SELECT l_shipdate::DATE AS rate_day, round(avg(l_tax), 6) AS rate FROM lineitem GROUP BY 1) ON d = rate_day""")
def join_differently_named_keys(t):
    rates = t.lineitem.groupBy(day("l_shipdate").alias("rate_day")).agg(F.round(F.avg("l_tax"), 6).alias("rate"))
    per_day = t.orders.groupBy(day("o_orderdate").alias("d")).agg(F.count("*").alias("n_orders"))
    return per_day.join(rates, F.col("d") == F.col("rate_day"), "left").drop("rate_day")


@query("JN7", """WITH f AS (SELECT o_custkey AS c, min(o_orderdate)::DATE AS first_day FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
  a AS (SELECT DISTINCT o_custkey AS c, o_orderdate::DATE AS d FROM orders)
  SELECT f.c AS customer, count(*) AS later_days FROM f JOIN a ON f.c = a.c AND a.d >= f.first_day GROUP BY 1""")
def join_with_inequality(t):
    first = (t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
             .groupBy(F.col("o_custkey").alias("customer")).agg(F.min(day("o_orderdate")).alias("first_day")))
    days = t.orders.select(F.col("o_custkey").alias("c"), day("o_orderdate").alias("d")).distinct()
    return (first.join(days, (F.col("customer") == F.col("c")) & (F.col("d") >= F.col("first_day")))
            .groupBy("customer").agg(F.count("*").alias("later_days")))


@query("JN8", """SELECT event_type, count(DISTINCT user_id) AS users, (SELECT count(DISTINCT user_id) FROM events) AS all_users FROM events GROUP BY 1""")
def join_one_row_table(t):
    size = t.events.agg(F.count_distinct("user_id").alias("all_users"))
    return with_scalars(t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users")), size)


@query("JN10", """WITH bad AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount = 0.1)
  SELECT l_returnflag, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.l_suppkey = l.l_suppkey AND b.l_partkey = l.l_partkey) GROUP BY 1""")
def join_anti_pairs(t):
    bad = t.lineitem.filter(F.col("l_discount") == 0.1).select("l_suppkey", "l_partkey").distinct()
    return (t.lineitem.join(bad, ["l_suppkey", "l_partkey"], "left_anti")
            .groupBy("l_returnflag").agg(F.count("*").alias("n")))


@query("JN11", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(t):
    sold = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(sold, "o_orderkey", "left_anti").select("o_orderkey")


@query("JN12", """WITH a AS (SELECT year(o_orderdate)::INT AS y, round(sum(o_totalprice), 2) AS ordered FROM orders WHERE year(o_orderdate) < 2000 GROUP BY 1),
  b AS (SELECT year(l_shipdate)::INT AS y, round(sum(l_extendedprice), 2) AS shipped FROM lineitem WHERE year(l_shipdate) > 1996 GROUP BY 1)
  SELECT coalesce(a.y, b.y) AS y, ordered, shipped FROM a FULL JOIN b ON a.y = b.y""")
def join_full_on_year(t):
    a = (t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("ordered"))
         .filter(F.col("y") < 2000))
    b = (t.lineitem.groupBy(F.year("l_shipdate").alias("y")).agg(F.round(F.sum("l_extendedprice"), 2).alias("shipped"))
         .filter(F.col("y") > 1996))
    return a.join(b, on="y", how="full")


@query("JN13", f"SELECT r_name, count(*) AS n_lines, round(sum(revenue), 2) AS revenue FROM ({SALES}) GROUP BY 1")
def join_snowflake_chain(t):
    return sales(t).groupBy("r_name").agg(F.count("*").alias("n_lines"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("JN14", """SELECT l_orderkey, l_linenumber, round(l_extendedprice / s, 6) AS part_of_order FROM lineitem
  JOIN (SELECT l_orderkey AS k, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = k""")
def join_aggregate_to_detail(t):
    out = with_group_totals(t.lineitem, ["l_orderkey"], s=F.sum("l_extendedprice"))
    return out.select("l_orderkey", "l_linenumber", F.round(ratio("l_extendedprice", "s"), 6).alias("part_of_order"))


@query("JN15", """SELECT a.m, n_ordered, n_shipped FROM (SELECT month(o_orderdate)::INT AS m, count(*) AS n_ordered FROM orders GROUP BY 1) a
  JOIN (SELECT month(l_shipdate)::INT AS m, count(*) AS n_shipped FROM lineitem GROUP BY 1) b ON a.m = b.m""")
def join_two_aggregates(t):
    a = t.orders.groupBy(F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n_ordered"))
    b = t.lineitem.groupBy(F.month("l_shipdate").alias("m")).agg(F.count("*").alias("n_shipped"))
    return a.join(b, "m")


@query("JN13 AGG4", f"SELECT r_name, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM ({VISITS}) GROUP BY 1, 2")
def join_visits_to_dimensions(t):
    return visits(t).groupBy("r_name", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"),
                                                        F.round(F.sum("value"), 2).alias("total"))


@query("AGG8", """SELECT o_orderpriority, round(sum(r) / sum(l_quantity), 4) AS unit_price FROM (SELECT *, l_extendedprice * (1 - l_discount) AS r FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def unit_price_by_priority(t):
    joined = t.lineitem.withColumn("r", money()).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.round(ratio(F.sum("r"), F.sum("l_quantity")), 4).alias("unit_price"))
