"""Pivots, unpivots, stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import season
from metricloom.operators.aggregates import value_counts, with_empty_groups
from metricloom.operators.attach import with_share
from metricloom.operators.reshape import columns_like, crosstab, pivot, stack_columns, stack_tagged, zip_lists
from metricloom.plans.registry import query

FLAGS = ["A", "N", "R"]


@query("SHP1", """SELECT year(l_shipdate)::INT AS y, """ + ", ".join(
    f"coalesce(round(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}' AND l_tax > 0.07), 2), 0) AS \"{f}\"" for f in FLAGS)
    + " FROM lineitem WHERE l_tax > 0.07 GROUP BY 1")
def pivot_sum(t):
    rows = t.lineitem.filter(F.col("l_tax") > 0.07).withColumn("y", F.year("l_shipdate"))
    return pivot(rows, "y", "l_returnflag", FLAGS, F.round(F.sum("l_quantity"), 2), fill=0.0)


@query("SHP1", """SELECT p_type, """ + ", ".join(
    f"round(avg(l_discount) FILTER (WHERE l_returnflag = '{f}'), 6) AS \"{f}\"" for f in FLAGS)
    + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def pivot_mean(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return pivot(joined, "p_type", "l_returnflag", FLAGS, F.round(F.avg("l_discount"), 6))


@query("SHP2", """SELECT o_orderpriority, """ + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP")
       + " FROM orders GROUP BY 1")
def cross_table(t):
    return crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SHP3", """SELECT p_brand, """ + ", ".join(f"count(*) FILTER (WHERE p_type = '{p}') AS \"{p}\"" for p in ("ECONOMY", "LARGE", "PROMO"))
       + " FROM part GROUP BY 1")
def unstacked_counts(t):
    counts = value_counts(t.part, "p_brand", "p_type")
    return pivot(counts, "p_brand", "p_type", ["ECONOMY", "LARGE", "PROMO"], F.sum("n_rows"), fill=0)


@query("SHP4", """SELECT m::INT AS month, coalesce(n, 0) AS n_dates FROM range(1, 13) r(m) LEFT JOIN (
  SELECT month(d) AS mm, count(*) AS n FROM (SELECT o_orderdate AS d FROM orders UNION ALL
  SELECT o_orderdate + INTERVAL 60 DAY FROM orders) WHERE year(d) = 2001 GROUP BY 1) ON mm = m""")
def stacked_dates_by_month(t):
    o = t.orders.select(F.col("o_orderdate").cast("date").alias("ordered"), F.date_add("o_orderdate", 60).alias("due"))
    dates = stack_columns(o, ["ordered", "due"], "kind", "d").filter(F.year("d") == 2001)
    counts = dates.groupBy(F.month("d").alias("month")).agg(F.count("*").alias("n_dates"))
    domain = t.spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return with_empty_groups(counts, domain, ["month"], {"n_dates": 0})


SEASON = """CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'зима' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'весна'
  WHEN month(o_orderdate) IN (6, 7, 8) THEN 'лето' ELSE 'осень' END"""


@query("SHP5 MET39", " UNION ALL ".join(f"""SELECT season, {c} AS value, '{n}' AS category, round(count(*) / sum(count(*)) OVER (PARTITION BY season), 6) AS ratio
  FROM (SELECT {SEASON} AS season, * FROM orders) GROUP BY 1, 2""" for n, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))))
def stacked_category_shares(t):
    o = t.orders.withColumn("season", season("o_orderdate"))
    def part(column):
        counts = o.groupBy("season", F.col(column).alias("value")).agg(F.count("*").alias("n"))
        return with_share(counts, "n", "ratio", by=["season"], small=True).select("season", "value", F.round("ratio", 6).alias("ratio"))
    return stack_tagged({"status": part("o_orderstatus"), "priority": part("o_orderpriority")}, "category")


@query("SHP6", "SELECT l_discount, l_extendedprice FROM lineitem")
def columns_by_pattern(t):
    return t.lineitem.select(columns_like(t.lineitem, "price|discount"))


@query("SHP7", "SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def zipped_lists(t):
    def lists(column):
        counts = t.orders.groupBy(column).agg(F.count("*").alias("n"))          # a handful of codes
        both = F.sort_array(F.collect_list(F.struct(column, "n")))
        return counts.agg(both.alias("p")).select(F.col("p")[column].alias("labels"), F.col("p.n").alias("counts"))
    return zip_lists(lists("o_orderpriority").union(lists("o_orderstatus")), label="labels", n="counts")
