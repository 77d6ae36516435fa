"""Row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import in_days
from metricloom.functions.text import contains_any
from metricloom.operators.attach import scalar_of
from metricloom.operators.cleaning import any_missing
from metricloom.operators.segments import collapse_small, with_size_class
from metricloom.plans.bindings import money
from metricloom.plans.registry import query


@query("FLT1", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 OR o_orderpriority = '1-URGENT'")
def filter_and_or(t):
    return t.orders.filter(((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000))
                           | (F.col("o_orderpriority") == "1-URGENT"))


@query("FLT2", "SELECT event_id, ts, event_type, value FROM events WHERE event_type IN ('click', 'purchase')")
def filter_in_list(t):
    return t.events.filter(F.col("event_type").isin("click", "purchase")).select("event_id", "ts", "event_type", "value")


@query("FLT3", """SELECT event_type, count(*) AS n FROM (SELECT nullif(event_type, 'view') AS event_type FROM events)
  WHERE NOT event_type = 'error' GROUP BY 1""")
def filter_not_equal_drops_null(t):
    e = t.events.withColumn("event_type", F.nullif(F.col("event_type"), F.lit("view")))
    return e.filter(~(F.col("event_type") == "error")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("FLT4", """SELECT 'closed' AS kind, count(*) AS n FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
  UNION ALL SELECT 'half open', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
  UNION ALL SELECT 'numbers', count(*) FROM orders WHERE o_totalprice BETWEEN 1000 AND 100000""")
def filter_ranges(t):
    d = F.col("o_orderdate")
    kinds = {
        # keeps the whole last day, also for moments after its midnight
        "closed": in_days(d, "1996-01-01", "1998-12-31"),
        "half open": (d >= F.lit("1996-01-01").cast("timestamp_ntz")) & (d < F.lit("1999-01-01").cast("timestamp_ntz")),
        "numbers": F.col("o_totalprice").between(1000, 100000),
    }
    one = t.orders.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    return one.unpivot([], list(kinds), "kind", "n")


@query("FLT5", """SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority
  FROM orders) WHERE o_orderstatus IS NULL OR o_orderpriority IS NULL""")
def filter_any_missing(t):
    o = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
                        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))
    return o.filter(any_missing(["o_orderstatus", "o_orderpriority"]))


@query("FLT6", "SELECT count(*) AS n, round(sum(d), 4) AS total FROM (SELECT nullif(l_discount, 0) AS d FROM lineitem) WHERE d IS NOT NULL")
def filter_not_null(t):
    return (t.lineitem.select(F.nullif(F.col("l_discount"), F.lit(0.0)).alias("d")).filter(F.col("d").isNotNull())
            .agg(F.count("*").alias("n"), F.round(F.sum("d"), 4).alias("total")))


@query("FLT7 JN9", """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value <> 0)""")
def filter_in_subquery(t):
    buyers = t.events.filter((F.col("event_type") == "purchase") & (F.col("value") != 0)).select(F.col("user_id").alias("c_custkey"))
    return t.customer.join(buyers, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("FLT8", """SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem
  WHERE l_extendedprice > (SELECT avg(l_extendedprice) FROM lineitem) AND l_quantity < (SELECT max(l_quantity) FROM lineitem)""")
def filter_by_scalar(t):
    limits = t.lineitem.agg(F.avg("l_extendedprice").alias("mean_price"), F.max("l_quantity").alias("max_quantity"))
    lim = F.col("lim")
    return (t.lineitem.withColumn("lim", scalar_of(limits))
            .filter((F.col("l_extendedprice") > lim["mean_price"]) & (F.col("l_quantity") < lim["max_quantity"]))
            .agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")))


@query("FLT9", """SELECT count(*) AS kept, count(v) AS known FROM (SELECT CASE WHEN event_type = 'view' THEN NULL
  WHEN event_type = 'error' THEN 0 ELSE value END AS v FROM events) WHERE v IS NULL OR v <> 0""")
def filter_not_zero_keeps_unknown(t):
    v = F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") != "view", F.col("value"))
    return (t.events.select(v.alias("v")).filter(F.col("v").isNull() | (F.col("v") != 0))
            .agg(F.count("*").alias("kept"), F.count("v").alias("known")))


@query("FLT10", """SELECT l_suppkey, count(*) AS n_lines FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem
  GROUP BY 1 HAVING sum(l_quantity) >= (SELECT sum(l_quantity) / count(DISTINCT l_suppkey) FROM lineitem)) GROUP BY 1""")
def filter_by_computed_keys(t):
    sold = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    keys = sold.filter(F.col("q") >= sold.agg(F.sum("q") / F.count("l_suppkey")).scalar())      # at least the mean supplier's
    return (t.lineitem.join(keys.select("l_suppkey"), "l_suppkey", "left_semi")
            .groupBy("l_suppkey").agg(F.count("*").alias("n_lines")))


@query("FLT11", """SELECT o_orderstatus, count(*) AS n_orders FROM orders WHERE o_custkey NOT IN
  (SELECT user_id FROM events) GROUP BY 1""")
def filter_out_computed_keys(t):
    seen = t.events.select(F.col("user_id").alias("o_custkey"))
    return t.orders.join(seen, "o_custkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"))


@query("FLT12 STR4", """SELECT has_color, count(*) AS n FROM (SELECT CASE WHEN p IS NULL THEN 0 WHEN contains(p, 'red') OR contains(p, 'blue')
  THEN 1 ELSE 0 END AS has_color FROM (SELECT nullif(p_name, 'red widget') AS p FROM part)) GROUP BY 1""")
def flag_contains_any(t):
    name = F.nullif(F.col("p_name"), F.lit("red widget"))
    return t.part.groupBy(contains_any(name, ["red", "blue"]).alias("has_color")).agg(F.count("*").alias("n"))


@query("FLT13 SEG4", """WITH s AS (SELECT CASE WHEN n > 0.04::DOUBLE * (SELECT count(p_brand) FROM part) THEN b WHEN n >= 0.039::DOUBLE * (SELECT count(p_brand) FROM part) THEN 'mid' ELSE 'niche' END AS market FROM part
  JOIN (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1) ON p_brand = b)
  SELECT market, count(*) AS n_parts FROM s WHERE market NOT IN ('mid', 'niche') GROUP BY 1""")
def filter_out_collapsed_groups(t):
    # compared exactly: a substring test would also drop names that merely contain the word
    p = with_size_class(t.part, "p_brand", mass_over=0.04, mid_from=0.039, shares=True).withColumn("market", collapse_small("p_brand"))
    return p.filter(~F.col("market").isin("mid", "niche")).groupBy("market").agg(F.count("*").alias("n_parts"))


@query("FLT14", """SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1
  HAVING sum(l_extendedprice * (1 - l_discount)) > (SELECT sum(l_extendedprice * (1 - l_discount)) / count(DISTINCT l_suppkey) FROM lineitem)""")
def filter_on_aggregate(t):
    earned = t.lineitem.groupBy("l_suppkey").agg(F.sum(money()).alias("revenue"))
    above = earned.filter(F.col("revenue") > earned.agg(F.sum("revenue") / F.count("l_suppkey")).scalar())
    return above.withColumn("revenue", F.round("revenue", 2))
