"""Revenue breakdowns, funding-style yearly metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import day, season, week_start
from metricloom.functions.numbers import ratio
from metricloom.operators.aggregates import value_counts
from metricloom.operators.attach import with_share, with_shares
from metricloom.operators.ordering import order_by, top_k
from metricloom.operators.outliers import blank_outliers, keep_large_groups
from metricloom.operators.quantiles import quantiles
from metricloom.operators.reshape import pivot, stack_columns
from metricloom.operators.revenue import growth, return_ratio, revenue_by
from metricloom.operators.segments import change_percent, collapse_small, with_size_class
from metricloom.plans.bindings import SALES, money, sales
from metricloom.plans.registry import query


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("MET30 JN13 SRT3 AGG8", f"""SELECT n_name, round(sum(revenue), 2) AS total_revenue, count(DISTINCT o_orderkey) AS total_orders, count(DISTINCT o_custkey) AS total_users,
  sum(l_quantity) AS total_tickets, round(sum(revenue) / sum(l_quantity), 6) AS one_ticket_cost FROM ({SALES}) WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY total_revenue DESC LIMIT 7""")
def top_regions_by_revenue(t):
    # lines collapse to orders and orders to buyers before each join: an order or buyer with very
    # many rows is combined map-side, and orders and buyers are counted without a distinct
    closed = t.orders.filter(F.col("o_orderstatus") == "F")
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(money()).alias("revenue"), F.sum("l_quantity").alias("tickets"))
    paid = per_order.join(closed, F.col("l_orderkey") == F.col("o_orderkey"))
    per_user = paid.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("revenue").alias("revenue"), F.sum("tickets").alias("tickets"))
    placed = (per_user.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
              .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    out = placed.groupBy("n_name").agg(
        F.round(F.sum("revenue"), 2).alias("total_revenue"), F.sum("orders").alias("total_orders"), F.count("*").alias("total_users"),
        F.sum("tickets").alias("total_tickets"), F.round(ratio(F.sum("revenue"), F.sum("tickets")), 6).alias("one_ticket_cost"))
    return top_k(out, 7, "-total_revenue", "n_name")


BASE = "round(sum({m}), 2) AS total_revenue, count(o_orderkey) AS total_orders, round(avg({m}), 6) AS avg_revenue_per_order"


def tidy(df):
    return rounded(rounded(df, "total_revenue", digits=2), "avg_revenue_per_order")


@query("MET30", f"SELECT o_orderstatus, {BASE.format(m='o_totalprice')}, count(DISTINCT o_custkey) AS total_users FROM orders GROUP BY 1")
def revenue_by_currency(t):
    return order_by(tidy(revenue_by(t.orders, ["o_orderstatus"], "o_totalprice", "o_orderkey", "o_custkey")), "-total_revenue")


@query("MET30 AGG7", f"""SELECT o_orderpriority, {BASE.format(m='o_totalprice')}, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus = 'F'), 6) AS revenue_share
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def revenue_by_device(t):
    per = revenue_by(t.orders.filter(F.col("o_orderstatus") == "F"), ["o_orderpriority"], "o_totalprice", "o_orderkey")
    return rounded(tidy(with_share(per, "total_revenue", "revenue_share", small=True)), "revenue_share")


@query("MET30", """SELECT p_type, round(sum(r), 2) AS total_revenue, count(l_orderkey) AS total_orders, round(avg(r), 6) AS avg_revenue_per_order, sum(l_quantity) AS total_tickets,
  round(sum(r) / sum(l_quantity), 6) AS one_ticket_cost, count(DISTINCT p_name) AS names, round(avg(l_quantity), 6) AS avg_tickets, round(sum(r) / sum(sum(r)) OVER (), 6) AS revenue_share
  FROM (SELECT *, l_extendedprice * (1 - l_discount) AS r FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def revenue_by_event_type(t):
    joined = t.lineitem.withColumn("r", money()).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    per = revenue_by(joined, ["p_type"], "r", "l_orderkey", tickets="l_quantity", names=F.count_distinct("p_name"), avg_tickets=F.avg("l_quantity"))
    return rounded(tidy(with_share(per, "total_revenue", "revenue_share", small=True)), "revenue_share", "one_ticket_cost", "avg_tickets")


@query("MET30 AGG25", """SELECT date_trunc('week', o_orderdate)::DATE AS week, round(sum(o_totalprice), 2) AS total_revenue, count(o_orderkey) AS total_orders, count(DISTINCT o_custkey) AS total_users,
  round(sum(o_totalprice), 2) / count(o_orderkey) AS revenue_per_order FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def revenue_by_week(t):
    closed = t.orders.filter(F.col("o_orderstatus") == "F").withColumn("week", week_start("o_orderdate"))
    out = revenue_by(closed, ["week"], "o_totalprice", "o_orderkey", "o_custkey").withColumn("total_revenue", F.round("total_revenue", 2))
    return order_by(out.withColumn("revenue_per_order", ratio("total_revenue", "total_orders")).drop("avg_revenue_per_order"), "week")


@query("MET31", """SELECT s_suppkey, s_name, round(sum(r), 2) AS total_revenue, count(*) AS total_orders, round(avg(r), 6) AS avg_revenue_per_order, sum(l_quantity) AS total_tickets, round(sum(r) / sum(l_quantity), 6) AS one_ticket_cost
  FROM (SELECT *, l_extendedprice * (1 - l_discount) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2 ORDER BY total_revenue DESC, s_suppkey LIMIT 10""")
def top_venues(t):
    per = revenue_by(t.lineitem.withColumn("r", money()), ["l_suppkey"], "r", "l_orderkey", tickets="l_quantity")
    top = top_k(rounded(tidy(per), "one_ticket_cost"), 10, "-total_revenue", "l_suppkey")
    return top.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").withColumnRenamed("l_suppkey", "s_suppkey")


@query("MET38", "SELECT month(o_orderdate)::INT AS month, count(*) AS n_rows FROM orders GROUP BY 1")
def orders_per_month(t):
    return value_counts(t.orders.withColumn("month", F.month("o_orderdate")), "month")


SEASON = """CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'зима' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'весна' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'лето' ELSE 'осень' END"""


@query("MET40 SHP1", f"""SELECT p, round(s, 6) AS "лето", round(a, 6) AS "осень", round((a - s) / s * 100, 6) AS change FROM (SELECT o_orderpriority AS p, avg(o_totalprice) FILTER (WHERE {SEASON} = 'лето') AS s,
  avg(o_totalprice) FILTER (WHERE {SEASON} = 'осень') AS a FROM orders GROUP BY 1)""")
def ticket_price_change_between_seasons(t):
    o = t.orders.withColumn("season", season("o_orderdate"))
    wide = pivot(o, F.col("o_orderpriority").alias("p"), "season", ["лето", "осень"], F.avg("o_totalprice"))
    return rounded(wide.withColumn("change", change_percent("осень", "лето")), "лето", "осень", "change")


SHARES = """SELECT {k}, unique_events, total_orders, total_revenue, round(unique_events / sum(unique_events) OVER (), 6) AS ratio_event, round(total_orders / sum(total_orders) OVER (), 6) AS ratio_order,
  round(total_revenue / sum(total_revenue) OVER (), 6) AS ratio_revenue FROM (SELECT {k}, count(DISTINCT l_partkey) AS unique_events, count(*) AS total_orders, trunc(sum(revenue))::BIGINT AS total_revenue FROM ({s}) GROUP BY 1)"""


def supply_shares(df, key, small=False):
    out = df.groupBy(key).agg(F.count_distinct("l_partkey").alias("unique_events"), F.count("*").alias("total_orders"),
                              F.sum("revenue").cast("bigint").alias("total_revenue"))
    names = {"unique_events": "ratio_event", "total_orders": "ratio_order", "total_revenue": "ratio_revenue"}
    out = with_shares(out, names, small=small)
    return rounded(out, "ratio_event", "ratio_order", "ratio_revenue")


@query("MET43", SHARES.format(k="n_name", s=SALES))
def region_shares(t):
    return order_by(supply_shares(sales(t), "n_name", small=True), "-ratio_event")


@query("MET43 NUM4", SHARES.format(k="l_suppkey", s="SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem"))
def partner_shares(t):
    return order_by(supply_shares(t.lineitem.withColumn("revenue", money()), "l_suppkey"), "-ratio_revenue", "-ratio_order")


@query("MET45", """SELECT measure, round(sum(amount), 2) AS total, count(*) FILTER (WHERE amount <> 0) AS non_zero FROM (SELECT unnest(['l_discount', 'l_tax']) AS measure, unnest([l_discount, l_tax]) AS amount
  FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def returns_by_type(t):
    tall = stack_columns(t.lineitem.filter(F.col("l_returnflag") == "R"), ["l_discount", "l_tax"], "measure", "amount")
    return tall.groupBy("measure").agg(F.round(F.sum("amount"), 2).alias("total"), F.count_if(F.col("amount") != 0).alias("non_zero"))


@query("MET46 OUT6", """SELECT year(o_orderdate)::INT AS y, round(median(o_totalprice), 6) AS median_size, count(*) AS rounds FROM orders GROUP BY 1 HAVING count(*) >= 0.1::DOUBLE * (SELECT count(*) FROM orders)""")
def yearly_median_and_count(t):
    o = keep_large_groups(t.orders.withColumn("y", F.year("o_orderdate")), "y", F.count("*"), share=0.1)
    med = quantiles(o, "o_totalprice", {"median_size": 0.5}, ["y"])
    return rounded(med.join(o.groupBy("y").agg(F.count("*").alias("rounds")), "y"), "median_size")


MARKETS = """SELECT l.*, CASE WHEN n > 0.04::DOUBLE * (SELECT count(p_brand) FROM part) THEN p_brand WHEN n >= 0.039::DOUBLE * (SELECT count(p_brand) FROM part) THEN 'mid' ELSE 'niche' END AS market, year(l_shipdate)::INT AS y FROM lineitem l JOIN part ON l_partkey = p_partkey
  JOIN (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1) ON p_brand = b"""


def markets(t):
    parts = with_size_class(t.part, "p_brand", 0.04, 0.039, shares=True).withColumn("market", collapse_small("p_brand"))
    return t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("y", F.year("l_shipdate"))


@query("MET47 FLT13", f"""SELECT market, round(a, 2) AS old_total, round(b, 2) AS new_total, round(b - a, 2) AS gain FROM (SELECT market, coalesce(sum(l_extendedprice) FILTER (WHERE y = 1997), 0) AS a,
  coalesce(sum(l_extendedprice) FILTER (WHERE y = 1998), 0) AS b FROM ({MARKETS}) WHERE market NOT IN ('mid', 'niche') GROUP BY 1) WHERE b > a""")
def growing_segments(t):
    mass = markets(t).filter(~F.col("market").isin("mid", "niche"))
    return rounded(growth(mass, "market", "y", "l_extendedprice", 1997, 1998), "old_total", "new_total", "gain", digits=2)


@query("MET47 SRT3", f"""WITH g AS (SELECT market, sum(l_extendedprice) FILTER (WHERE y = 1997) AS a, sum(l_extendedprice) FILTER (WHERE y = 1998) AS b,
  coalesce(sum(l_extendedprice) FILTER (WHERE y = 1995), 0) AS first, coalesce(sum(l_extendedprice) FILTER (WHERE y = 2000), 0) AS last FROM ({MARKETS}) WHERE market NOT IN ('mid', 'niche') GROUP BY 1)
  SELECT market, round(last - first, 2) AS gain FROM g WHERE b > a ORDER BY gain DESC, market LIMIT 5""")
def fastest_growing_segments(t):
    mass = markets(t).filter(~F.col("market").isin("mid", "niche"))
    of = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("l_extendedprice"))), F.lit(0.0))
    totals = mass.groupBy("market").agg(*[of(y).alias(f"y{y}") for y in (1995, 1997, 1998, 2000)]).filter("y1998 > y1997")
    return top_k(totals.select("market", F.round(F.col("y2000") - F.col("y1995"), 2).alias("gain")), 5, "-gain", "market")


FUNDS = ["l_discount", "l_tax"]


def _side(where, year, factor):
    return f"SELECT y, type, sum(amount){factor} AS amount FROM (SELECT {year} AS y, unnest(['l_discount', 'l_tax']) AS type, unnest([l_discount, l_tax]) AS amount FROM lineitem WHERE {where}) GROUP BY 1, 2"


RATIOS = f"""SELECT coalesce(i.y, r.y) AS y, coalesce(i.type, r.type) AS type, i.amount AS invested, r.amount * 1e3 AS returned, r.amount * 1e3 / nullif(i.amount, 0) AS return_ratio
  FROM ({_side("l_returnflag <> 'R'", "year(l_shipdate)::INT * 100 + month(l_shipdate)::INT", "")}) i FULL JOIN ({_side("l_returnflag = 'R' AND l_quantity > 45", "year(l_shipdate)::INT * 100 + month(l_shipdate)::INT", "")}) r
  ON i.y = r.y AND i.type = r.type"""


@query("MET48 OUT5 JN12", f"""WITH r AS ({RATIOS}), q AS (SELECT type AS k, quantile_cont(return_ratio, 0.25) AS q1, quantile_cont(return_ratio, 0.75) AS q3 FROM r GROUP BY 1)
  SELECT y, type, round(invested, 2) AS invested, round(returned, 2) AS returned, round(CASE WHEN return_ratio < q1 - 1.5 * (q3 - q1) OR return_ratio > q3 + 1.5 * (q3 - q1) THEN NULL ELSE return_ratio END, 6) AS return_ratio
  FROM r JOIN q ON type = k""")
def return_ratio_by_type(t):
    def side(where):
        rows = t.lineitem.filter(where).withColumn("y", F.year("l_shipdate") * 100 + F.month("l_shipdate"))
        tall = stack_columns(rows, FUNDS, "type", "amount", ids=["y"])
        return tall.groupBy("y", "type").agg(F.sum("amount").alias("amount"))
    returned = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    out = return_ratio(side(F.col("l_returnflag") != "R"), side(returned), ["y", "type"], scale=1e3)
    clean = blank_outliers(out, "return_ratio", ["type"])
    return rounded(rounded(clean, "return_ratio"), "invested", "returned", digits=2)


@query("MET38", """SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2""")
def orders_per_month_and_status(t):
    return t.orders.groupBy(F.trunc(day("o_orderdate"), "month").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"))
