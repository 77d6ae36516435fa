"""Telecom-style billing and pay-per-use rides. Services are the three return flags of a supplier's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import day, month_start
from metricloom.functions.numbers import ratio
from metricloom.operators import billing
from metricloom.operators.aggregates import share_where
from metricloom.operators.ordering import arg_max, top_k
from metricloom.plans.registry import query
from metricloom.sources.tables import inline_rows

# The two plans with their allowances, fee and prices.
PLANS = [("smart", 50.0, 60000.0, 2.0, 550.0, 3.0, 200.0, 3.0), ("ultra", 90.0, 120000.0, 4.0, 1950.0, 1.0, 150.0, 1.0)]
PLAN_SCHEMA = ("tariff string, minutes_included double, mb_included double, messages_included double, fee double, "
               "per_minute double, per_gb double, per_message double")


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def usage(t):
    service = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag)
    return billing.monthly_usage({
        "minutes": (service("R"), "l_shipdate", F.ceil(F.sum("l_quantity"))),
        "mb": (service("A"), "l_shipdate", F.round(F.sum("l_extendedprice"), 2)),
        "messages": (service("N"), "l_shipdate", F.count("l_shipdate"))}, "l_suppkey")


USAGE = """SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS month, ceil(sum(l_quantity) FILTER (WHERE l_returnflag = 'R')) AS minutes,
  round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 2) AS mb, nullif(count(*) FILTER (WHERE l_returnflag = 'N'), 0)::DOUBLE AS messages FROM lineitem GROUP BY 1, 2"""

TARIFF = "CASE WHEN s_nationkey < 10 THEN 'smart' WHEN s_nationkey < 23 THEN 'ultra' END"
OVERS = f"""SELECT u.*, s.tariff, s.active, fee, per_minute, per_gb, per_message, CASE WHEN minutes >= minutes_included THEN minutes - minutes_included ELSE 0 END AS minutes_over,
  CASE WHEN mb >= mb_included THEN (mb - mb_included) / 1024 ELSE 0 END AS mb_over, CASE WHEN messages >= messages_included THEN messages - messages_included ELSE 0 END AS messages_over
  FROM ({USAGE}) u LEFT JOIN (SELECT s_suppkey, {TARIFF} AS tariff, s_acctbal > 0 AS active FROM supplier) s ON l_suppkey = s_suppkey
  LEFT JOIN (VALUES {", ".join(str(p) for p in PLANS)}) p(tariff, minutes_included, mb_included, messages_included, fee, per_minute, per_gb, per_message) ON s.tariff = p.tariff"""
COSTS = f"SELECT *, fee + minutes_over * per_minute + mb_over * per_gb + messages_over * per_message AS total_cost FROM ({OVERS})"


def overs(t):
    key = F.col("s_nationkey")
    clients = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.when(key < 10, "smart").when(key < 23, "ultra").alias("tariff"),
                                (F.col("s_acctbal") > 0).alias("active"))
    plans = inline_rows(t.spark, PLANS, PLAN_SCHEMA)
    rows = usage(t).join(clients, "l_suppkey", "left").join(plans, "tariff", "left")
    return billing.over_allowance(rows, {"minutes": ("minutes_included", 1), "mb": ("mb_included", 1024), "messages": ("messages_included", 1)})


def costs(t):
    return billing.monthly_cost(overs(t), "fee", {"minutes": "per_minute", "mb": "per_gb", "messages": "per_message"})


@query("MET18", "SELECT round(1 - count(nullif(o_orderstatus, 'P')) / count(*), 6) AS active_share FROM orders")
def active_client_share(t):
    gone = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t.orders.agg(F.round(1 - ratio(F.count(gone), F.count("*")), 6).alias("active_share"))


@query("MET18 PRJ9", """SELECT count(*) FILTER (WHERE nullif(trim(s), '') IS NULL) AS active, count(*) FILTER (WHERE nullif(trim(s), '') IS NOT NULL) AS gone FROM
  (SELECT CASE o_orderstatus WHEN 'P' THEN '' WHEN 'O' THEN ' ' ELSE o_orderstatus END AS s FROM orders)""")
def blank_means_active(t):
    s = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderstatus"))
    blank = billing.is_blank("s")
    return t.orders.select(s.alias("s")).agg(F.count_if(blank).alias("active"), F.count_if(~blank).alias("gone"))


@query("MET19", "SELECT round(avg((l_discount = 0)::INT), 6) AS zero_share FROM lineitem")
def zero_length_call_share(t):
    return t.lineitem.agg(F.round(share_where(F.col("l_discount") == 0), 6).alias("zero_share"))


@query("MET20 SRT3", """SELECT l_suppkey, l_shipdate::DATE AS day, sum(l_quantity) / 60 AS hours FROM lineitem GROUP BY 1, 2 ORDER BY hours DESC, l_suppkey, day LIMIT 10""")
def longest_user_days(t):
    hours = t.lineitem.groupBy("l_suppkey", day("l_shipdate").alias("day")).agg((F.sum("l_quantity") / 60).alias("hours"))
    return top_k(hours, 10, "-hours", "l_suppkey", "day")


@query("MET21 SET1", USAGE)
def monthly_usage_of_services(t):
    return usage(t)


@query("MET22 PRJ5", f"SELECT l_suppkey, month, tariff, minutes_over::DOUBLE AS minutes_over, mb_over, messages_over::DOUBLE AS messages_over FROM ({OVERS})")
def usage_over_allowance(t):
    return overs(t).select("l_suppkey", "month", "tariff", "minutes_over", "mb_over", "messages_over")


@query("MET23", f"SELECT l_suppkey, month, tariff, minutes, mb, messages, fee::DOUBLE AS fee, round(total_cost, 4) AS total_cost FROM ({COSTS})")
def monthly_cost_of_clients(t):
    return rounded(costs(t), "total_cost", digits=4).select("l_suppkey", "month", "tariff", "minutes", "mb", "messages", "fee", "total_cost")


@query("MET24", f"""SELECT tariff, count(DISTINCT l_suppkey) AS total_users, round(avg(total_cost), 4) AS avg_total_cost FROM ({COSTS}) WHERE active AND tariff IS NOT NULL GROUP BY 1""")
def mean_cost_by_plan(t):
    active = costs(t).filter(F.col("active") & F.col("tariff").isNotNull())
    return rounded(billing.cost_by_plan(active, "tariff", "l_suppkey", "fee"), "avg_total_cost", digits=4).drop("overcost")


@query("MET25", f"""SELECT tariff, count(DISTINCT l_suppkey) AS total_users, round(avg(total_cost), 4) AS avg_total_cost, round(avg(total_cost - fee), 4) AS overcost FROM ({COSTS})
  WHERE active AND total_cost > fee GROUP BY 1""")
def over_limit_clients_by_plan(t):
    active = costs(t).filter("active")
    return rounded(billing.cost_by_plan(active, "tariff", "l_suppkey", "fee", only_over=True), "avg_total_cost", "overcost", digits=4)


# ---- rides

RIDE_PRICES = [("low", 8.0, 50.0, 0.0), ("high", 6.0, 0.0, 199.0)]    # fixed: per minute, per start, fee
RIDES = """SELECT user_id, date_trunc('month', ts)::DATE AS month, c_name, plan, per_minute, per_start, fee, sum(value) AS d, sum(round_even(value / 3, 0)) AS m, count(*) AS rides FROM events JOIN customer ON user_id = c_custkey
  JOIN (VALUES ('low', 8.0::DOUBLE, 50.0::DOUBLE, 0.0::DOUBLE), ('high', 6.0, 0.0, 199.0)) p(plan, per_minute, per_start, fee) ON plan = CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END GROUP BY ALL"""
REVENUE = f"SELECT *, per_start * rides + per_minute * m + fee AS revenue FROM ({RIDES})"


def rides(t):
    plan = F.when(F.col("c_acctbal") > 5000, "high").otherwise("low")
    prices = inline_rows(t.spark, RIDE_PRICES, "plan string, per_minute double, per_start double, fee double")
    trips = (t.events.join(t.customer, F.col("user_id") == F.col("c_custkey")).withColumn("plan", plan).join(prices, "plan")
             .withColumn("month", month_start("ts")).withColumn("minutes", F.bround(F.col("value") / 3, 0)))
    return billing.trip_revenue(trips, ["user_id", "c_name", "plan", "month"], "minutes", "value", "per_start", "per_minute", "fee")


@query("MET32 AGG13 NUM2", f"SELECT user_id, c_name, plan, month, round(d, 2) AS total_distance, m AS total_minutes, rides, round(revenue, 2) AS revenue FROM ({REVENUE})")
def ride_revenue_per_user_month(t):
    return rounded(rides(t), "total_distance", "revenue", digits=2).select("user_id", "c_name", "plan", "month", "total_distance", "total_minutes", "rides", "revenue")


@query("MET33 AGG19", f"""WITH r AS ({REVENUE}) SELECT user_id, c_name, month, rides, revenue FROM r WHERE user_id = (SELECT user_id FROM r GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 1)""")
def months_of_top_user(t):
    r = rides(t)
    best = arg_max(r.groupBy("user_id").agg(F.sum("revenue").alias("total")), "user_id", "total")
    return r.join(best, "user_id", "left_semi").select("user_id", "c_name", "month", "rides", "revenue")


@query("MET34 NUM4", """SELECT trunc(100.0 * avg((p_size < 18)::INT))::BIGINT AS young_percent FROM part""")
def share_under_eighteen(t):
    return t.part.agg((share_where(F.col("p_size") < 18) * 100).cast("bigint").alias("young_percent"))


@query("MET34", f"""SELECT plan, round(sum(m) / sum(rides), 6) AS mean_minutes FROM ({RIDES}) GROUP BY 1""")
def mean_duration_by_plan(t):
    out = rides(t).groupBy("plan").agg(ratio(F.sum("total_minutes"), F.sum("rides")).alias("mean_minutes"))
    return rounded(out, "mean_minutes")


CURRENCY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'KZT' WHEN '2-HIGH' THEN 'usd' ELSE 'rub' END"


@query("MET44 JN6", f"""SELECT o_orderkey, CASE lower({CURRENCY}) WHEN 'rub' THEN o_totalprice WHEN 'kzt' THEN o_totalprice * rate / 100 END AS total_rub FROM orders
  LEFT JOIN (SELECT l_shipdate::DATE AS d, round(avg(l_tax) * 500, 4) AS rate FROM lineitem GROUP BY 1) ON d = o_orderdate::DATE""")
def revenue_in_one_currency(t):
    rates = t.lineitem.groupBy(day("l_shipdate").alias("d")).agg(F.round(F.avg("l_tax") * 500, 4).alias("rate"))
    code = F.when(F.col("o_orderpriority") == "1-URGENT", "KZT").when(F.col("o_orderpriority") == "2-HIGH", "usd").otherwise("rub")
    o = t.orders.withColumn("currency", code).withColumn("nominal", F.lit(100))
    joined = o.join(rates, day("o_orderdate") == F.col("d"), "left")
    total = billing.convert_currency("o_totalprice", "currency", "rate", "nominal", "rub", "kzt")
    return joined.select("o_orderkey", total.alias("total_rub"))
