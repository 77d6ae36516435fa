"""Selecting, computing and renaming columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import day, month_start
from metricloom.functions.numbers import overage, ratio
from metricloom.operators.cleaning import normalise_headers
from metricloom.operators.segments import up_to
from metricloom.plans.bindings import money
from metricloom.plans.registry import query


@query("PRJ1", "SELECT p_brand AS brand, p_name AS name, p_type AS kind FROM part")
def columns_in_order(t):
    return t.part.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))


@query("PRJ2", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue,
  round(l_extendedprice / l_quantity, 8) AS unit_price, l_quantity / 60 AS hours FROM lineitem""")
def arithmetic_columns(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(money(), 4).alias("revenue"),
                             F.round(ratio("l_extendedprice", "l_quantity"), 8).alias("unit_price"),
                             (F.col("l_quantity") / 60).alias("hours"))


@query("PRJ3 SRC8", """SELECT event_id, value::BIGINT::VARCHAR AS value_text, ts::DATE AS day, user_id::DOUBLE AS user_number
  FROM (SELECT event_id, floor(value) AS value, ts, user_id FROM events)""")
def casts(t):
    return t.events.select("event_id", F.floor("value").cast("bigint").cast("string").alias("value_text"),
                           day("ts").alias("day"), F.col("user_id").cast("double").alias("user_number"))


@query("PRJ4 SEG5", """SELECT band, count(*) AS n_parts FROM (SELECT CASE WHEN d <= 30 THEN 'about a month' WHEN d <= 90 THEN 'up to 3 months'
  WHEN d <= 180 THEN 'up to half a year' WHEN d > 180 THEN 'over half a year' ELSE 'no category' END AS band
  FROM (SELECT nullif(p_size, 7) * 5 AS d FROM part)) GROUP BY 1""")
def first_match_bands(t):
    d = F.nullif(F.col("p_size"), F.lit(7)) * 5
    band = up_to(d, {"about a month": 30, "up to 3 months": 90, "up to half a year": 180}, "over half a year", "no category")
    return t.part.groupBy(band.alias("band")).agg(F.count("*").alias("n_parts"))


@query("PRJ5", """SELECT l_orderkey, l_linenumber, CASE WHEN q >= 30 THEN q - 30 ELSE 0 END AS over
  FROM (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 50) AS q FROM lineitem)""")
def clamp_above_limit(t):
    used = F.nullif(F.col("l_quantity"), F.lit(50.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", overage(used, F.lit(30.0)).alias("over"))


@query("PRJ6", "SELECT s_suppkey AS supplier_key, s_name AS supplier_name, s_acctbal AS balance_usd FROM supplier")
def tidy_headers(t):
    raw = t.supplier.select(F.col("s_suppkey").alias(" Supplier Key"), F.col("s_name").alias("Supplier NAME "),
                            F.col("s_acctbal").alias("Balance USD"))
    return normalise_headers(raw)


@query("PRJ7", "SELECT c_custkey AS customer_id, c_name, c_mktsegment AS segment FROM customer")
def renamed_and_dropped(t):
    return (t.customer.drop("c_nationkey", "c_acctbal")
            .withColumnsRenamed({"c_custkey": "customer_id", "c_mktsegment": "segment"}))


@query("PRJ8 DAT1", """SELECT date_trunc('month', o_orderdate)::DATE AS "Месяц", count(*) AS "Количество заказов",
  round(sum(o_totalprice), 2) AS "Сумма" FROM orders GROUP BY 1 ORDER BY 1""")
def cyrillic_headers(t):
    return (t.orders.groupBy(month_start("o_orderdate").alias("Месяц"))
            .agg(F.count("*").alias("Количество заказов"), F.round(F.sum("o_totalprice"), 2).alias("Сумма")).orderBy("`Месяц`"))


@query("PRJ9", """SELECT l_returnflag, round(coalesce(sum(nullif(l_discount, 0)), 0), 4) AS discounts,
  round(sum(l_tax) / nullif(count(nullif(l_linestatus, 'O')), 0), 6) AS tax_per_closed FROM lineitem GROUP BY 1""")
def defaults_and_zero_guards(t):
    closed = F.count(F.nullif(F.col("l_linestatus"), F.lit("O")))
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.coalesce(F.sum(F.nullif(F.col("l_discount"), F.lit(0.0))), F.lit(0.0)), 4).alias("discounts"),
        F.round(F.sum("l_tax") / F.nullif(closed, F.lit(0)), 6).alias("tax_per_closed"))
