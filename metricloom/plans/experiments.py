"""Checks and readouts of a split test. Test group: parity of the user id; test name: continent of the user."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import days_between
from metricloom.operators import experiments
from metricloom.operators.cleaning import keep_one
from metricloom.operators.ordering import with_previous
from metricloom.plans.bindings import SPLIT, VISITS, split, visits
from metricloom.plans.registry import query


@query("EXP1", f"""SELECT users_1, users_2, round(100.0 * abs(users_1 - users_2) / users_1, 6) AS difference_percent FROM
  (SELECT count(DISTINCT user_id) FILTER (WHERE grp = 'A') AS users_1, count(DISTINCT user_id) FILTER (WHERE grp = 'B') AS users_2 FROM ({SPLIT}))""")
def test_group_sizes(t):
    return experiments.group_sizes(split(t), "user_id", "grp", "A", "B").withColumn("difference_percent", F.round("difference_percent", 6))


BALANCE = """SELECT grp, {a}, users, round(users / sum(users) OVER (PARTITION BY grp), 6) AS share FROM (SELECT grp, {a}, count(DISTINCT user_id) AS users FROM ({s}) GROUP BY 1, 2)"""


@query("EXP3", BALANCE.format(a="event_type", s=SPLIT))
def balance_by_device(t):
    return experiments.group_balance(split(t), "user_id", "grp", "event_type").withColumn("share", F.round("share", 6))


@query("EXP3", BALANCE.format(a="r_name", s=f"SELECT *, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS grp FROM ({VISITS})"))
def balance_by_region(t):
    v = visits(t).withColumn("grp", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"))
    return experiments.group_balance(v, "user_id", "grp", "r_name").withColumn("share", F.round("share", 6))


@query("EXP4", """SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 AND event_type = 'click'""")
def roster_of_one_test(t):
    entries = t.events.select("user_id", "ts", "event_id", "event_type")
    return experiments.roster(entries, "user_id", ["ts", "event_id"], "event_type", "click").select("user_id", "event_type")


LIFETIME = f"SELECT *, floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 86400e6)::BIGINT AS lifetime FROM ({SPLIT})"


@query("EXP5", f"SELECT event_id, lifetime FROM ({LIFETIME}) WHERE lifetime < 7")
def events_of_first_week(t):
    return experiments.within_lifetime(split(t), "user_id", "ts", 7).select("event_id", "lifetime")


READOUT = """SELECT n_a, hits_a, n_b, hits_b, round(hits_a / n_a, 6) AS p_a, round(hits_b / n_b, 6) AS p_b, round((hits_b / n_b - hits_a / n_a) * 100, 6) AS uplift_points,
  round((hits_b / n_b - hits_a / n_a) / nullif(hits_b / n_b, 0) * 100, 6) AS uplift_percent FROM (SELECT count(DISTINCT user_id) FILTER (WHERE grp = 'A') AS n_a, count(DISTINCT user_id) FILTER (WHERE grp = 'A' AND {h}) AS hits_a,
  count(DISTINCT user_id) FILTER (WHERE grp = 'B') AS n_b, count(DISTINCT user_id) FILTER (WHERE grp = 'B' AND {h}) AS hits_b FROM ({s}))"""


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("p_a", "p_b", "uplift_points", "uplift_percent")})


@query("EXP6", READOUT.format(h="event_type = 'purchase' AND value > 90", s=f"SELECT * FROM ({LIFETIME}) WHERE lifetime < 7"))
def conversion_readout(t):
    week = experiments.within_lifetime(split(t), "user_id", "ts", 7)
    bought = (F.col("event_type") == "purchase") & (F.col("value") > 90)
    return rounded(experiments.readout(week, "user_id", "grp", bought, "A", "B"))


FIRST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_number FROM ({SPLIT})) WHERE session_number = 1"


@query("EXP7 EXP6", READOUT.format(h="floor(value / 10) >= 4", s=FIRST))
def first_session_readout(t):
    first = keep_one(split(t), ["user_id"], ["ts", "event_id"])
    return rounded(experiments.readout(first, "user_id", "grp", F.floor(F.col("value") / 10) >= 4, "A", "B"))


@query("EXP8 FLT11", """SELECT o_orderpriority, count(DISTINCT o_custkey) AS users FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey NOT IN
  (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1) GROUP BY 1""")
def users_of_a_single_device(t):
    two = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    alone = experiments.without_users(two, experiments.users_in_several(two, "o_custkey", "o_orderpriority"), "o_custkey")
    return alone.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("users"))


@query("EXP9 WIN12", """SELECT o_custkey, o_orderstatus, round(avg(gap), 6) AS metric FROM (SELECT o_custkey, o_orderstatus, o_orderdate::DATE - lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS gap FROM orders)
  WHERE gap IS NOT NULL GROUP BY 1, 2""")
def mean_days_between_orders(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    gaps = with_previous(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", "prev")
    known = gaps.withColumn("gap", days_between("o_orderdate", "prev")).dropna(subset=["gap"])
    return experiments.per_user_metric(known, "o_custkey", "o_orderstatus", F.round(F.avg("gap"), 6))
