"""Activity, conversion, value and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import day, in_days, is_weekend, month_start, weekday_label
from metricloom.functions.numbers import ratio
from metricloom.operators import product
from metricloom.operators.aggregates import distinct_counts, distinct_of, share_where, summarise
from metricloom.operators.attach import with_scalars, with_share
from metricloom.operators.ordering import arg_max, order_by, top_k
from metricloom.operators.quantiles import quantiles
from metricloom.plans.bindings import SALES, VISITS, money, sales, visits
from metricloom.plans.registry import query


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


JANUARY = "log_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-24'"
JAN = ("2024-01-01", "2024-01-24")


@query("MET1 FLT4", f"""SELECT log_date, count(DISTINCT user_id) AS dau FROM ({VISITS}) WHERE {JANUARY} AND r_name = 'EUROPE' AND event_type = 'purchase' GROUP BY 1""")
def daily_active_buyers(t):
    v = visits(t).filter(in_days("ts", *JAN) & (F.col("r_name") == "EUROPE") & (F.col("event_type") == "purchase"))
    return order_by(product.daily_active(v, "log_date", "user_id"), "log_date")


@query("MET2 AGG5", f"""SELECT log_date, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS converted,
  round(count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') / count(DISTINCT user_id), 6) AS conversion FROM ({VISITS}) WHERE {JANUARY} GROUP BY 1""")
def daily_conversion(t):
    v = visits(t).filter(in_days("ts", *JAN))
    return rounded(product.conversion(v, ["log_date"], "user_id", F.col("event_type") == "purchase"), "conversion")


@query("MET3", """SELECT date_trunc('month', o_orderdate)::DATE AS month, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * l_discount), 4) AS commission,
  round(sum(l_extendedprice * l_discount), 4) / count(DISTINCT o_orderkey) AS average_check FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def average_check_per_month(t):
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("fee"))
    joined = per_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = product.average_check(joined, "o_orderdate", "o_orderkey", F.col("fee"))
    return out.withColumn("commission", F.round("commission", 4)).withColumn("average_check", ratio("commission", "orders"))


@query("MET4 JN5", """SELECT l_suppkey, s_name, n_name, round(sum(l_extendedprice * l_discount), 2) AS ltv FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3 ORDER BY ltv DESC, l_suppkey LIMIT 3""")
def top_suppliers_by_value(t):
    # summed per supplier before the dimensions are joined
    ltv = product.lifetime_value(t.lineitem, ["l_suppkey"], F.col("l_extendedprice") * F.col("l_discount"))
    top = top_k(ltv.withColumn("ltv", F.round("ltv", 2)), 3, "-ltv", "l_suppkey")
    return (top.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("l_suppkey", "s_name", "n_name", "ltv"))


@query("MET5", """WITH o AS (SELECT l_suppkey, l_partkey, l_extendedprice * l_discount AS a FROM lineitem), top AS (SELECT l_suppkey FROM o GROUP BY 1 ORDER BY sum(a) DESC, l_suppkey LIMIT 2)
  SELECT s_name, p_partkey, p_name, p_brand, p_type, round(sum(a), 2) AS ltv FROM o JOIN top USING (l_suppkey) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3, 4, 5 ORDER BY ltv DESC, p_partkey LIMIT 5""")
def top_items_by_value(t):
    items = product.item_value_in_top(t.lineitem, "l_suppkey", "l_partkey", F.col("l_extendedprice") * F.col("l_discount"), 2)
    top = top_k(items.withColumn("ltv", F.round("ltv", 2)), 5, "-ltv", "l_partkey")
    return (top.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .select("s_name", "p_partkey", "p_name", "p_brand", "p_type", "ltv"))


FIRST = "SELECT user_id, min(ts)::DATE AS first_date FROM events GROUP BY 1"
LIVES = f"""SELECT DISTINCT f.user_id, first_date, (ts::DATE - first_date)::INT AS day_since_install FROM ({FIRST}) f JOIN events e ON f.user_id = e.user_id AND ts::DATE >= first_date"""


@query("MET6 JN7", f"""SELECT day_since_install, retained_users, round(retained_users / max(retained_users) OVER (ORDER BY day_since_install), 6) AS retention_rate
  FROM (SELECT day_since_install, count(DISTINCT user_id) AS retained_users FROM ({LIVES}) WHERE day_since_install < 8 GROUP BY 1)""")
def retention_of_new_users(t):
    e = t.events.withColumn("log_date", day("ts"))
    cohort = e.groupBy("user_id").agg(F.min("log_date").alias("first_date"))
    return rounded(product.retention(cohort, e, "user_id", "first_date", "log_date"), "retention_rate")


BUYERS = "SELECT o_custkey, min(o_orderdate)::DATE AS first_date FROM orders GROUP BY 1"


@query("MET7 WIN5", f"""SELECT month, day_since_install, retained_users, round(retained_users / max(retained_users) OVER (PARTITION BY month ORDER BY day_since_install), 6) AS retention_rate
  FROM (SELECT date_trunc('month', first_date)::DATE AS month, (o_orderdate::DATE - first_date)::INT AS day_since_install, count(DISTINCT f.o_custkey) AS retained_users
  FROM ({BUYERS}) f JOIN orders o ON f.o_custkey = o.o_custkey WHERE o_orderdate::DATE - first_date BETWEEN 0 AND 60 GROUP BY 1, 2)""")
def retention_by_cohort_month(t):
    o = t.orders.withColumn("log_date", day("o_orderdate"))
    cohort = o.groupBy("o_custkey").agg(F.min("log_date").alias("first_date")).withColumn("month", month_start("first_date"))
    return rounded(product.retention(cohort, o, "o_custkey", "first_date", "log_date", last_day=60, by="month"), "retention_rate")


@query("MET8 JN8 WIN6", """WITH c AS (SELECT DISTINCT user_id FROM events WHERE ts::DATE = DATE '2024-01-02')
  SELECT (ts::DATE - DATE '2024-01-02')::INT AS day_since_install, count(DISTINCT e.user_id) AS retained_users, round(count(DISTINCT e.user_id) / (SELECT count(*) FROM c), 6) AS retention_rate
  FROM events e JOIN c ON e.user_id = c.user_id WHERE ts::DATE >= DATE '2024-01-02' GROUP BY 1""")
def retention_of_one_day_cohort(t):
    e = t.events.withColumn("log_date", day("ts"))
    cohort = product.active_cohort(e.filter(in_days("ts", "2024-01-02", "2024-01-02")), "user_id", "log_date", "2024-01-02")
    later = e.filter(F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz"))
    out = product.retention(cohort, later, "user_id", "start_day", "log_date", last_day=None, denominator="cohort")
    return rounded(out, "retention_rate")


NOVEMBER = "o_orderdate >= TIMESTAMP '1997-11-01' AND o_orderdate < TIMESTAMP '1997-12-01'"


def november(t):
    d = F.col("o_orderdate")
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    return (t.orders.filter((d >= ts("1997-11-01")) & (d < ts("1997-12-01")))
            .join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")))


@query("MET9", f"""SELECT p_brand, count(DISTINCT o_custkey) AS mau FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE {NOVEMBER}
  GROUP BY 1 ORDER BY mau DESC, p_brand LIMIT 3""")
def top_brands_by_audience(t):
    return top_k(product.monthly_audience(november(t), ["p_brand"], "o_custkey"), 3, "-mau", "p_brand")


@query("MET9", f"""SELECT p_partkey, p_name, p_brand, count(DISTINCT o_custkey) AS mau FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE {NOVEMBER}
  GROUP BY 1, 2, 3 ORDER BY mau DESC, p_partkey LIMIT 3""")
def top_works_by_audience(t):
    return top_k(product.monthly_audience(november(t), ["p_partkey", "p_name", "p_brand"], "o_custkey"), 3, "-mau", "p_partkey")


@query("MET10", """SELECT n_name, count(DISTINCT o_custkey) AS total_users, count(*) AS paid_months, round(count(*) * 399.0 / count(DISTINCT o_custkey), 6) AS ltv FROM
  (SELECT DISTINCT n_name, o_custkey, date_trunc('month', o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def subscription_value_by_city(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(product.subscription_value(joined, "n_name", "o_custkey", "o_orderdate", 399.0), "ltv")


@query("MET11", """SELECT date_trunc('month', o_orderdate)::DATE AS month, count(DISTINCT o_custkey) AS mau, round(sum(coalesce(nullif(l_quantity, 50), 0)), 2) AS hours,
  round(count(DISTINCT o_custkey) * 399.0 / nullif(sum(coalesce(nullif(l_quantity, 50), 0)), 0), 6) AS income_per_hour FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def income_per_hour_by_month(t):
    used = t.lineitem.select("l_orderkey", F.nullif(F.col("l_quantity"), F.lit(50.0)).alias("hours"))
    joined = t.orders.join(used, F.col("o_orderkey") == F.col("l_orderkey"))
    out = product.income_per_hour(joined, "o_custkey", "o_orderdate", "hours", 399.0)
    return rounded(rounded(out, "hours", digits=2), "income_per_hour")


@query("MET12", """SELECT n_name, o_custkey, round(sum(coalesce(nullif(l_quantity, 50), 0)), 2) AS hours FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2') GROUP BY 1, 2""")
def hours_of_users_by_city(t):
    cities = t.nation.filter(F.col("n_name").isin("NATION_1", "NATION_2"))
    people = t.customer.join(cities, F.col("c_nationkey") == F.col("n_nationkey"))
    used = t.lineitem.select("l_orderkey", F.nullif(F.col("l_quantity"), F.lit(50.0)).alias("used"))
    joined = (t.orders.join(people, F.col("o_custkey") == F.col("c_custkey")).join(used, F.col("o_orderkey") == F.col("l_orderkey")))
    return rounded(product.hours_by_user(joined, "n_name", "o_custkey", "used"), "hours", digits=2)


def payers(t):
    return t.customer.withColumn("payer", (F.col("c_acctbal") > 5000).cast("int"))


PAYERS = "SELECT *, (c_acctbal > 5000)::INT AS payer FROM customer"


@query("MET13", f"SELECT count(*) AS users, sum(payer)::BIGINT AS payers, round(avg(payer), 6) AS paying_share FROM ({PAYERS})")
def paying_share_overall(t):
    return rounded(product.paying_share(payers(t), "payer"), "paying_share")


@query("MET13", f"""SELECT users, sum(payer)::BIGINT AS payers, round(any_value(r), 6) AS paying_share FROM (SELECT count(*) OVER () AS users, avg(payer) OVER () AS r, payer FROM ({PAYERS})) WHERE payer = 1 GROUP BY users""")
def paying_share_total_first(t):
    total = payers(t).agg(F.count("*").alias("users"), F.avg("payer").alias("paying_share"))
    return rounded(with_scalars(payers(t).filter("payer = 1").agg(F.sum("payer").alias("payers")), total), "paying_share")


@query("MET13", f"SELECT c_mktsegment, count(*) AS users, sum(payer)::BIGINT AS payers, round(sum(payer) / count(*), 6) AS paying_share FROM ({PAYERS}) GROUP BY 1")
def paying_share_by_segment(t):
    return rounded(product.paying_share(payers(t), "payer", ["c_mktsegment"]), "paying_share")


@query("MET14", """SELECT count(l_discount) AS n, round(sum(l_discount), 2) AS total, min(l_discount) AS low, min(nullif(l_discount, 0)) AS low_not_zero, max(l_discount) AS high,
  round(avg(l_discount), 6) AS mean, quantile_disc(l_discount, 0.5) AS median, round(stddev_samp(l_discount), 6) AS std FROM lineitem""")
def purchase_statistics(t):
    d = "l_discount"
    stats = t.lineitem.agg(F.count(d).alias("n"), F.round(F.sum(d), 2).alias("total"), F.min(d).alias("low"), F.min(F.when(F.col(d) != 0, F.col(d))).alias("low_not_zero"),
                           F.max(d).alias("high"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("std"))
    return with_scalars(stats, quantiles(t.lineitem, d, {"median": 0.5}, kind="discrete", method="counts"))


@query("MET15", "SELECT count(l_discount) AS purchases, count(*) FILTER (WHERE l_discount = 0) AS zero_purchases, round(avg((l_discount = 0)::INT), 6) AS zero_share FROM lineitem")
def zero_purchase_share(t):
    return rounded(product.zero_share(t.lineitem, "l_discount"), "zero_share")


@query("MET16", """SELECT l_partkey, p_name, sales, buyers, round(sales / sum(sales) OVER (), 8) AS sales_share, round(buyers / (SELECT count(DISTINCT o_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount <> 0), 8) AS buyer_share
  FROM (SELECT l_partkey, p_name, count(*) AS sales, count(DISTINCT o_custkey) AS buyers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_discount <> 0 GROUP BY 1, 2)""")
def item_popularity(t):
    paid = t.lineitem.filter(F.col("l_discount") != 0).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = product.item_popularity(paid, "l_partkey", "o_custkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(out, "sales_share", "buyer_share", digits=8).select("l_partkey", "p_name", "sales", "buyers", "sales_share", "buyer_share")


@query("MET17 FLT7", f"""WITH s AS (SELECT user_id, count(*) AS k, sum(value) AS s FROM events WHERE event_type = 'purchase' AND value <> 0 GROUP BY 1)
  SELECT c_mktsegment, count(*) AS members, count(k) AS buyers, round(count(k) / count(*), 6) AS buyer_share, round(count(*) FILTER (WHERE k IS NOT NULL AND payer = 1) / nullif(count(k), 0), 6) AS payer_share,
  round(avg(k), 6) AS purchases_per_buyer, round(avg(s), 4) AS spend_per_buyer, round(avg(s) / avg(k), 6) AS average_price FROM ({PAYERS}) LEFT JOIN s ON c_custkey = user_id GROUP BY 1""")
def activity_by_segment(t):
    users = payers(t).withColumnRenamed("c_custkey", "user_id")
    bought = t.events.filter(F.col("event_type") == "purchase")
    out = product.group_activity(users, bought, "user_id", "c_mktsegment", "payer", "value")
    return rounded(rounded(out, "buyer_share", "payer_share", "purchases_per_buyer", "average_price"), "spend_per_buyer", digits=4)


@query("MET35", """SELECT ts::DATE AS day, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'signup') AS registrations,
  round(count(*) FILTER (WHERE event_type = 'signup') / count(DISTINCT user_id), 6) AS registration_ratio FROM events GROUP BY 1""")
def registrations_per_day(t):
    per_user = t.events.groupBy(day("ts").alias("day"), "user_id").agg(F.count_if(F.col("event_type") == "signup").alias("r"))
    out = per_user.groupBy("day").agg(F.count("user_id").alias("users"), F.sum("r").alias("registrations"))
    return rounded(out.withColumn("registration_ratio", ratio("registrations", "users")), "registration_ratio")


@query("MET36", "SELECT floor(value / 10)::BIGINT AS pages, count(*) AS sessions FROM events GROUP BY 1")
def session_depth(t):
    return t.events.groupBy(F.floor(F.col("value") / 10).alias("pages")).agg(F.count("*").alias("sessions"))


@query("MET36 AGG19", """SELECT event_id, ts, user_id FROM events WHERE user_id = (SELECT user_id FROM events GROUP BY 1 ORDER BY count(DISTINCT event_id) DESC, 1 LIMIT 1)""")
def sessions_of_busiest_user(t):
    per_user = distinct_of(t.events, ["user_id"], "event_id")
    best = arg_max(per_user, "user_id", "entities")
    return t.events.join(best, "user_id", "left_semi").select("event_id", "ts", "user_id")


@query("MET37", "SELECT ts::DATE AS day, round(avg((floor(value / 10) >= 4)::INT), 6) AS success_rate FROM events GROUP BY 1")
def good_sessions_per_day(t):
    return t.events.groupBy(day("ts").alias("day")).agg(F.round(share_where(F.floor(F.col("value") / 10) >= 4), 6).alias("success_rate"))


DAILY = """SELECT o_orderdate::DATE AS day, count(*) AS orders, count(DISTINCT o_custkey) AS users, sum(round(o_totalprice * 100)::BIGINT) / count(*) AS average_price, round(count(*) / count(DISTINCT o_custkey), 6) AS orders_per_user FROM orders GROUP BY 1"""


def daily(t):
    # prices in whole cents, so that sums do not depend on their order
    o = t.orders.withColumn("day", day("o_orderdate")).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return rounded(product.daily_profile(o, "day", "o_orderkey", "o_custkey", "cents"), "orders_per_user")


@query("MET41", DAILY)
def daily_orders_and_users(t):
    return daily(t)


PROFILE = """SELECT {k}, sum(orders)::BIGINT AS total_orders, sum(users)::BIGINT AS total_users, round(avg(orders), 6) AS orders_per_day, round(avg(users), 6) AS users_per_day,
  round(avg(average_price), 3) AS average_price, round(sum(orders) / sum(users), 6) AS orders_per_user FROM ({s}) GROUP BY 1"""


def profile_by(df, key):
    out = df.groupBy(key).agg(F.sum("orders").alias("total_orders"), F.sum("users").alias("total_users"), F.avg("orders").alias("orders_per_day"),
                              F.avg("users").alias("users_per_day"), F.round(F.avg("average_price"), 3).alias("average_price"))
    return rounded(out.withColumn("orders_per_user", ratio("total_orders", "total_users")), "orders_per_day", "users_per_day", "orders_per_user")


@query("MET42 AGG20", PROFILE.format(k="dayname(day) AS weekday", s=DAILY))
def weekday_profile(t):
    return profile_by(daily(t).withColumn("weekday", weekday_label("day")), "weekday")


@query("MET42 STR7", PROFILE.format(k="CASE WHEN isodow(day) > 5 THEN 'weekend' ELSE 'workday' END AS period_type", s=DAILY))
def weekend_profile(t):
    return profile_by(daily(t).withColumn("period_type", F.when(is_weekend("day"), "weekend").otherwise("workday")), "period_type")


@query("MET51", """SELECT o_orderpriority, round(mean, 4) AS mean, n, CASE WHEN mean > (SELECT avg(o_totalprice) FROM orders) THEN 'above' WHEN mean < (SELECT avg(o_totalprice) FROM orders) THEN 'below' ELSE 'equal' END AS verdict
  FROM (SELECT o_orderpriority, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1)""")
def mean_order_value_by_device(t):
    per = summarise(t.orders, ["o_orderpriority"], mean=F.avg("o_totalprice"), n=F.count("*"))
    out = with_scalars(per, t.orders.agg(F.avg("o_totalprice").alias("overall")))
    verdict = F.when(F.col("mean") > F.col("overall"), "above").when(F.col("mean") < F.col("overall"), "below").otherwise("equal")
    return out.withColumn("verdict", verdict).withColumn("mean", F.round("mean", 4)).drop("overall")


CITY = """SELECT n_name, count(DISTINCT c_custkey) AS users, count(DISTINCT o_custkey) AS converted, round(count(DISTINCT o_custkey) / count(DISTINCT c_custkey), 6) AS conversion
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey GROUP BY 1"""


def city_conversion(t):
    buyers = t.orders.filter(F.col("o_totalprice") > 450000).select("o_custkey").distinct()
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rounded(product.conversion(people, ["n_name"], "c_custkey", F.col("o_custkey").isNotNull()), "conversion")


@query("MET52", CITY)
def conversion_by_city(t):
    return city_conversion(t)


@query("MET1 MET2", """SELECT ts::DATE AS log_date, count(DISTINCT u) AS users, count(DISTINCT u) FILTER (WHERE event_type = 'purchase') AS converted
  FROM (SELECT *, CASE WHEN day(ts) % 2 = 0 THEN user_id END AS u FROM events) GROUP BY 1""")
def daily_conversion_with_unknown_users(t):
    e = t.events.withColumn("u", F.when(F.dayofmonth("ts") % 2 == 0, F.col("user_id")))
    return product.conversion(e.withColumn("log_date", day("ts")), ["log_date"], "u", F.col("event_type") == "purchase").select("log_date", "users", "converted")


@query("MET52 AGG19", f"SELECT n_name, conversion FROM ({CITY}) ORDER BY conversion DESC, n_name LIMIT 1")
def city_with_best_conversion(t):
    return arg_max(city_conversion(t), "n_name", "conversion")


@query("MET39", """SELECT season, o_orderpriority, count(*) AS total, round(count(*) / sum(count(*)) OVER (PARTITION BY season), 6) AS share FROM
  (SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'зима' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'весна' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'лето' ELSE 'осень' END AS season, * FROM orders) GROUP BY 1, 2""")
def category_share_inside_season(t):
    from metricloom.functions.dates import season
    return rounded(product.category_share_inside(t.orders.withColumn("season", season("o_orderdate")), "season", "o_orderpriority"), "share")


@query("MET50", f"""SELECT count(DISTINCT n_name) AS events, count(DISTINCT o_orderkey) AS talks, count(DISTINCT o_custkey) AS speakers, count(DISTINCT o_orderpriority) AS tags FROM ({SALES})""")
def conference_totals(t):
    s = sales(t)
    # one narrow pass for each entity over the combinations, which are found once: no row is copied
    names = {"n_name": "events", "o_orderkey": "talks", "o_custkey": "speakers", "o_orderpriority": "tags"}
    return distinct_counts(s.select(*names).distinct(), [], names).withColumnsRenamed({f"n_{c}": n for c, n in names.items()})


@query("MET50", f"""SELECT n_name, round(avg(l_quantity), 6) AS mean_duration, max(l_extendedprice) AS most_views, round(sum(l_quantity), 2) AS applause, count(DISTINCT o_custkey) AS speakers FROM ({SALES}) GROUP BY 1""")
def conference_per_event(t):
    return sales(t).groupBy("n_name").agg(F.round(F.avg("l_quantity"), 6).alias("mean_duration"), F.max("l_extendedprice").alias("most_views"),
                                          F.round(F.sum("l_quantity"), 2).alias("applause"), F.count_distinct("o_custkey").alias("speakers"))


@query("MET50 SRT3", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10")
def conference_top_talks(t):
    return top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), 10, "-l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")


@query("MET50 SRT3", "SELECT p_name, count(*) AS talks FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY talks DESC, p_name LIMIT 20")
def conference_top_tags(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return top_k(joined.groupBy("p_name").agg(F.count("*").alias("talks")), 20, "-talks", "p_name")


@query("MET50", f"SELECT c_mktsegment, round(sum(l_quantity), 2) AS applause FROM ({SALES}) GROUP BY 1")
def conference_applause_by_occupation(t):
    return order_by(sales(t).groupBy("c_mktsegment").agg(F.round(F.sum("l_quantity"), 2).alias("applause")), "-applause")


@query("MET50 AGG24", f"""SELECT r_name, n_name, count(*) AS talks, round(sum(l_quantity), 2) AS applause FROM ({SALES}) WHERE o_orderpriority = '1-URGENT' AND
  o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY ROLLUP (r_name, n_name)""")
def conference_filtered_drill_down(t):
    s = sales(t).filter((F.col("o_orderpriority") == "1-URGENT") & in_days("o_orderdate", "1996-01-01", "1999-12-31"))
    finest = s.groupBy("r_name", "n_name").agg(F.count("*").alias("k"), F.sum("l_quantity").alias("q"))
    return finest.rollup("r_name", "n_name").agg(F.sum("k").alias("talks"), F.round(F.sum("q"), 2).alias("applause"))


@query("MET16 WIN3", """SELECT p_type, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount)) / sum(sum(l_extendedprice * (1 - l_discount))) OVER (), 6) AS share
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def revenue_share_by_kind(t):
    joined = t.lineitem.withColumn("r", money()).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    out = with_share(joined.groupBy("p_type").agg(F.sum("r").alias("revenue")), "revenue", "share", small=True)
    return rounded(rounded(out, "share"), "revenue", digits=2)
