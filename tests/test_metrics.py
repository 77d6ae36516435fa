import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricloom.operators import billing, product, revenue

D = dt.date


@pytest.fixture
def food(spark):
    """Activity log: one user active before the start date, one without id, more users on day 2 than on day 0."""
    return spark.createDataFrame([
        ("u1", D(2021, 5, 1), D(2021, 5, 1), "order", "o1", 100.0), ("u1", D(2021, 5, 3), D(2021, 5, 1), "view", None, None),
        ("u2", D(2021, 4, 30), D(2021, 5, 1), "view", None, None), ("u2", D(2021, 5, 3), D(2021, 5, 1), "order", "o2", 50.0),
        ("u3", D(2021, 5, 3), D(2021, 5, 1), "view", None, None), (None, D(2021, 5, 1), D(2021, 5, 1), "order", "o3", 10.0),
        ("u1", D(2021, 5, 3), D(2021, 5, 1), "order", "o2", 30.0), ("u4", D(2021, 6, 2), D(2021, 6, 1), "view", None, None),
    ], "user string, day date, first date, event string, order string, amount double")


def test_daily_active_and_conversion(food, rows):
    orders = food.filter("event = 'order'")
    assert rows(product.daily_active(orders, "day", "user")) == [(D(2021, 5, 1), 1), (D(2021, 5, 3), 2)]
    got = {r.day: (r.users, r.converted, r.conversion) for r in product.conversion(food, ["day"], "user", F.col("event") == "order").collect()}
    assert got[D(2021, 4, 30)] == (1, 0, 0.0) and got[D(2021, 5, 3)] == (3, 2, 2 / 3)


def test_average_check_counts_orders_once(food, rows):
    paid = food.filter("amount is not null")
    assert rows(product.average_check(paid, "day", "order", F.col("amount") * 0.1)) == [(D(2021, 5, 1), 3, pytest.approx(19.0), pytest.approx(19 / 3))]


def test_retention_running_denominator(food):
    cohort = food.select("user", "first")
    got = [(r.day_since_install, r.retained_users, r.retention_rate)
           for r in product.retention(cohort, food, "user", "first", "day").orderBy("day_since_install").collect()]
    # day 2 is larger than day 0, so the running maximum grows; activity before the start is ignored
    assert got == [(0, 1, 1.0), (1, 1, 1.0), (2, 3, 1.0)]


def test_retention_cohort_denominator_skips_missing_user(food):
    cohort = food.select("user", F.col("first").alias("start"))
    got = {r.day_since_install: r.retention_rate for r in
           product.retention(cohort, food, "user", "start", "day", denominator="cohort").collect()}
    assert got == {0: 0.25, 1: 0.25, 2: 0.75}


def test_retention_by_month(food):
    cohort = food.select("user", "first").withColumn("month", F.trunc("first", "month"))
    got = {(r.month, r.day_since_install): r.retention_rate for r in
           product.retention(cohort, food, "user", "first", "day", by="month").collect()}
    assert got == {(D(2021, 5, 1), 0): 1.0, (D(2021, 5, 1), 2): 1.0, (D(2021, 6, 1), 1): 1.0}


def test_subscription_value_user_in_two_cities(spark, rows):
    df = spark.createDataFrame([("m", "u", D(2024, 9, 1)), ("m", "u", D(2024, 9, 20)), ("s", "u", D(2024, 9, 5)), ("m", "u", D(2024, 10, 1)),
                                ("m", None, D(2024, 10, 1))], "city string, user string, d date")
    assert rows(product.subscription_value(df, "city", "user", "d", 399.0)) == [("m", 1, 2, 798.0), ("s", 1, 1, 399.0)]


def test_income_per_hour_without_hours(spark):
    df = spark.createDataFrame([("u", D(2024, 9, 1), None), ("w", D(2024, 10, 1), 2.0)], "user string, d date, h double")
    got = {r.month.month: (r.mau, r.hours, r.income_per_hour) for r in product.income_per_hour(df, "user", "d", "h", 399.0).collect()}
    assert got == {9: (1, 0.0, None), 10: (1, 2.0, 199.5)}


def test_two_forms_of_paying_share(spark):
    df = spark.createDataFrame([("e", 1), ("e", 0), ("o", 0), (None, 1)], "race string, payer int")
    overall = product.paying_share(df, "payer").first()
    assert (overall.users, overall.payers, overall.paying_share) == (4, 2, 0.5)
    by = {r.race: r.paying_share for r in product.paying_share(df, "payer", ["race"]).collect()}
    assert by == {"e": 0.5, "o": 0.0, None: 1.0}


def test_item_popularity(spark):
    df = spark.createDataFrame([("sword", "a"), ("sword", "a"), ("sword", "b"), ("potion", "b")], "item string, buyer string")
    got = {r["item"]: (r.sales, r.buyers, r.sales_share, r.buyer_share) for r in product.item_popularity(df, "item", "buyer").collect()}
    assert got == {"sword": (3, 2, 0.75, 1.0), "potion": (1, 1, 0.25, 0.5)}


def test_group_activity(spark):
    users = spark.createDataFrame([("a", "elf", 1), ("b", "elf", 0), ("c", "elf", 0), ("d", "orc", 0)], "id string, race string, payer int")
    buys = spark.createDataFrame([("a", 10.0), ("a", 30.0), ("b", 5.0), ("c", 0.0), ("z", 9.0)], "id string, amount double")
    got = {r.race: r for r in product.group_activity(users, buys, "id", "race", "payer", "amount").collect()}
    elf = got["elf"]
    assert (elf.members, elf.buyers, elf.buyer_share, elf.payer_share) == (3, 2, pytest.approx(2 / 3), 0.5)
    assert (elf.purchases_per_buyer, elf.spend_per_buyer, elf.average_price) == (1.5, 22.5, 15.0)
    assert got["orc"].buyers == 0 and got["orc"].payer_share is None


def test_item_value_in_top_entities(spark, rows):
    df = spark.createDataFrame([("r1", "soup", 5.0), ("r1", "soup", 5.0), ("r2", "cake", 7.0), ("r3", "tea", 1.0)], "rest string, dish string, c double")
    assert rows(product.item_value_in_top(df, "rest", "dish", F.col("c"), 2)) == [("r1", "soup", 10.0), ("r2", "cake", 7.0)]


def telecom(spark):
    calls = spark.createDataFrame([(1, D(2018, 1, 5), 300.2), (1, D(2018, 1, 20), 200.1), (2, D(2018, 1, 2), 0.0)], "user int, d date, m double")
    net = spark.createDataFrame([(1, D(2018, 1, 3), 15360.0), (3, D(2018, 2, 3), 20480.0)], "user int, d date, mb double")
    sms = spark.createDataFrame([(2, D(2018, 1, 9))] * 52, "user int, d date")
    return billing.monthly_usage({"minutes": (calls, "d", F.ceil(F.sum("m"))), "mb": (net, "d", F.sum("mb")), "messages": (sms, "d", F.count("d"))}, "user")


def test_monthly_usage_is_the_union_of_user_months(spark, rows):
    assert rows(telecom(spark)) == [(1, D(2018, 1, 1), 501.0, 15360.0, None), (2, D(2018, 1, 1), 0.0, None, 52.0), (3, D(2018, 2, 1), None, 20480.0, None)]


def test_bill_at_and_over_the_allowance(spark):
    # fixed values: the plan costs 550 with 500 minutes, 15 GB, 50 messages; over them 3, 200 and 3
    usage = telecom(spark).withColumns({"inc_m": F.lit(500), "inc_mb": F.lit(15360), "inc_s": F.lit(50), "fee": F.lit(550.0),
                                        "pm": F.lit(3), "pg": F.lit(200), "ps": F.lit(3), "plan": F.lit("smart")})
    over = billing.over_allowance(usage, {"minutes": ("inc_m", 1), "mb": ("inc_mb", 1024), "messages": ("inc_s", 1)})
    cost = billing.monthly_cost(over, "fee", {"minutes": "pm", "mb": "pg", "messages": "ps"})
    got = {r.user: (r.minutes_over, r.mb_over, r.messages_over, r.total_cost) for r in cost.collect()}
    assert got == {1: (1.0, 0.0, 0.0, 553.0), 2: (0.0, 0.0, 2.0, 556.0), 3: (0.0, 5.0, 0.0, 1550.0)}
    plan = billing.cost_by_plan(cost, "plan", "user", "fee", only_over=True).first()
    assert (plan.total_users, plan.avg_total_cost, plan.overcost) == (3, pytest.approx(2659 / 3), pytest.approx(1009 / 3))


def test_blank_churn_date_means_active(spark):
    df = spark.createDataFrame([("",), ("  ",), (None,), ("2018-10-05",)], "d string")
    assert [r.x for r in df.select(billing.is_blank("d").alias("x")).collect()] == [True, True, True, False]


def test_trip_revenue(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 3.0, 50.0, 8.0, 0.0), (1, 1, 20.0, 2.0, 50.0, 8.0, 0.0), (2, 1, 5.0, 4.0, 0.0, 6.0, 199.0)],
                               "u int, month int, dist double, mins double, start double, minute double, fee double")
    got = {r.u: r.revenue for r in billing.trip_revenue(df, ["u", "month"], "mins", "dist", "start", "minute", "fee").collect()}
    assert got == {1: 140.0, 2: 223.0}


def test_currency_without_rate_or_unknown(spark):
    df = spark.createDataFrame([(100.0, "rub", None), (1000.0, "KZT", 19.0), (1000.0, "kzt", None), (5.0, "usd", 19.0)], "a double, c string, r double").withColumn("n", F.lit(100))
    assert [r.x for r in df.select(billing.convert_currency("a", "c", "r", "n", "rub", "kzt").alias("x")).collect()] == [100.0, 190.0, None, None]


def test_return_ratio_with_one_side_missing(spark):
    inv = spark.createDataFrame([(2013, "seed", 10.0), (2014, "seed", 0.0)], "y int, type string, amount double")
    ret = spark.createDataFrame([(2013, "seed", 2.0), (2014, "seed", 1.0), (2015, "angel", 3.0)], "y int, type string, amount double")
    got = {(r.y, r.type): (r.invested, r.returned, r.return_ratio) for r in revenue.return_ratio(inv, ret, ["y", "type"], scale=10.0).collect()}
    assert got == {(2013, "seed"): (10.0, 20.0, 2.0), (2014, "seed"): (0.0, 10.0, None), (2015, "angel"): (None, 30.0, None)}


def test_growth_counts_missing_period_as_zero(spark, rows):
    df = spark.createDataFrame([("a", 2013, 5.0), ("a", 2014, 4.0), ("b", 2014, 1.0), ("c", 2012, 9.0)], "m string, y int, v double")
    assert rows(revenue.growth(df, "m", "y", "v", 2013, 2014)) == [("b", 0.0, 1.0, 1.0)]


def test_ticket_revenue_without_tickets(spark):
    df = spark.createDataFrame([("x", 10.0, 1, "u", 0)], "k string, r double, o int, u string, t int")
    r = revenue.revenue_by(df, ["k"], "r", "o", "u", "t").first()
    assert r.one_ticket_cost is None and r.total_users == 1


def test_several_distinct_counts_copy_no_row(spark):
    from metricloom.operators.aggregates import distinct_counts
    df = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "a", None), (None, "c", None)], "x int, y string, z int")
    out = distinct_counts(df, [], ["x", "y", "z"])
    assert tuple(out.first()) == (2, 3, 0)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert tuple(distinct_counts(df.limit(0), [], ["x", "y"]).first()) == (0, 0)
