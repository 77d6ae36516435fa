"""Product metrics: activity, conversion, value, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.dates import days_between, month_start
from metricloom.functions.numbers import ratio
from metricloom.operators.aggregates import distinct_of
from metricloom.operators.attach import with_scalars, with_share
from metricloom.operators.ordering import top_k


def daily_active(df: DataFrame, day: str, user: str) -> DataFrame:
    """Distinct users per day."""
    return distinct_of(df, [day], user).withColumnRenamed("entities", "dau")


def conversion(df: DataFrame, by, user: str, converted: Column) -> DataFrame:
    """Distinct users, distinct converted users and their ratio per group."""
    out = distinct_of(df, by, user, converted=converted)
    return out.withColumnRenamed("entities", "users").withColumn("conversion", ratio("converted", "users"))


def average_check(df: DataFrame, date: str, order: str, commission: Column) -> DataFrame:
    """Per month: distinct orders, summed commission, commission per order."""
    per_order = (df.withColumn("month", month_start(date)).groupBy("month", order)
                 .agg(F.sum(commission).alias("_c")))
    out = per_order.groupBy("month").agg(F.count(order).alias("orders"), F.coalesce(F.sum("_c"), F.lit(0.0)).alias("commission"))
    return out.withColumn("average_check", ratio("commission", "orders"))


def lifetime_value(df: DataFrame, by, amount: Column) -> DataFrame:
    """Summed commission of each entity."""
    return df.groupBy(*by).agg(F.sum(amount).alias("ltv"))


def item_value_in_top(df: DataFrame, entity: str, item: str, amount: Column, top_entities: int) -> DataFrame:
    """Value of every item sold by the entities with the highest value."""
    items = lifetime_value(df, [entity, item], amount)
    top = top_k(items.groupBy(entity).agg(F.sum("ltv").alias("_total")), top_entities, "-_total", entity)
    return items.join(top.select(entity), entity, "left_semi")


def _lifetimes(cohort: DataFrame, activity: DataFrame, user: str, start: str, day: str, last_day: int | None) -> DataFrame:
    """Distinct (user, cohort columns, days since start) of active days on or after the start."""
    first = cohort.filter(F.col(user).isNotNull()).distinct()
    active = activity.select(user, day).distinct()
    joined = first.join(active, user).filter(F.col(day) >= F.col(start))
    out = joined.withColumn("day_since_install", days_between(day, start))
    return out if last_day is None else out.filter(F.col("day_since_install") <= last_day)


def retention(cohort: DataFrame, activity: DataFrame, user: str, start: str, day: str, last_day: int | None = 7,
              by: str | None = None, denominator: str = "running") -> DataFrame:
    """Users of a cohort (or of each cohort month) still active d days after their start.

    ``denominator='running'`` divides by the largest day seen so far, ``'cohort'`` by the
    number of cohort users.
    """
    keys = [by] if by else []
    lives = _lifetimes(cohort.select(user, start, *keys), activity, user, start, day, last_day)
    # a user can have several start rows; count each once per day of life
    per_day = lives.select(*keys, "day_since_install", user).distinct().groupBy(*keys, "day_since_install").agg(
        F.count(F.lit(1)).alias("retained_users"))
    if denominator == "running":
        w = Window.partitionBy(*keys).orderBy("day_since_install")     # one row per day of life
        sized = per_day.withColumn("_size", F.max("retained_users").over(w))
    else:
        users = cohort.select(*keys, user).filter(F.col(user).isNotNull()).distinct()
        size = users.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
        sized = per_day.join(size, keys) if keys else with_scalars(per_day, size)
    return sized.withColumn("retention_rate", ratio("retained_users", "_size")).drop("_size")


def active_cohort(df: DataFrame, user: str, day: str, start_day) -> DataFrame:
    """Users active on one fixed day, with that day as their start."""
    return df.filter(F.col(day) == F.lit(start_day).cast("date")).select(user).distinct().withColumn(
        "start_day", F.lit(start_day).cast("date"))


def monthly_audience(df: DataFrame, by, user: str) -> DataFrame:
    """Distinct users per content entity."""
    return distinct_of(df, by, user).withColumnRenamed("entities", "mau")


def subscription_value(df: DataFrame, city: str, user: str, date: str, fee: float) -> DataFrame:
    """Per city: users, paid user-months, mean income per user at a flat monthly fee."""
    months = df.select(city, user, month_start(date).alias("_m")).filter(F.col(user).isNotNull()).distinct()
    per_user = months.groupBy(city, user).agg(F.count(F.lit(1)).alias("_months"))
    out = per_user.groupBy(city).agg(F.count(F.lit(1)).alias("total_users"), F.sum("_months").alias("paid_months"))
    return out.withColumn("ltv", ratio(F.col("paid_months") * F.lit(fee), "total_users"))


def income_per_hour(df: DataFrame, user: str, date: str, hours: str, fee: float) -> DataFrame:
    """Per month: users, hours used, subscription income per hour."""
    per_user = df.withColumn("month", month_start(date)).groupBy("month", user).agg(
        F.sum(F.coalesce(F.col(hours), F.lit(0.0))).alias("_h"))
    out = per_user.groupBy("month").agg(F.count(user).alias("mau"), F.sum("_h").alias("hours"))
    return out.withColumn("income_per_hour", ratio(F.col("mau") * F.lit(fee), "hours"))


def hours_by_user(df: DataFrame, city: str, user: str, hours: str) -> DataFrame:
    """Total hours of every user per city; unknown hours count as none."""
    return df.groupBy(city, user).agg(F.sum(F.coalesce(F.col(hours), F.lit(0.0))).alias("hours"))


def paying_share(df: DataFrame, flag: str, by=()) -> DataFrame:
    """Users, paying users and their share, overall or per group; ``flag`` is 0 or 1."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("users"), F.sum(flag).alias("payers"))
    return out.withColumn("paying_share", ratio("payers", "users"))


def zero_share(df: DataFrame, amount: str) -> DataFrame:
    """Purchases, zero purchases and their share."""
    out = df.agg(F.count(amount).alias("purchases"), F.count_if(F.col(amount) == 0).alias("zero_purchases"))
    return out.withColumn("zero_share", ratio("zero_purchases", "purchases"))


def item_popularity(df: DataFrame, item: str, buyer: str) -> DataFrame:
    """Per item: sales, share of all sales, share of all buyers who bought it."""
    per_buyer = df.groupBy(item, buyer).agg(F.count(F.lit(1)).alias("_k"))
    items = per_buyer.groupBy(item).agg(F.sum("_k").alias("sales"), F.count(buyer).alias("buyers"))
    # both totals from the same item-buyer counts, so their shuffle can serve both
    totals = (per_buyer.groupBy(buyer).agg(F.sum("_k").alias("_k"))
              .agg(F.sum("_k").alias("_sales"), F.count(buyer).alias("_buyers")))
    out = with_scalars(items, totals)
    return (out.withColumn("sales_share", ratio("sales", "_sales")).withColumn("buyer_share", ratio("buyers", "_buyers"))
            .drop("_sales", "_buyers"))


def group_activity(users: DataFrame, purchases: DataFrame, user: str, group: str, payer: str, amount: str) -> DataFrame:
    """Per user group: members, buyers, payers among buyers, purchases and spend per buyer."""
    spent = (purchases.filter(F.col(amount) != 0).groupBy(user)
             .agg(F.count(F.lit(1)).alias("_k"), F.sum(amount).alias("_s")))
    joined = users.select(user, group, payer).join(spent, user, "left")
    bought = F.col("_k").isNotNull()
    out = joined.groupBy(group).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(bought).alias("buyers"),
        F.count_if(bought & (F.col(payer) == 1)).alias("_paying"),
        F.avg("_k").alias("purchases_per_buyer"), F.avg("_s").alias("spend_per_buyer"))
    return (out.withColumn("buyer_share", ratio("buyers", "members"))
            .withColumn("payer_share", ratio("_paying", "buyers"))
            .withColumn("average_price", ratio("spend_per_buyer", "purchases_per_buyer")).drop("_paying"))


def daily_profile(df: DataFrame, day: str, order: str, user: str, price: str) -> DataFrame:
    """Per day: orders, users, orders per user, mean ticket price (rounded like the report)."""
    per_user = df.groupBy(day, user).agg(F.count(order).alias("_k"), F.sum(price).alias("_s"), F.count(price).alias("_c"))
    out = per_user.groupBy(day).agg(F.sum("_k").alias("orders"), F.count(user).alias("users"),
                                    ratio(F.sum("_s"), F.sum("_c")).alias("average_price"))
    return out.withColumn("orders_per_user", ratio("orders", "users"))


def category_share_inside(df: DataFrame, outer: str, inner: str, total: Column | None = None) -> DataFrame:
    """Rows (or another total) per (outer, inner) and share inside the outer group."""
    out = df.groupBy(outer, inner).agg((F.count(F.lit(1)) if total is None else total).alias("total"))
    return with_share(out, "total", "share", by=[outer])


