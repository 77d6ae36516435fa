"""Revenue breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numbers import ratio


def revenue_by(df: DataFrame, by, amount: str, order: str, user: str | None = None, tickets: str | None = None,
               **extra: Column) -> DataFrame:
    """Per group: revenue, orders, revenue per order, and buyers / tickets when asked for."""
    aggs = [F.sum(amount).alias("total_revenue"), F.count(order).alias("total_orders"),
            F.avg(amount).alias("avg_revenue_per_order")]
    if user:
        aggs.append(F.count_distinct(user).alias("total_users"))
    if tickets:
        aggs += [F.sum(tickets).alias("total_tickets"), ratio(F.sum(amount), F.sum(tickets)).alias("one_ticket_cost")]
    return df.groupBy(*by).agg(*aggs, *[c.alias(n) for n, c in extra.items()])


def return_ratio(invested: DataFrame, returned: DataFrame, keys, scale: float = 1.0) -> DataFrame:
    """Returned over invested per key, for every key present on either side."""
    from metricloom.operators.reshape import stack_tagged
    both = stack_tagged({"invested": invested.select(*keys, "amount"), "returned": returned.select(*keys, "amount")}, "_side")
    side = lambda s: F.sum(F.when(F.col("_side") == s, F.col("amount")))
    out = both.groupBy(*keys).agg(side("invested").alias("invested"), (side("returned") * scale).alias("returned"))
    return out.withColumn("return_ratio", ratio("returned", "invested"))


def growth(df: DataFrame, key: str, period: str, amount: str, old, new) -> DataFrame:
    """Totals of two periods side by side for the keys that grew; missing periods count as 0."""
    of = lambda p: F.coalesce(F.sum(F.when(F.col(period) == p, F.col(amount))), F.lit(0.0))
    out = df.filter(F.col(period).isin(old, new)).groupBy(key).agg(of(old).alias("old_total"), of(new).alias("new_total"))
    return out.filter(F.col("new_total") > F.col("old_total")).withColumn("gain", F.col("new_total") - F.col("old_total"))
