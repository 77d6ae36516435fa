"""Usage, allowances and cost of subscriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.dates import month_start
from metricloom.functions.numbers import overage, ratio


def monthly_usage(facts: dict, user: str) -> DataFrame:
    """One row per user and month with the usage of each service; NULL where it was not used.

    ``facts`` maps a service to (DataFrame, date column, aggregate). Each fact is summed on its
    own, so no join can multiply rows, and the results are laid side by side by one more
    grouping: that yields the union of all user-months without joining.
    """
    names = list(facts)
    parts = []
    for name, (df, date, total) in facts.items():
        part = df.groupBy(user, month_start(date).alias("month")).agg(total.cast("double").alias(name))
        parts.append(part.select(user, "month", *[F.col(n) if n == name else F.lit(None).cast("double").alias(n) for n in names]))
    return reduce(DataFrame.unionByName, parts).groupBy(user, "month").agg(*[F.max(n).alias(n) for n in names])


def over_allowance(usage: DataFrame, services: dict) -> DataFrame:
    """``<service>_over`` per service; ``services`` maps it to (included column, unit divisor)."""
    return usage.select("*", *[(overage(s, inc) / F.lit(float(unit))).alias(f"{s}_over")
                               for s, (inc, unit) in services.items()])


def monthly_cost(usage: DataFrame, fee: str, prices: dict) -> DataFrame:
    """``total_cost``: the fee plus every overage at its price."""
    extra = reduce(lambda a, b: a + b, [F.col(f"{s}_over") * F.col(p) for s, p in prices.items()])
    return usage.withColumn("total_cost", F.col(fee) + extra)


def cost_by_plan(costs: DataFrame, plan: str, user: str, fee: str, only_over: bool = False) -> DataFrame:
    """Per plan: users, mean monthly cost and mean excess over the fee."""
    rows = costs.filter(F.col("total_cost") > F.col(fee)) if only_over else costs
    per_user = rows.groupBy(plan, user).agg(F.count("total_cost").alias("_k"), F.sum("total_cost").alias("_s"),
                                            F.sum(F.col("total_cost") - F.col(fee)).alias("_o"))
    return per_user.groupBy(plan).agg(F.count(user).alias("total_users"), ratio(F.sum("_s"), F.sum("_k")).alias("avg_total_cost"),
                                      ratio(F.sum("_o"), F.sum("_k")).alias("overcost"))


def is_blank(col: str) -> Column:
    """NULL or empty text."""
    return F.nullif(F.trim(F.col(col)), F.lit("")).isNull()


def trip_revenue(trips: DataFrame, by, minutes: str, distance: str, start_price: str, minute_price: str, fee: str) -> DataFrame:
    """Monthly revenue of pay-per-use customers: starts, minutes and a fixed fee.

    The prices are attributes of the plan, so they join the grouping key instead of being
    picked from an arbitrary row.
    """
    out = trips.groupBy(*by, start_price, minute_price, fee).agg(
        F.sum(distance).alias("total_distance"), F.sum(minutes).alias("total_minutes"), F.count(minutes).alias("rides"))
    return out.withColumn("revenue", F.col(start_price) * F.col("rides") + F.col(minute_price) * F.col("total_minutes") + F.col(fee))


def convert_currency(amount: str, currency: str, rate: str, nominal: str, home: str, foreign: str) -> Column:
    """Amount in the home currency; other currencies and days without a rate give NULL."""
    code = F.lower(F.col(currency))
    return F.when(code == home, F.col(amount)).when(code == foreign, ratio(F.col(amount) * F.col(rate), nominal))
