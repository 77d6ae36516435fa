"""Checks and readouts of split tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.dates import elapsed_days
from metricloom.functions.numbers import percent_difference, ratio
from metricloom.operators.attach import null_safe_join, with_share
from metricloom.operators.cleaning import keep_one


def group_sizes(df: DataFrame, user: str, group: str, first, second) -> DataFrame:
    """One row: users in each group and their difference in percent of the first."""
    pairs = df.select(user, group).filter(F.col(user).isNotNull()).distinct()
    out = pairs.agg(F.count_if(F.col(group) == first).alias("users_1"), F.count_if(F.col(group) == second).alias("users_2"))
    return out.withColumn("difference_percent", percent_difference("users_1", "users_2"))


def users_in_several(df: DataFrame, user: str, group: str) -> DataFrame:
    """Users seen in more than one group, with the number of groups."""
    pairs = df.select(user, group).dropna().distinct()
    return pairs.groupBy(user).agg(F.count(F.lit(1)).alias("n_groups")).filter(F.col("n_groups") > 1)


def without_users(df: DataFrame, users: DataFrame, user: str) -> DataFrame:
    """Rows of everyone else."""
    return df.join(users.select(user), user, "left_anti")


def group_balance(df: DataFrame, user: str, group: str, attribute: str) -> DataFrame:
    """Distinct users per group and attribute value, and their share inside the group."""
    out = (df.select(group, attribute, user).dropna().distinct()
           .groupBy(group, attribute).agg(F.count(F.lit(1)).alias("users")))
    return with_share(out, "users", "share", by=[group])


def roster(df: DataFrame, user: str, order, test: str, name) -> DataFrame:
    """Participants of one test, each user counted only in the test they entered first."""
    return keep_one(df, [user], order).filter(F.col(test) == name)


def within_lifetime(df: DataFrame, user: str, moment: str, days: int) -> DataFrame:
    """Events in the first ``days`` whole days after the user's first event, with ``lifetime``."""
    first = df.groupBy(user).agg(F.min(moment).alias("_first"))
    out = null_safe_join(df, first, [user]).withColumn("lifetime", elapsed_days(moment, "_first"))
    return out.filter(F.col("lifetime") < days).drop("_first")


def readout(df: DataFrame, user: str, group: str, converted: Column, first, second) -> DataFrame:
    """One row: users, converted users and rate of each group, absolute and relative uplift.

    The relative uplift is taken against the second group's own rate.
    """
    per_user = (df.filter(F.col(user).isNotNull()).groupBy(user, group)
                .agg(F.max(F.coalesce(converted, F.lit(False)).cast("int")).alias("_hit")))
    of = lambda g, tag: [F.count_if(F.col(group) == g).alias(f"n_{tag}"),
                         F.coalesce(F.sum(F.when(F.col(group) == g, F.col("_hit"))), F.lit(0)).alias(f"hits_{tag}")]
    out = per_user.agg(*of(first, "a"), *of(second, "b"))
    out = out.withColumn("p_a", ratio("hits_a", "n_a")).withColumn("p_b", ratio("hits_b", "n_b"))
    return (out.withColumn("uplift_points", (F.col("p_b") - F.col("p_a")) * 100)
            .withColumn("uplift_percent", ratio(F.col("p_b") - F.col("p_a"), "p_b") * 100))


def per_user_metric(df: DataFrame, user: str, group: str, metric: Column) -> DataFrame:
    """One row per user and group with an aggregated metric, ready for a test."""
    return df.filter(F.col(user).isNotNull()).groupBy(user, group).agg(metric.alias("metric"))
