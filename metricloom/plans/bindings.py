"""Derived tables shared by the queries, each with the same table as SQL text.

The bundled tables stand in for the business entities: lineitem rows are sales, events are app
activity, customers carry the dimensions of a user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.dates import day

def money():
    """Discounted price of a sale line."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def sales(t) -> DataFrame:
    """Sale lines with their order, buyer, country and continent."""
    return (t.lineitem.withColumn("revenue", money())
            .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))


SALES = """SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def visits(t) -> DataFrame:
    """App events with day, and segment, country and continent of the user."""
    return (t.events.withColumn("log_date", day("ts"))
            .join(t.customer, F.col("user_id") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))


VISITS = """SELECT *, ts::DATE AS log_date FROM events JOIN customer ON user_id = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def split(t) -> DataFrame:
    """Events with the test group of the user."""
    return t.events.withColumn("grp", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"))


SPLIT = "SELECT *, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS grp FROM events"
