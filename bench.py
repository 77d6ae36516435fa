"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs twice; ``queries`` holds the second (warm) run, ``cold`` the first, ``value``
the sum of the warm runs. Results go to a sink that reads every row.
"""

from __future__ import annotations

import json
import os
import time

from metricloom.plans import REGISTRY
from metricloom.session import local_session

HEADLINE = [
    "top_regions_by_revenue", "revenue_by_event_type", "revenue_by_week", "region_shares", "hierarchy_totals",
    "average_check_per_month", "top_items_by_value", "item_popularity", "daily_conversion", "retention_of_new_users",
    "retention_by_cohort_month", "subscription_value_by_city", "over_limit_clients_by_plan", "ride_revenue_per_user_month",
    "discrete_percentiles", "describe_columns", "outlier_shares", "inside_percentile_limits", "listing_segments",
    "listing_seasonality", "days_since_previous_order", "session_number_per_user", "first_of_duplicates", "missing_values",
    "histogram_of_totals", "association_by_cramers_v", "student_t_test", "mann_whitney_greater", "conversion_readout",
    "return_ratio_by_type",
]


def timed(spark, name, directory):
    start = time.perf_counter()
    REGISTRY[name].run(spark, directory).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main():
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = timed(spark, name, directory)
        warm[name] = timed(spark, name, directory)
    print(json.dumps({
        "metric": f"total seconds of {len(HEADLINE)} analytics queries (warm run)", "value": round(sum(warm.values()), 3),
        "unit": "sec", "queries": warm, "cold": cold, "cold_value": round(sum(cold.values()), 3),
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
