"""Scans, file reads, hand-offs, table inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import day
from metricloom.functions.numbers import parse_number
from metricloom.operators.quality import table_overview
from metricloom.plans.registry import query
from metricloom.sources.tables import inline_rows, read_csv, run_sql, shared_path, write_extract


@query("SRC1", "SELECT * FROM supplier")
def scan_table(t):
    return t.supplier


@query("SRC1", "SELECT o_orderstatus, count(*) AS n_orders FROM orders GROUP BY 1")
def scan_through_view(t):
    return run_sql(t.spark, t.directory, "SELECT o_orderstatus, count(*) AS n_orders FROM {orders} GROUP BY o_orderstatus", ["orders"])


@query("SRC2", """SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total,
  min(o_orderdate)::DATE AS first_day FROM orders GROUP BY 1""")
def csv_typed_read(t):
    path = write_extract(t.orders.withColumn("o_orderdate", day("o_orderdate")), shared_path(t.spark, "orders-csv"),
                         fmt="csv", header=True)
    df = read_csv(t.spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                                 "o_orderdate date, o_orderpriority string")
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"),
                                           F.min("o_orderdate").alias("first_day"))


@query("SRC3 STR3", """SELECT p_brand, count(*) AS n_parts, round(sum(p_retailprice * 1000), 2) AS total FROM part GROUP BY 1""")
def csv_semicolon_compressed(t):
    padded = t.part.select(F.col("p_brand").alias(" P Brand "), F.format_number(F.col("p_retailprice") * 1000, 2).alias(" Price Text "))
    path = write_extract(padded, shared_path(t.spark, "part-csv"), fmt="csv", header=True, sep=";", compression="gzip")
    df = read_csv(t.spark, path, "` P Brand ` string, ` Price Text ` string", sep=";", tidy_headers=True)
    return df.groupBy("p_brand").agg(F.count("*").alias("n_parts"), F.round(F.sum(parse_number("price_text")), 2).alias("total"))


@query("SRC4", "SELECT n_nationkey, n_name FROM nation")
def csv_index_dropped(t):
    df = t.nation.select(F.col("n_regionkey").alias("_c0"), "n_nationkey", "n_name")
    path = write_extract(df, shared_path(t.spark, "nation-csv"), fmt="csv", header=True)
    return read_csv(t.spark, path, "_c0 int, n_nationkey int, n_name string", index="drop")


@query("SRC4", "SELECT n_nationkey AS nation_id, n_name FROM nation")
def csv_index_as_key(t):
    path = write_extract(t.nation.select(F.col("n_nationkey").alias("_c0"), "n_name"), shared_path(t.spark, "nation-csv"),
                         fmt="csv", header=True)
    return read_csv(t.spark, path, "_c0 int, n_name string", index="nation_id")


@query("SRC5", """SELECT event_type, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1""")
def csv_parsed_timestamps(t):
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    path = write_extract(t.events.select("event_id", "ts", "event_type"), shared_path(t.spark, "events-csv"), fmt="csv",
                         header=True, compression="gzip", timestampNTZFormat=fmt)
    df = read_csv(t.spark, path, "event_id bigint, ts timestamp_ntz, event_type string", timestamp_format=fmt)
    return df.groupBy("event_type").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SRC6", """SELECT label, count(*) AS n_orders FROM orders JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'pending'))
  AS d(code, label) ON o_orderstatus = code GROUP BY 1""")
def inline_dimension(t):
    labels = inline_rows(t.spark, [("F", "finished"), ("O", "open"), ("P", "pending")], "code string, label string")
    return t.orders.join(labels, F.col("o_orderstatus") == F.col("code")).groupBy("label").agg(F.count("*").alias("n_orders"))


@query("SRC7", """SELECT n_name AS city, user_id, round(sum(value), 2) AS hours FROM events JOIN customer ON user_id = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def extract_hand_off(t):
    per_user = (t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"))
                .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .groupBy(F.col("n_name").alias("city"), "user_id").agg(F.round(F.sum("value"), 2).alias("hours")))
    # few files per city folder, yet a city with very many rows is still written by several tasks
    path = write_extract(per_user.hint("rebalance", "city"), shared_path(t.spark, "hours"), partition_by=["city"])
    return t.spark.read.parquet(path)


@query("SRC8", """SELECT row_number() OVER ()::INT AS position, column_name AS "column",
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
       WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type,
  (SELECT count(*) FROM lineitem) AS n_rows FROM (DESCRIBE lineitem)""")
def overview_of_lineitem(t):
    return table_overview(t.lineitem)
