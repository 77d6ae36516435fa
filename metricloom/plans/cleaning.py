"""Data quality reports and cleaning steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import day, midpoint, within_days
from metricloom.operators import cleaning, quality
from metricloom.plans.registry import query


def gappy(t):
    """Orders with missing status, priority and total."""
    return t.orders.select(
        "o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"),
        F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("o_totalprice"), day("o_orderdate").alias("o_orderdate"))


GAPPY = """SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
  CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS o_totalprice, o_orderdate::DATE AS o_orderdate FROM orders"""


@query("QUA1", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{k}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
  round_even(100 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS missing_percent FROM ({GAPPY})""" for c, k in (
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string"), ("o_totalprice", "double"), ("o_orderdate", "date"))))
def missing_values(t):
    return quality.missing_report(gappy(t))


@query("QUA2", """SELECT 'score' AS "column", count(*) FILTER (WHERE s < 0) AS sentinel_count, round_even(100 * avg((s < 0)::INT), 2) AS sentinel_percent
  FROM (SELECT coalesce(o_totalprice, -1) AS s FROM (""" + GAPPY + "))")
def sentinel_values(t):
    df = cleaning.fill_missing(gappy(t), {"o_totalprice": -1.0})
    return quality.sentinel_report(df, {"score": F.col("o_totalprice") < 0})


@query("QUA3", " UNION ALL ".join(f"""SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT), 6) AS null_corr FROM ({GAPPY})"""
  for a, b in (("o_orderstatus", "o_orderpriority"), ("o_orderstatus", "o_totalprice"), ("o_orderpriority", "o_totalprice"))))
def missing_together(t):
    out = quality.missing_cooccurrence(gappy(t), ["o_orderstatus", "o_orderpriority", "o_totalprice"])
    return out.withColumn("null_corr", F.round("null_corr", 6))


@query("QUA4", f"SELECT * FROM ({GAPPY}) WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL")
def rows_without_gaps(t):
    return cleaning.drop_missing(gappy(t), ["o_orderstatus", "o_totalprice"])


@query("QUA5", f"SELECT o_orderkey, coalesce(o_totalprice, -1) AS o_totalprice, coalesce(o_orderstatus, 'unknown') AS o_orderstatus FROM ({GAPPY})")
def gaps_filled_by_constant(t):
    out = cleaning.fill_missing(gappy(t), {"o_totalprice": -1.0, "o_orderstatus": "unknown"})
    return out.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("QUA7", f"""SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM ({GAPPY}) WHERE o_orderpriority IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM ({GAPPY})""")
def gaps_filled_by_mode(t):
    return cleaning.fill_with_mode(gappy(t), "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("QUA8", """SELECT l_orderkey, l_linenumber, round(coalesce(nullif(l_extendedprice, 50000), l_tax + nullif(l_discount, 0)), 6) AS filled FROM lineitem""")
def gaps_filled_from_row(t):
    li = t.lineitem.withColumn("price", F.when(F.col("l_extendedprice") != 50000, F.col("l_extendedprice")))
    out = cleaning.fill_from(li, "price", F.col("l_tax") + F.nullif(F.col("l_discount"), F.lit(0.0)))
    return out.select("l_orderkey", "l_linenumber", F.round("price", 6).alias("filled"))


@query("QUA8 DAT8", """SELECT o_custkey, coalesce(CASE WHEN n > 10 THEN b END, (a + floor((b - a) / 2)::INT)) AS mid_date FROM
  (SELECT o_custkey, count(*) AS n, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1)""")
def missing_date_from_midpoint(t):
    spans = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(day("o_orderdate")).alias("a"), F.max(day("o_orderdate")).alias("b"))
    known = spans.withColumn("mid_date", F.when(F.col("n") > 10, F.col("b")))
    return cleaning.fill_from(known, "mid_date", midpoint("a", "b")).select("o_custkey", "mid_date")


@query("QUA9", f"""WITH g AS ({GAPPY}) SELECT o_orderkey, round(coalesce(o_totalprice, m), 4) AS o_totalprice FROM g LEFT JOIN
  (SELECT o_orderstatus AS s, year(o_orderdate) AS y, avg(o_totalprice) AS m FROM g GROUP BY 1, 2) ON s IS NOT DISTINCT FROM o_orderstatus AND y = year(o_orderdate)""")
def gaps_filled_by_group_mean(t):
    g = gappy(t).withColumn("y", F.year("o_orderdate"))
    out = cleaning.fill_with_group_mean(g, "o_totalprice", ["o_orderstatus", "y"])
    return out.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


def hashed(t):
    """Documents by the digest of the whole text: equal texts meet without moving the texts."""
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"), "lang")


SUMMARY = "sum(k)::BIGINT AS n_rows, sum(k - 1)::BIGINT AS extra_rows, coalesce(sum(k) FILTER (WHERE k > 1), 0)::BIGINT AS rows_in_duplicates"


@query("QUA10", f"SELECT {SUMMARY} FROM (SELECT count(*) AS k FROM documents GROUP BY text)")
def duplicate_texts(t):
    return quality.duplicate_summary(hashed(t), ["digest"])


@query("QUA10", f"SELECT {SUMMARY} FROM (SELECT count(*) AS k FROM part GROUP BY p_name, p_brand)")
def duplicate_full_rows(t):
    return quality.duplicate_summary(t.part.select("p_name", "p_brand"))


@query("QUA10", "SELECT p_partkey, p_name, p_brand FROM part WHERE (p_name, p_brand) IN (SELECT (p_name, p_brand) FROM part GROUP BY p_name, p_brand HAVING count(*) > 1)")
def rows_sharing_a_key(t):
    return quality.rows_in_duplicates(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"])


def _dedupe(direction):
    return f"""SELECT doc_id, sha256(text) AS digest, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id {direction}) AS r FROM documents) WHERE r = 1"""


@query("QUA11", _dedupe("ASC"))
def first_of_duplicates(t):
    return cleaning.keep_one(hashed(t), ["digest"], ["doc_id"])


@query("QUA11", _dedupe("DESC"))
def last_of_duplicates(t):
    return cleaning.keep_one(hashed(t), ["digest"], ["doc_id"], keep="last")


@query("QUA11", "SELECT DISTINCT p_name, p_brand, p_type FROM part")
def distinct_full_rows(t):
    return t.part.select("p_name", "p_brand", "p_type").dropDuplicates()


@query("QUA12", """SELECT p_name, p_brand, p_type, round(sum(p_retailprice), 2) AS p_retailprice, min(p_size) AS p_size FROM part GROUP BY 1, 2, 3""")
def near_duplicates_merged(t):
    p = t.part.select("p_name", "p_brand", "p_type", "p_retailprice", "p_size")
    return cleaning.merge_near_duplicates(p, ["p_name", "p_brand", "p_type"], ["p_retailprice"]).withColumn("p_retailprice", F.round("p_retailprice", 2))


@query("QUA13", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n_rows FROM ({GAPPY}) GROUP BY 2" for c in ("o_orderstatus", "o_orderpriority")))
def category_vocabulary(t):
    return quality.vocabulary(gappy(t), ["o_orderstatus", "o_orderpriority"])


SPANS = """SELECT l_orderkey, o_orderdate::DATE AS founded, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'A' GROUP BY 1, 2"""


@query("QUA14", f"""SELECT l_orderkey FROM ({SPANS}) WHERE coalesce(last < first + 10, false) OR coalesce(founded > first, false) OR coalesce(last - founded > 115, false)""")
def date_order_anomalies(t):
    li = t.lineitem.filter(F.col("l_returnflag") != "A")
    shipped = li.groupBy("l_orderkey").agg(F.min(day("l_shipdate")).alias("first"), F.max(day("l_shipdate")).alias("last"))
    spans = shipped.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("founded")), "l_orderkey")
    wrong = [F.col("last") < F.date_add("first", 10), F.col("founded") > F.col("first"), ~within_days("last", "founded", 115)]
    return spans.filter(quality.any_of(wrong)).select("l_orderkey")


@query("QUA15", f"""WITH s AS (SELECT 0 AS step, 'loaded' AS stage, count(*) AS n_rows FROM orders UNION ALL SELECT 1, 'known status', count(o_orderstatus) FROM ({GAPPY})
  UNION ALL SELECT 2, 'known total', count(*) FROM ({GAPPY}) WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL)
  SELECT *, round_even(100.0 * (1 - n_rows / (SELECT n_rows FROM s WHERE step = 0)), 4) AS removed_percent FROM s""")
def rows_per_stage(t):
    g = gappy(t)
    known = cleaning.drop_missing(g, ["o_orderstatus"])
    return quality.row_audit({"loaded": g, "known status": known, "known total": cleaning.drop_missing(known, ["o_totalprice"])})


@query("QUA16", """SELECT o_custkey, count(o_orderpriority) AS n_plans FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(o_orderpriority) > 1""")
def customers_with_several_plans(t):
    return quality.keys_with_many(t.orders.filter(F.col("o_orderstatus") == "F"), "o_custkey", "o_orderpriority", "n_plans")


@query("QUA17", """SELECT min(o_orderdate) AS min_o_orderdate, max(o_orderdate) AS max_o_orderdate, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders""")
def value_ranges(t):
    return quality.value_range(t.orders, ["o_orderdate", "o_totalprice"])
