"""Outliers and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.dates import day
from metricloom.functions.numbers import ratio
from metricloom.operators import outliers, segments
from metricloom.operators.aggregates import with_empty_groups
from metricloom.operators.attach import with_share
from metricloom.plans.registry import query


@query("OUT1", """WITH l AS (SELECT quantile_disc(l_extendedprice, 0.99) AS p, quantile_disc(l_quantity, 0.99) AS qh, quantile_disc(l_quantity, 0.01) AS ql,
  quantile_disc(nullif(l_discount, 0), 0.99) AS d FROM lineitem)
  SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM (SELECT *, nullif(l_discount, 0) AS dd FROM lineitem), l
  WHERE l_extendedprice < p AND l_quantity < qh AND l_quantity > ql AND (dd < d OR dd IS NULL) GROUP BY 1""")
def inside_percentile_limits(t):
    li = t.lineitem.withColumn("discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    columns = ["l_extendedprice", "l_quantity", "discount"]
    limits = outliers.percentile_limits(li, columns)
    kept = outliers.within_limits(li, limits, below_high=columns, above_low=["l_quantity"], null_passes=["discount"])
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


FENCED = """SELECT {k}, x, quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.75) OVER w AS q3, count(x) OVER w AS n FROM ({s}) WINDOW w AS (PARTITION BY {k})"""
OUTSIDE = "n >= 4 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))"
PER_CUSTOMER = "SELECT c_mktsegment AS g, o_custkey, sum(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


def per_customer(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("g"), "o_custkey").agg(F.sum("o_totalprice").alias("x"))


@query("OUT2", f"""SELECT g, o_custkey, round(x, 2) AS x FROM ({FENCED.format(k='g, o_custkey', s=PER_CUSTOMER).replace('PARTITION BY g, o_custkey', 'PARTITION BY g')}) WHERE {OUTSIDE}""")
def outlying_customers(t):
    return outliers.flag_outliers(per_customer(t), "x", ["g"]).filter("is_outlier").select("g", "o_custkey", F.round("x", 2).alias("x"))


SHARES = f"""SELECT {{k}}, count(*) AS n_rows, count(*) FILTER (WHERE {OUTSIDE}) AS n_outliers, round(100.0 * count(*) FILTER (WHERE {OUTSIDE}) / count(*), 6) AS outlier_percent"""


@query("OUT3", SHARES.format(k="l_suppkey") + " FROM (" + FENCED.format(k="l_suppkey", s="SELECT l_suppkey, l_extendedprice / l_quantity * l_tax AS x FROM lineitem") + ") GROUP BY 1")
def outlier_shares(t):
    li = t.lineitem.select("l_suppkey", (ratio("l_extendedprice", "l_quantity") * F.col("l_tax")).alias("x"))
    return outliers.outlier_share(li, "x", ["l_suppkey"]).withColumn("outlier_percent", F.round("outlier_percent", 6))


@query("OUT3", "SELECT *, row_number() OVER (ORDER BY outlier_percent DESC, l_partkey)::INT AS position FROM (" + SHARES.format(k="l_partkey") + " FROM ("
       + FENCED.format(k="l_partkey", s="SELECT l_partkey, l_extendedprice AS x FROM lineitem") + ") GROUP BY 1) WHERE n_outliers > 0 ORDER BY position LIMIT 20")
def groups_with_most_outliers(t):
    top = outliers.top_outlier_shares(t.lineitem, "l_extendedprice", ["l_partkey"])
    return top.withColumn("outlier_percent", F.round("outlier_percent", 6))


@query("OUT4", """WITH e AS (SELECT event_type, value - 20 AS v FROM events WHERE value >= 20), l AS (SELECT event_type AS k, quantile_cont(v, 0.99) AS p FROM e GROUP BY 1)
  SELECT event_type, count(*) AS n, round(sum(v), 2) AS total FROM e JOIN l ON event_type = k WHERE v <= p GROUP BY 1""")
def upper_tail_trimmed(t):
    e = t.events.select("event_type", (F.col("value") - 20).alias("v"))
    return outliers.trim_upper(e, "v", ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("OUT5", f"""SELECT g, m, CASE WHEN n >= 1 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) THEN NULL ELSE round(x, 4) END AS x FROM (SELECT g, m, x,
  quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.75) OVER w AS q3, count(x) OVER w AS n FROM
  (SELECT l_returnflag AS g, l_shipdate::DATE AS m, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY g))""")
def outliers_blanked(t):
    daily = t.lineitem.groupBy(F.col("l_returnflag").alias("g"), day("l_shipdate").alias("m")).agg(F.sum("l_extendedprice").alias("x"))
    return outliers.blank_outliers(daily, "x", ["g"]).withColumn("x", F.round("x", 4))


@query("OUT6", """SELECT year(l_shipdate)::INT AS y, count(*) AS n FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 0.13::DOUBLE * (SELECT sum(l_quantity) FROM lineitem)""")
def large_groups_kept(t):
    li = t.lineitem.select(F.year("l_shipdate").alias("y"), "l_quantity")
    return outliers.keep_large_groups(li, "y", F.sum("l_quantity"), share=0.13).groupBy("y").agg(F.count("*").alias("n"))


@query("SEG1 AGG18", """SELECT band, coalesce(n, 0) AS n FROM (VALUES ('low'), ('middle'), ('high'), ('extra')) d(band) LEFT JOIN (SELECT CASE WHEN p_size >= 1 AND p_size < 10 THEN 'low'
  WHEN p_size >= 10 AND p_size < 35 THEN 'middle' WHEN p_size >= 35 AND p_size <= 50 THEN 'high' END AS b, count(*) AS n FROM part GROUP BY 1) ON b = band""")
def score_bands(t):
    counts = t.part.groupBy(segments.bands("p_size", [1, 10, 35, 50], ["low", "middle", "high"]).alias("band")).agg(F.count("*").alias("n"))
    domain = t.spark.createDataFrame([("low",), ("middle",), ("high",), ("extra",)], "band string")
    return with_empty_groups(counts, domain, ["band"], {"n": 0})


@query("SEG1", """SELECT CASE WHEN p_size >= 1 AND p_size < 10 THEN 'low' WHEN p_size >= 10 AND p_size < 35 THEN 'middle'
  WHEN p_size >= 35 AND p_size < 50 THEN 'high' END AS band, count(*) AS n FROM part GROUP BY 1""")
def score_bands_open_top(t):
    band = segments.bands("p_size", [1, 10, 35, 50], ["low", "middle", "high"], include_top=False)
    return t.part.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


COMPANIES = """SELECT o_custkey, min(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END)::DATE AS a, max(o_orderdate)::DATE AS b, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1"""
SPAN = """CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN n = 1 THEN 'single' WHEN b - a <= 365 THEN 'up to a year' ELSE 'over a year' END"""


def companies(t):
    settled = F.when(F.col("o_orderstatus") != "P", day("o_orderdate"))
    return t.orders.groupBy("o_custkey").agg(F.min(settled).alias("a"), F.max(day("o_orderdate")).alias("b"),
                                             F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("SEG2", f"SELECT {SPAN} AS span, count(*) AS companies FROM ({COMPANIES}) GROUP BY 1")
def span_groups(t):
    return companies(t).groupBy(segments.span_group("a", "b", "n").alias("span")).agg(F.count("*").alias("companies"))


@query("SEG3", """SELECT p_partkey, p_brand, n AS key_count, CASE WHEN n > 0.04::DOUBLE * (SELECT count(nullif(p_brand, 'Brand#4')) FROM part) THEN 'mass' WHEN n >= 0.039::DOUBLE * (SELECT count(nullif(p_brand, 'Brand#4')) FROM part) THEN 'mid' WHEN n IS NOT NULL THEN 'niche' END AS size_class
  FROM (SELECT p_partkey, nullif(p_brand, 'Brand#4') AS p_brand FROM part) p LEFT JOIN (SELECT nullif(p_brand, 'Brand#4') AS b, count(*) AS n FROM part GROUP BY 1) ON b = p.p_brand""")
def segment_by_population(t):
    p = t.part.select("p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#4")).alias("p_brand"))
    return segments.with_size_class(p, "p_brand", mass_over=0.04, mid_from=0.039, shares=True)


@query("SEG4", """SELECT market, count(*) AS n FROM (SELECT CASE WHEN n > 0.04::DOUBLE * (SELECT count(nullif(p_brand, 'Brand#4')) FROM part) THEN b WHEN n >= 0.039::DOUBLE * (SELECT count(nullif(p_brand, 'Brand#4')) FROM part) THEN 'mid' ELSE 'niche' END AS market
  FROM (SELECT p_partkey, nullif(p_brand, 'Brand#4') AS p_brand FROM part) p LEFT JOIN (SELECT nullif(p_brand, 'Brand#4') AS b, count(*) AS n FROM part GROUP BY 1) ON b = p.p_brand) GROUP BY 1""")
def small_markets_collapsed(t):
    p = t.part.select("p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#4")).alias("p_brand"))
    classed = segments.with_size_class(p, "p_brand", mass_over=0.04, mid_from=0.039, shares=True)
    return classed.groupBy(segments.collapse_small("p_brand").alias("market")).agg(F.count("*").alias("n"))


@query("SEG6", f"""SELECT span, companies, round(total, 2) AS total, round(100.0 * companies / sum(companies) OVER (), 6) AS companies_percent, round(100.0 * total / sum(total) OVER (), 6) AS total_percent
  FROM (SELECT {SPAN} AS span, count(*) AS companies, sum(total) AS total FROM ({COMPANIES}) GROUP BY 1) WHERE span <> 'unknown'""")
def segment_shares(t):
    known = companies(t).withColumn("span", segments.span_group("a", "b", "n")).filter(F.col("span") != "unknown")
    out = segments.share_by_segment(known, "span", companies=F.count("*"), total=F.sum("total"))
    return out.withColumns({"total": F.round("total", 2), "companies_percent": F.round("companies_percent", 6), "total_percent": F.round("total_percent", 6)})


@query("SEG6", """SELECT size_class, count(*) AS n_keys, sum(n)::BIGINT AS n_rows, round(100.0 * sum(n) / sum(sum(n)) OVER (), 6) AS row_percent FROM (SELECT n, CASE WHEN n > 0.04::DOUBLE * (SELECT count(p_brand) FROM part) THEN 'mass' WHEN n >= 0.039::DOUBLE * (SELECT count(p_brand) FROM part) THEN 'mid' ELSE 'niche' END AS size_class
  FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)) GROUP BY 1""")
def size_class_shares(t):
    return segments.size_class_summary(t.part, "p_brand", 0.04, 0.039, shares=True).withColumn("row_percent", F.round("row_percent", 6))


@query("SEG6", """WITH s AS (SELECT CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 35 THEN 'middle' ELSE 'large' END AS seg, count(*) AS n FROM part GROUP BY 1)
  SELECT seg, n, round(n / sum(n) OVER (), 6) AS share FROM s""")
def size_band_shares(t):
    seg = segments.up_to("p_size", {"small": 15, "middle": 35}, "large", "none")
    out = with_share(t.part.groupBy(seg.alias("seg")).agg(F.count("*").alias("n")), "n", "share", small=True)
    return out.withColumn("share", F.round("share", 6))
