"""Scalar functions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions import arrays, dates, numbers, text
from metricloom.operators.aggregates import share_where
from metricloom.operators.cleaning import narrowest_types
from metricloom.operators.experiments import users_in_several, without_users
from metricloom.plans.registry import query

# ---- text


@query("STR1", """SELECT doc_id, md5(regexp_replace(trim(lower(text), ' '), ' +', ' ', 'g')) AS digest FROM documents""")
def text_normalised(t):
    return t.documents.select("doc_id", F.md5(text.clean_address("text")).alias("digest"))


@query("STR1 STR2", """SELECT c_custkey, regexp_replace(trim(upper(n[1:1]) || lower(n[2:]), ' '), ' +', ' ', 'g') AS label
  FROM (SELECT c_custkey, '  ' || c_mktsegment || '   ' || c_name || ' ' AS n FROM customer)""")
def name_display_form(t):
    raw = F.concat(F.lit("  "), "c_mktsegment", F.lit("   "), "c_name", F.lit(" "))
    return t.customer.select("c_custkey", text.clean_name(raw).alias("label"))


@query("STR2", "SELECT p_partkey, upper(p_name[1:1]) || lower(p_name[2:]) AS label FROM part")
def text_capitalised(t):
    return t.part.select("p_partkey", text.capitalise("p_name").alias("label"))


@query("STR3", """SELECT o_orderkey, replace(o_orderpriority, '-', '') AS priority, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status FROM orders""")
def literal_replacement(t):
    status = F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", F.replace("o_orderpriority", F.lit("-"), F.lit("")).alias("priority"), status.alias("status"))


@query("STR4", "SELECT contains(text, 'the') AS literal, regexp_matches(text, '[0-9]{3}') AS pattern, count(*) AS n FROM documents GROUP BY 1, 2")
def contains_and_pattern(t):
    return (t.documents.groupBy(F.col("text").contains("the").alias("literal"), F.col("text").rlike("[0-9]{3}").alias("pattern"))
            .agg(F.count("*").alias("n")))


@query("STR5", "SELECT url_part, count(*) AS n FROM (SELECT unnest(string_split(url, '/')) AS url_part FROM pages) GROUP BY 1")
def split_on_separator(t):
    return t.pages.select(F.explode(F.split("url", "/")).alias("url_part")).groupBy("url_part").agg(F.count("*").alias("n"))


@query("STR6", "SELECT year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)::VARCHAR AS quarter, count(*) AS n FROM orders GROUP BY 1")
def quarter_labels(t):
    return t.orders.groupBy(dates.quarter_label("o_orderdate").alias("quarter")).agg(F.count("*").alias("n"))


@query("STR7", """SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS label, count(*) AS n FROM orders GROUP BY 1""")
def mapped_labels(t):
    label = text.label_of("o_orderstatus", {"F": "finished", "O": "open"}, default="other")
    return t.orders.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


# ---- numbers

HALVES = "SELECT event_id, floor(value) / 2 AS x FROM events"


@query("NUM1", f"SELECT event_id, round(x) AS half_up, round(-x) AS negative FROM ({HALVES})")
def rounding_half_up(t):
    x = F.floor("value") / 2
    return t.events.select("event_id", numbers.round_half_up(x, 0).alias("half_up"), numbers.round_half_up(-x, 0).alias("negative"))


@query("NUM2", f"SELECT event_id, round_even(x, 0) AS half_even, round_even(-x, 0) AS negative FROM ({HALVES})")
def rounding_half_even(t):
    x = F.floor("value") / 2
    return t.events.select("event_id", numbers.round_half_even(x, 0).alias("half_even"), numbers.round_half_even(-x, 0).alias("negative"))


@query("NUM3", "SELECT l_suppkey, ceil(sum(l_extendedprice) / 60)::BIGINT AS minutes FROM lineitem GROUP BY 1")
def ceiling(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.ceil(F.sum("l_extendedprice") / 60).alias("minutes"))


@query("NUM4", "SELECT event_id, trunc(value)::BIGINT AS whole, trunc(-value)::BIGINT AS negative FROM events")
def truncation(t):
    return t.events.select("event_id", numbers.whole("value").alias("whole"), numbers.whole(-F.col("value")).alias("negative"))


@query("NUM5", """SELECT doc_id, TRY_CAST(trim(replace(s, ',', ''), ' ') AS DOUBLE) AS parsed FROM
  (SELECT doc_id, CASE lang WHEN 'en' THEN ' 1,' || n_chars ELSE lang END AS s FROM documents)""")
def parse_or_null(t):
    s = F.when(F.col("lang") == "en", F.concat(F.lit(" 1,"), F.col("n_chars").cast("string"))).otherwise(F.col("lang"))
    return t.documents.select("doc_id", numbers.parse_number(s).alias("parsed"))


@query("NUM6", "SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 8) AS per_discount FROM lineitem")
def infinite_to_null(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(numbers.ratio("l_tax", "l_discount"), 8).alias("per_discount"))


@query("NUM7", """SELECT c AS "column", lo AS min_value, hi AS max_value, CASE WHEN lo >= -128 AND hi < 128 THEN 'tinyint'
  WHEN lo >= -32768 AND hi < 32768 THEN 'smallint' WHEN hi < 2147483648 THEN 'int' ELSE 'bigint' END AS fits_type FROM (
  SELECT 'l_linenumber' AS c, min(l_linenumber)::BIGINT AS lo, max(l_linenumber)::BIGINT AS hi FROM lineitem UNION ALL
  SELECT 'l_partkey', min(l_partkey), max(l_partkey) FROM lineitem UNION ALL SELECT 'l_orderkey', min(l_orderkey), max(l_orderkey) FROM lineitem)""")
def narrowest_integer_types(t):
    return narrowest_types(t.lineitem, ["l_linenumber", "l_partkey", "l_orderkey"])


@query("NUM8", """SELECT round(100.0 * abs(a - b) / a, 6) AS difference FROM (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS a,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders)""")
def percent_gap(t):
    counts = t.orders.agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    return counts.select(F.round(numbers.percent_difference(F.col("a"), F.col("b")), 6).alias("difference"))


# ---- dates

D = "o_orderdate"


@query("DAT1 DAT2", """SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month_start, date_trunc('week', o_orderdate)::DATE AS week_start,
  year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, quarter(o_orderdate)::INT AS q FROM orders""")
def date_parts(t):
    return t.orders.select("o_orderkey", dates.month_start(D).alias("month_start"), dates.week_start(D).alias("week_start"),
                           F.year(D).alias("y"), F.month(D).alias("m"), F.quarter(D).alias("q"))


@query("DAT2", "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1")
def monthly_period_label(t):
    return t.orders.groupBy(F.date_format(D, "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))


@query("DAT3", "SELECT list_extract(['янв','фев','мар','апр','май','июн','июл','авг','сен','окт','ноя','дек'], month(o_orderdate)::INT) AS month, count(*) AS n FROM orders GROUP BY 1")
def localised_month_names(t):
    return t.orders.groupBy(dates.month_label(D).alias("month")).agg(F.count("*").alias("n"))


@query("DAT4", "SELECT dayname(o_orderdate) AS weekday, isodow(o_orderdate) > 5 AS weekend, count(*) AS n FROM orders GROUP BY 1, 2")
def weekdays_and_weekends(t):
    return t.orders.groupBy(dates.weekday_label(D).alias("weekday"), dates.is_weekend(D).alias("weekend")).agg(F.count("*").alias("n"))


@query("DAT5", "SELECT l_orderkey, l_linenumber, (l_shipdate::DATE - o_orderdate::DATE)::INT AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def days_between_dates(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", dates.days_between("l_shipdate", D).alias("days"))


@query("DAT6", "SELECT event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 86400e6)::BIGINT AS days FROM events")
def elapsed_whole_days(t):
    return t.events.select("event_id", dates.elapsed_days("ts", F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).alias("days"))


@query("DAT7", "SELECT p_partkey, (DATE '2020-01-31' + p_size) AS due FROM part")
def date_plus_days(t):
    return t.part.select("p_partkey", F.date_add(F.lit("2020-01-31").cast("date"), F.col("p_size")).alias("due"))


@query("DAT8", """SELECT o_custkey, (min(o_orderdate)::DATE + floor((max(o_orderdate)::DATE - min(o_orderdate)::DATE) / 2)::INT) AS middle FROM orders GROUP BY 1""")
def middle_of_two_dates(t):
    spans = t.orders.groupBy("o_custkey").agg(F.min(D).alias("a"), F.max(D).alias("b"))
    return spans.select("o_custkey", dates.midpoint("a", "b").alias("middle"))


@query("DAT9", """SELECT parsed, count(*) AS n FROM (SELECT try_strptime(CASE o_orderstatus WHEN 'P' THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END, '%Y-%m-%d')::DATE AS parsed
  FROM orders) GROUP BY 1""")
def parse_dates_or_null(t):
    raw = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format(D, "yyyy-MM-dd"))
    return t.orders.groupBy(dates.parse_date(raw).alias("parsed")).agg(F.count("*").alias("n"))


@query("DAT10 MET38", """SELECT season, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'зима'
  WHEN month(o_orderdate) IN (3, 4, 5) THEN 'весна' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'лето' ELSE 'осень' END AS season, count(*) AS n FROM orders GROUP BY 1)""")
def orders_per_season(t):
    from metricloom.operators.attach import with_share
    counts = t.orders.groupBy(dates.season(D).alias("season")).agg(F.count("*").alias("n"))
    return with_share(counts, "n", "share", small=True).withColumn("share", F.round("share", 6))


@query("DAT11", "SELECT within, count(*) AS n FROM (SELECT (max(o_orderdate)::DATE - min(o_orderdate)::DATE) <= 365 AS within FROM orders GROUP BY o_custkey) GROUP BY 1")
def span_within_a_year(t):
    spans = t.orders.groupBy("o_custkey").agg(F.min(D).alias("a"), F.max(D).alias("b"))
    return spans.groupBy(dates.within_days("b", "a", 365).alias("within")).agg(F.count("*").alias("n"))


# ---- arrays and maps

TYPES = "economy,large,medium,promo,small,standard"
TIERS = "low,high,mid,low,low,mid"


@query("ARR1", f"""SELECT p_partkey, map_extract_value(map(string_split('{TYPES}', ','), string_split('{TIERS}', ',')), lower(p_type)) AS tier FROM part""")
def lists_as_lookup_map(t):
    lookup = arrays.lists_to_map(F.lit(TYPES), F.lit(TIERS))
    return t.part.select("p_partkey", F.try_element_at(lookup, F.lower("p_type")).alias("tier"))


@query("ARR2", """SELECT p_brand, string_agg(k || '=' || n, ',' ORDER BY k) AS pairs FROM (SELECT p_brand,
  CASE p_type WHEN 'PROMO' THEN 'PROMOTION' ELSE p_type END AS k, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1""")
def renamed_map_key(t):
    counts = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("m"))   # six types at most
    entries = F.array_sort(F.map_entries(arrays.rename_key("m", "PROMO", "PROMOTION")))
    text_ = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return maps.select("p_brand", text_.alias("pairs"))


@query("ARR3", """SELECT p_brand, coalesce(string_agg(p_type, ',' ORDER BY p_type) FILTER (WHERE top = 50), '') AS types FROM
  (SELECT p_brand, p_type, max(p_size) AS top FROM part GROUP BY 1, 2) GROUP BY 1""")
def map_keys_with_value(t):
    sizes = t.part.groupBy("p_brand", "p_type").agg(F.max("p_size").alias("top"))
    maps = sizes.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "top"))).alias("m"))
    return maps.select("p_brand", F.array_join(arrays.keys_with_value("m", 50), ",").alias("types"))


@query("ARR4", """SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.1))::INT AS n_above, round(len(list_filter(embedding, lambda x: x > 0.1)) / len(embedding), 6) AS share
  FROM embeddings""")
def elements_above_threshold(t):
    return t.embeddings.select("vec_id", arrays.count_above("embedding", F.lit(0.1).cast("float")).alias("n_above"),
                               F.round(arrays.share_above("embedding", F.lit(0.1).cast("float")), 6).alias("share"))


@query("ARR4 MET51", """SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 250000) AS n_above, round(avg((o_totalprice > 250000)::INT), 6) AS share FROM orders GROUP BY 1""")
def rows_above_threshold(t):
    big = F.col("o_totalprice") > 250000
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(big).alias("n_above"), F.round(share_where(big), 6).alias("share"))


# ---- sets


def _pairs(t, flag):
    return t.lineitem.filter(F.col("l_returnflag") == flag).select("l_suppkey", F.trunc("l_shipdate", "month").alias("m"))


@query("SET1", " UNION ".join(f"SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS m FROM lineitem WHERE l_returnflag = '{f}'" for f in "RAN"))
def union_of_key_pairs(t):
    return _pairs(t, "R").union(_pairs(t, "A")).union(_pairs(t, "N")).distinct()


@query("SET2", """SELECT key, count(*) AS n FROM (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1""")
def union_keeping_duplicates(t):
    both = t.customer.select(F.col("c_nationkey").alias("key")).unionByName(t.supplier.select(F.col("s_nationkey").alias("key")))
    return both.groupBy("key").agg(F.count("*").alias("n"))


@query("SET3 EXP2", """SELECT user_id, n_groups FROM (SELECT user_id, count(DISTINCT event_type) AS n_groups FROM events
  WHERE event_type IN ('purchase', 'signup') GROUP BY 1) WHERE n_groups > 1""")
def users_of_both_groups(t):
    return users_in_several(t.events.filter(F.col("event_type").isin("purchase", "signup")), "user_id", "event_type")


@query("SET3", "SELECT o_custkey AS user_id FROM orders INTERSECT SELECT user_id FROM events")
def intersection_of_users(t):
    return t.orders.select(F.col("o_custkey").alias("user_id")).intersect(t.events.select("user_id"))


@query("SET4", "SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events")
def difference_of_users(t):
    return without_users(t.customer.select("c_custkey"), t.events.select(F.col("user_id").alias("c_custkey")), "c_custkey").distinct()


@query("SET5", "SELECT count(*) AS n_users FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM events)")
def distinct_over_two_lists(t):
    both = t.orders.select(F.col("o_custkey").alias("u")).union(t.events.select("user_id"))
    return both.distinct().agg(F.count("*").alias("n_users"))
