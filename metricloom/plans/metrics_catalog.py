"""Listening statistics, property listings, places to eat.

A listing is a sale line with its part: days on the market come from the quantity, the area is
the part size. A listening event is an app event: genre is the event type, seconds the value.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metricloom.functions.dates import MONTH_LABELS, day, weekday_label
from metricloom.functions.numbers import ratio
from metricloom.functions.text import contains_any, label_of
from metricloom.operators.aggregates import QUARTILES, value_counts
from metricloom.operators.attach import null_safe_join, with_scalars, with_share
from metricloom.operators.ordering import order_by, top_k
from metricloom.operators.outliers import percentile_limits, within_limits
from metricloom.operators.quantiles import quantile_table, quantiles
from metricloom.operators.reshape import crosstab
from metricloom.operators.segments import up_to
from metricloom.plans.bindings import visits, VISITS
from metricloom.plans.registry import query


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- listening


@query("MET29 SRT3", "SELECT event_type, count(event_type) AS plays FROM events GROUP BY 1 ORDER BY plays DESC, event_type LIMIT 5")
def most_played_genres(t):
    return top_k(t.events.groupBy("event_type").agg(F.count("event_type").alias("plays")), 5, "-plays", "event_type")


@query("MET29 PRJ2", "SELECT event_id, user_id, value / 60 AS minutes FROM events")
def plays_in_minutes(t):
    return t.events.select("event_id", "user_id", (F.col("value") / 60).alias("minutes"))


@query("MET29 FLT14", "SELECT event_type, round(sum(value) / 60, 2) AS minutes FROM events GROUP BY 1 HAVING round(sum(value) / 60, 2) > 1600")
def genres_over_1600_minutes(t):
    out = t.events.groupBy("event_type").agg(F.round(F.sum("value") / 60, 2).alias("minutes"))
    return order_by(out.filter(F.col("minutes") > 1600), "-minutes")


@query("MET29", "SELECT event_type, count(value) AS plays, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS average FROM events GROUP BY 1")
def duration_statistics_by_genre(t):
    v = "value"
    out = t.events.groupBy("event_type").agg(F.count(v).alias("plays"), F.round(F.sum(v), 2).alias("total"), F.min(v).alias("low"),
                                             F.max(v).alias("high"), F.round(F.avg(v), 6).alias("average"))
    return order_by(out, "-average")


@query("MET29 NUM3", "SELECT count(event_type) AS plays, ceil(avg(value) * 7 / 60)::BIGINT AS minutes FROM events WHERE value / 100 < 0.5")
def plays_left_early(t):
    early = t.events.filter(F.col("value") / 100 < 0.5)
    return early.agg(F.count("event_type").alias("plays"), F.ceil(F.avg("value") * 7 / 60).alias("minutes"))


@query("MET29 FLT2", "SELECT dayname(ts) AS weekday, event_id, user_id, value FROM events WHERE dayname(ts) IN ('Monday', 'Wednesday')")
def plays_on_two_weekdays(t):
    return (t.events.withColumn("weekday", weekday_label("ts")).filter(F.col("weekday").isin("Monday", "Wednesday"))
            .select("weekday", "event_id", "user_id", "value"))


@query("MET29", f"SELECT event_type, r_name, count(event_id) AS plays, round(sum(value), 2) AS total FROM ({VISITS}) GROUP BY 1, 2")
def genres_by_city(t):
    out = visits(t).groupBy("event_type", "r_name").agg(F.count("event_id").alias("plays"), F.round(F.sum("value"), 2).alias("total"))
    return order_by(out, "event_type", "r_name")


@query("MET29 SRT1", f"""SELECT r_name, event_type, event_id, value FROM ({VISITS}) WHERE event_type IN ('click', 'view') AND r_name IN ('ASIA', 'EUROPE') ORDER BY r_name, event_type, value DESC, event_id LIMIT 20""")
def longest_plays_in_two_cities(t):
    v = visits(t).filter(F.col("event_type").isin("click", "view") & F.col("r_name").isin("ASIA", "EUROPE"))
    return top_k(v.select("r_name", "event_type", "event_id", "value"), 20, "r_name", "event_type", "-value", "event_id")


@query("MET29 FLT3", "SELECT p_type, p_brand FROM part WHERE NOT p_brand = 'Brand#4' GROUP BY 1, 2 HAVING count(p_name) > 1")
def artists_with_several_tracks(t):
    known = t.part.filter(~(F.col("p_brand") == "Brand#4"))
    counts = known.groupBy("p_type", "p_brand").agg(F.count("p_name").alias("k")).filter(F.col("k") > 1)
    return order_by(counts.drop("k"), "p_type", "p_brand")


# ---- listings


def listings(t):
    rows = (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")))
    return rows.select(
        "l_returnflag", "l_linestatus", "p_type", "n_name", day("l_shipdate").alias("first_day"), F.col("l_extendedprice").alias("price"),
        F.col("p_size").alias("area"), F.col("l_linenumber").alias("rooms"), F.nullif(F.round(F.col("l_discount") * 100), F.lit(0.0)).alias("balcony"),
        (F.col("l_tax") + 2.5).alias("height"), (F.nullif(F.col("l_quantity"), F.lit(50.0)) * 5).cast("int").alias("days"))


LISTINGS = """SELECT l_returnflag, l_linestatus, p_type, n_name, l_shipdate::DATE AS first_day, l_extendedprice AS price, p_size AS area, l_linenumber AS rooms,
  nullif(round(l_discount * 100), 0) AS balcony, l_tax + 2.5 AS height, (nullif(l_quantity, 50) * 5)::INT AS days
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
LIMITED = f"""WITH li AS ({LISTINGS}), m AS (SELECT quantile_disc(area, 0.99) AS a, quantile_disc(rooms, 0.99) AS r, quantile_disc(balcony, 0.99) AS b, quantile_disc(height, 0.99) AS hh,
  quantile_disc(height, 0.01) AS hl FROM li), k AS (SELECT li.*, price / area AS metre FROM li, m WHERE area < a AND (rooms < r OR rooms IS NULL) AND (balcony < b OR balcony IS NULL)
  AND ((height < hh AND height > hl) OR height IS NULL))"""
PERIOD = "BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"


def typical_listings(t):
    li = listings(t)
    columns = ["area", "rooms", "balcony", "height"]
    # sizes, room and balcony numbers and heights come from short lists of values
    limits = percentile_limits(li, columns, method="counts")
    kept = within_limits(li, limits, below_high=columns, above_low=["height"], null_passes=columns[1:])
    return kept.withColumn("metre", ratio("price", "area"))


def in_period(col):
    return F.col(col).between(F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"))


BAND = """CASE WHEN days IS NULL THEN 'no category' WHEN days <= 30 THEN 'about a month' WHEN days <= 90 THEN 'up to 3 months' WHEN days <= 180 THEN 'up to half a year' ELSE 'over half a year' END"""


@query("MET26 OUT1 SEG5", LIMITED + f""" SELECT *, round(total_ads / sum(total_ads) OVER (PARTITION BY region), 6) AS ratio_ads FROM (SELECT CASE n_name WHEN 'NATION_1' THEN n_name ELSE 'elsewhere' END AS region, {BAND} AS band, count(*) AS total_ads,
  round(avg(metre), 6) AS avg_metre, round(avg(area), 6) AS avg_area, quantile_disc(rooms, 0.5)::DOUBLE AS median_rooms, quantile_disc(balcony, 0.5) AS median_balcony, quantile_disc(height, 0.5) AS median_height, round(avg(height), 6) AS avg_height,
  round(avg((rooms = 1)::INT), 6) AS ratio_studio, round(avg((l_linestatus = 'O')::INT), 6) AS ratio_open, round(avg((l_returnflag = 'R')::INT), 6) AS ratio_flag FROM k WHERE p_type = 'ECONOMY' AND first_day {PERIOD} GROUP BY 1, 2)""")
def listing_segments(t):
    band = up_to("days", {"about a month": 30, "up to 3 months": 90, "up to half a year": 180}, "over half a year", "no category")
    li = (typical_listings(t).filter((F.col("p_type") == "ECONOMY") & in_period("first_day"))
          .withColumn("region", F.when(F.col("n_name") == "NATION_1", F.col("n_name")).otherwise("elsewhere")).withColumn("band", band))
    keys = ["region", "band"]
    part = lambda c: F.round(ratio(F.count_if(c), F.count("*")), 6)
    out = li.groupBy(*keys).agg(F.count("*").alias("total_ads"), F.round(F.avg("metre"), 6).alias("avg_metre"), F.round(F.avg("area"), 6).alias("avg_area"),
                                F.round(F.avg("height"), 6).alias("avg_height"), part(F.col("rooms") == 1).alias("ratio_studio"),
                                part(F.col("l_linestatus") == "O").alias("ratio_open"), part(F.col("l_returnflag") == "R").alias("ratio_flag"),
                                # short value lists again, so the built-in median stays small and shares this pass
                                *[F.expr(f"percentile_disc(0.5) within group (order by cast({c} as double))").alias(f"median_{c}")
                                  for c in ("rooms", "balcony", "height")])
    shares = with_share(out, "total_ads", "ratio_ads", by=["region"], small=True)
    return rounded(shares, "ratio_ads")


def _side(name, date):
    return f"""SELECT month({date}) AS m, count(*) AS {name}_flats, round(avg(metre), 6) AS {name}_metre, round(avg(area), 6) AS {name}_area FROM k WHERE {date} {PERIOD} GROUP BY 1"""


@query("MET27 WIN7 DAT7 JN15", LIMITED + f""" SELECT list_extract({list(MONTH_LABELS.values())}, m::INT) AS month, ad_flats, round(ad_flats / sum(ad_flats) OVER () * 100, 6) AS ad_percent, ad_metre, ad_area, dense_rank() OVER (ORDER BY ad_flats DESC)::INT AS ad_rank,
  sale_flats, round(sale_flats / sum(sale_flats) OVER () * 100, 6) AS sale_percent, sale_metre, sale_area, dense_rank() OVER (ORDER BY sale_flats DESC)::INT AS sale_rank
  FROM ({_side('ad', 'first_day')}) JOIN ({_side('sale', '(first_day + days)')}) USING (m)""")
def listing_seasonality(t):
    # both dates of a listing in one pass: (published, month) and (removed, month)
    dates = F.array(F.struct(F.lit("ad").alias("kind"), F.col("first_day").alias("d")),
                    F.struct(F.lit("sale").alias("kind"), F.date_add("first_day", F.col("days")).alias("d")))
    moments = typical_listings(t).select("metre", "area", F.inline(dates)).filter(in_period("d"))
    months = moments.groupBy(F.month("d").alias("m"), "kind").agg(
        F.count("*").alias("flats"), F.round(F.avg("metre"), 6).alias("metre"), F.round(F.avg("area"), 6).alias("area"))
    # at most 24 rows from here on
    months = rounded(with_share(months, "flats", "percent", by=["kind"], scale=100.0, small=True), "percent")
    rank = F.dense_rank().over(Window.partitionBy("kind").orderBy(F.desc("flats")))
    columns = ["flats", "metre", "area", "percent", "rank"]
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}")
    both = (months.withColumn("rank", rank).groupBy("m")
            .agg(F.count("*").alias("kinds"), *[pick(k, c) for k in ("ad", "sale") for c in columns]).filter("kinds = 2"))
    return both.orderBy("m").withColumn("month", label_of("m", MONTH_LABELS)).drop("m", "kinds")


@query("MET28", "SELECT p_type, count(p_partkey) AS listings, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def listing_types(t):
    return order_by(t.part.groupBy("p_type").agg(F.count("p_partkey").alias("listings"), F.count_distinct("p_brand").alias("brands")), "-listings")


@query("MET28", f"""SELECT min(days) AS low, max(days) AS high, round(avg(days), 6) AS mean, quantile_disc(days, 0.5) AS median, round(100.0 * count(days) / count(*), 6) AS sold_percent,
  round(100.0 * count(CASE WHEN n_name = 'NATION_1' THEN 1 END) / count(*), 6) AS city_percent FROM ({LISTINGS})""")
def days_on_market(t):
    li = listings(t)
    stats = li.agg(F.min("days").alias("low"), F.max("days").alias("high"), F.round(F.avg("days"), 6).alias("mean"),
                   F.round(ratio(F.count("days") * 100, F.count("*")), 6).alias("sold_percent"),
                   F.round(ratio(F.count(F.when(F.col("n_name") == "NATION_1", 1)) * 100, F.count("*")), 6).alias("city_percent"))
    return with_scalars(stats, quantiles(li, "days", {"median": 0.5}, kind="discrete"))


@query("MET28", f"""SELECT round(min(metre), 6) AS low, round(max(metre), 6) AS high, round(avg(metre), 4) AS mean, round(quantile_disc(metre, 0.5), 6) AS median FROM (SELECT price / area AS metre FROM ({LISTINGS}))""")
def price_per_metre(t):
    m = listings(t).select(ratio("price", "area").alias("metre"))
    stats = m.agg(F.round(F.min("metre"), 6).alias("low"), F.round(F.max("metre"), 6).alias("high"), F.round(F.avg("metre"), 4).alias("mean"))
    return rounded(with_scalars(stats, quantiles(m, "metre", {"median": 0.5}, kind="discrete")), "median")


ATTRIBUTES = ["area", "rooms", "balcony", "height", "days", "price"]


@query("MET28 AGG9", " UNION ALL ".join(f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 6) AS mean, quantile_disc({c}, 0.5)::DOUBLE AS median,
  quantile_disc({c}, 0.99)::DOUBLE AS p99 FROM ({LISTINGS})""" for c in ATTRIBUTES))
def attribute_statistics(t):
    li = listings(t)
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in ATTRIBUTES]
    stats = li.select(F.inline(F.array(*parts))).groupBy("column").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.avg("x"), 6).alias("mean"))
    return stats.join(quantile_table(li, ATTRIBUTES, {"median": 0.5, "p99": 0.99}, kind="discrete"), "column")


# ---- places: a part is a venue, its type the category, the brand the district


def places(t):
    return t.part.select(
        "p_partkey", "p_name", F.col("p_type").alias("category"), F.col("p_brand").alias("district"), (F.col("p_size") / 10).alias("rating"),
        F.when(F.col("p_size") > 25, 1).otherwise(0).alias("chain"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 3).alias("seats"),
        F.when(F.col("p_retailprice") < 940, "low").when(F.col("p_retailprice") < 970, "mid").alias("price"),
        F.when(F.col("p_size") != 13, F.col("p_retailprice")).alias("bill"))


PLACES = """SELECT p_partkey, p_name, p_type AS category, p_brand AS district, p_size / 10 AS rating, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS chain,
  CASE WHEN p_size % 7 <> 0 THEN p_size * 3 END AS seats, CASE WHEN p_retailprice < 940 THEN 'low' WHEN p_retailprice < 970 THEN 'mid' END AS price,
  CASE WHEN p_size <> 13 THEN p_retailprice END AS bill FROM part"""


def _counted(k, where="TRUE"):
    return f"SELECT {k}, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({PLACES}) WHERE {where} GROUP BY 1"


def counted(df, key):
    return rounded(order_by(value_counts(df, key, normalize=True), "-n_rows", key), "share")


@query("MET49 AGG15", _counted("category"))
def places_by_category(t):
    return counted(places(t), "category")


@query("MET49 AGG15", _counted("district"))
def places_by_district(t):
    return counted(places(t), "district")


@query("MET49", _counted("category", "district = 'Brand#1'"))
def categories_of_one_district(t):
    return counted(places(t).filter(F.col("district") == "Brand#1"), "category")


@query("MET49 STR7", f"""SELECT CASE chain WHEN 0 THEN 'single' ELSE 'chain' END AS kind, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({PLACES}) GROUP BY 1""")
def chains_and_singles(t):
    return counted(places(t).withColumn("kind", F.when(F.col("chain") == 0, "single").otherwise("chain")), "kind")


@query("MET49 SHP2", f"""SELECT category, count(*) FILTER (WHERE chain = 0) AS "0", count(*) FILTER (WHERE chain = 1) AS "1" FROM ({PLACES}) GROUP BY 1""")
def chains_by_category(t):
    return crosstab(places(t), "category", "chain", [0, 1])


@query("MET49 AGG10", f"SELECT category, round(median(seats), 6) AS median_seats FROM ({PLACES}) GROUP BY 1")
def median_seats_by_category(t):
    return rounded(quantiles(places(t), "seats", {"median_seats": 0.5}, ["category"]), "median_seats")


@query("MET49", f"SELECT category, round(avg(rating), 6) AS mean_rating FROM ({PLACES}) GROUP BY 1")
def mean_rating_by_category(t):
    return order_by(places(t).groupBy("category").agg(F.round(F.avg("rating"), 6).alias("mean_rating")), "-mean_rating")


@query("MET49 NUM2", f"SELECT price, round_even(avg(rating), 2) AS mean_rating FROM ({PLACES}) WHERE price IS NOT NULL GROUP BY 1")
def mean_rating_by_price(t):
    known = places(t).filter(F.col("price").isNotNull())
    return order_by(known.groupBy("price").agg(F.bround(F.avg("rating"), 2).alias("mean_rating")), "-mean_rating")


TOP = "SELECT p_name, category, count(p_name) AS venues, round(avg(rating), 6) AS mean_rating FROM ({p}) WHERE chain = 1{w} GROUP BY 1, 2 ORDER BY venues DESC, p_name, category LIMIT 15"


def top_chains(df):
    out = df.filter(F.col("chain") == 1).groupBy("p_name", "category").agg(F.count("p_name").alias("venues"), F.round(F.avg("rating"), 6).alias("mean_rating"))
    return top_k(out, 15, "-venues", "p_name", "category")


@query("MET49 SRT3", TOP.format(p=PLACES, w=""))
def largest_chains(t):
    return top_chains(places(t))


@query("MET49 SRT3 FLT1", TOP.format(p=PLACES, w=" AND p_name <> 'red widget'"))
def largest_chains_without_one_name(t):
    return top_chains(places(t).filter(F.col("p_name") != "red widget"))


@query("MET49 AGG12", f"SELECT district, count(p_partkey) AS venues, min(bill) AS low, max(bill) AS high, round(median(bill), 6) AS median FROM ({PLACES}) GROUP BY 1")
def bill_by_district(t):
    p = places(t)
    stats = p.groupBy("district").agg(F.count("p_partkey").alias("venues"), F.min("bill").alias("low"), F.max("bill").alias("high"))
    return rounded(null_safe_join(stats, quantiles(p, "bill", {"median": QUARTILES["q50"]}, ["district"]), ["district"], "left"), "median")


# Spellings of round-the-clock opening hours.
ALL_DAY = ["ежедневно, круглосуточно", "круглосуточно", "24/7"]


@query("MET49 FLT12", """SELECT is_24_7, count(*) AS n FROM (SELECT CASE WHEN h IS NULL THEN 0 WHEN contains(h, '24/7') OR contains(h, 'круглосуточно') THEN 1 ELSE 0 END AS is_24_7
  FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'пн-пт 24/7' WHEN o_orderstatus = 'O' THEN 'ежедневно, круглосуточно ' || o_orderpriority WHEN o_orderpriority = '5-LOW' THEN '10-22' END AS h FROM orders)) GROUP BY 1""")
def open_all_day(t):
    hours = (F.when(F.col("o_orderstatus") == "F", "пн-пт 24/7")
             .when(F.col("o_orderstatus") == "O", F.concat(F.lit("ежедневно, круглосуточно "), "o_orderpriority"))
             .when(F.col("o_orderpriority") == "5-LOW", "10-22"))
    return t.orders.groupBy(contains_any(hours, ALL_DAY).alias("is_24_7")).agg(F.count("*").alias("n"))
