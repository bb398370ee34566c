"""Registered queries: analytic questions (Q1-Q11) and dashboard datasets
(Q12-Q22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.functions import scalar as S
from lodgelens.operators import relational as R
from lodgelens.plans import features as FE
from lodgelens.plans import oracle_views as V
from lodgelens.plans import questions as Qs
from lodgelens.plans import reports as Rp
from lodgelens.plans.listing_tables import listing_base
from lodgelens.plans.registry import query
from lodgelens.plans.suite_features import listing_level, panel, season
from lodgelens.sources import catalog


def _first_max_sql(cols, prefix):
    g = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {c} = {g} THEN '{c[len(prefix):]}'" for c in cols) + " END"


_DECODE = (f"{_first_max_sql(FE.BORO_COLS, 'boro_')} AS borough, {_first_max_sql(FE.PROP_COLS, 'prop_')} AS property_type, "
           "coalesce(CASE room_type_ord " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.ROOM_CODE_DECODE.items())
           + " END, 'Unknown') AS room_type")
V.register("qbase", f"SELECT *, {_DECODE} FROM listing_level")
V.register("qpanel", f"SELECT *, {_DECODE} FROM panel")
V.register("dash_preds", """
SELECT l.id, p.month, l.latitude, l.longitude, l.neighbourhood, l.borough, l.room_type, l.price_numeric,
       p.price_numeric * s.seasonal_index AS pred_price
FROM listing_base l JOIN fx_monthly_prices p ON l.id = p.id JOIN season_idx s ON p.month = s.month
WHERE l.price_numeric <= 2000 AND p.price_numeric * s.seasonal_index <= 2000
""")


def qbase(spark, sf):
    return Qs.decode_panel(listing_level(spark, sf))


def dash_preds(spark, sf):
    """Dashboard predictions: listed (static) price and a month's estimate
    (monthly price x season index), both capped at 2,000."""
    lb = listing_base(spark, sf).select("id", "latitude", "longitude", "neighbourhood", "borough", "room_type",
                                        "price_numeric")
    p = catalog.fx_monthly_prices(spark, sf).withColumnRenamed("price_numeric", "month_price")
    s = season(spark, sf).select("month", "seasonal_index")
    d = lb.join(p, "id").join(F.broadcast(s), "month").withColumn(
        "pred_price", F.col("month_price") * F.col("seasonal_index"))
    return d.filter((F.col("price_numeric") <= 2000) & (F.col("pred_price") <= 2000)).drop("month_price",
                                                                                          "seasonal_index")


_SUMMARY = """count(*) AS count, round(quantile_cont(price_numeric, 0.5), 2) AS price_median,
       round(avg(price_numeric), 2) AS price_mean, round(avg(review_scores_rating), 2) AS rating_mean,
       round(quantile_cont(estimated_revenue, 0.5), 2) AS revenue_median"""


@query("query_listings", f"""
SELECT {_SUMMARY} FROM qbase
WHERE borough = 'ASIA' AND bedrooms >= 1 AND is_superhost = 1 AND has_wifi = 1
""")
def query_listings(spark, sf):
    """Q1."""
    return Qs.query_listings(qbase(spark, sf), borough="ASIA", min_bedrooms=1, is_superhost=True,
                             required_amenities=["wifi", "not_an_amenity"])


_IDS = [2, 4, 5, 8, 10, 11, 14, 20, 22, 23, 26, 29, 31, 35]
_AM = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {c} = 1 THEN '{c[4:]}' END" for c in S.KEY_AMENITIES) + "], lambda x: x IS NOT NULL), ', ')"


@query("listing_details", f"""
SELECT id, borough, property_type, room_type, accommodates, bedrooms, beds, bathrooms,
       round(price_numeric, 2) AS price_avg, minimum_nights, availability_365, is_superhost = 1 AS is_superhost,
       is_instant_bookable = 1 AS is_instant_bookable, round(host_response_rate_f, 2) AS host_response_rate,
       number_of_reviews, round(review_scores_rating, 2) AS review_scores_rating,
       round(review_scores_cleanliness, 2) AS review_scores_cleanliness,
       round(review_scores_location, 2) AS review_scores_location, {_AM} AS amenities,
       round(dist_subway_km, 3) AS dist_subway_km, subway_lines_500m, crime_count_500m, poi_count_500m,
       round(estimated_occupancy, 1) AS estimated_occupancy, round(estimated_revenue, 2) AS estimated_revenue
FROM qbase WHERE id IN ({", ".join(map(str, _IDS))})
""")
def listing_details(spark, sf):
    """Q2."""
    return Qs.listing_details(qbase(spark, sf), _IDS)


def _side_sql(cond, s):
    return (f"CAST(count_if({cond}) AS BIGINT) AS n_{s}, round(avg(price_numeric) FILTER (WHERE {cond}), 2) AS price_mean_{s}, "
            f"round(avg(review_scores_rating) FILTER (WHERE {cond}), 2) AS rating_mean_{s}, "
            f"round(avg(estimated_occupancy) FILTER (WHERE {cond}), 1) AS occupancy_mean_{s}, "
            f"round(avg(estimated_revenue) FILTER (WHERE {cond}), 2) AS revenue_mean_{s}")


@query("amenity_impact", f"""
WITH w AS (SELECT {_side_sql('has_pool = 1', 'with')}, {_side_sql('has_pool = 0', 'without')} FROM qbase)
SELECT CAST(n_with AS BIGINT) AS n_with, price_mean_with, rating_mean_with, occupancy_mean_with, revenue_mean_with,
       CAST(n_without AS BIGINT) AS n_without, price_mean_without, rating_mean_without, occupancy_mean_without,
       revenue_mean_without,
       round(price_mean_with - price_mean_without, 2) AS delta_price_mean,
       round(rating_mean_with - rating_mean_without, 2) AS delta_rating_mean,
       round(occupancy_mean_with - occupancy_mean_without, 2) AS delta_occupancy_mean,
       round(revenue_mean_with - revenue_mean_without, 2) AS delta_revenue_mean
FROM w
""")
def amenity_impact(spark, sf):
    """Q7."""
    return Qs.amenity_impact(qbase(spark, sf), "pool")


@query("seasonal_trend", """
SELECT month, round(quantile_cont(price_numeric, 0.5), 3) AS value FROM qpanel
WHERE borough = 'EUROPE' GROUP BY month
""")
def seasonal_trend(spark, sf):
    """Q8: median price per month in one borough."""
    return Qs.seasonal_trend(Qs.decode_panel(panel(spark, sf)), "price_numeric", "median", "EUROPE")


_LOC_WHERE = """dist_subway_km <= 3.0 AND subway_lines_500m >= 0 AND crime_count_500m <= 200
  AND poi_count_500m >= 0 AND room_type <> 'Unknown'"""
_LOC_KW = dict(max_subway_km=3.0, min_subway_lines_500m=0, max_crime_500m=200, min_poi_500m=0)


@query("location_search", f"""
SELECT {_SUMMARY} FROM qbase
WHERE dist_subway_km <= 3.0 AND subway_lines_500m >= 0 AND crime_count_500m <= 200 AND poi_count_500m >= 0
""")
def location_search(spark, sf):
    """Q9: proximity filters and summary."""
    return Qs.location_search(qbase(spark, sf), **_LOC_KW)


@query("location_search_top", f"""
SELECT id, borough, property_type, room_type, bedrooms, round(price_numeric, 2) AS price,
       round(review_scores_rating, 2) AS rating, round(estimated_revenue, 2) AS revenue, dist_subway_km,
       subway_lines_500m, crime_count_500m
FROM qbase WHERE dist_subway_km <= 3.0 AND subway_lines_500m >= 0 AND crime_count_500m <= 200 AND poi_count_500m >= 0
ORDER BY estimated_revenue DESC NULLS LAST, id LIMIT 40
""")
def location_search_top(spark, sf):
    """Q9: top matches."""
    return Qs.location_search_top(qbase(spark, sf), 40, **_LOC_KW)


@query("location_impact", """
SELECT 'group_low' AS "group", 'dist_subway_km <= 1.5' AS condition, """ + _side_sql("dist_subway_km <= 1.5", "x")
       .replace("AS n_x", "AS n").replace("_x,", ",").replace("_x", "") + """ FROM qbase
UNION ALL
SELECT 'group_high', 'dist_subway_km > 1.5', """ + _side_sql("dist_subway_km > 1.5", "x")
       .replace("AS n_x", "AS n").replace("_x,", ",").replace("_x", "") + " FROM qbase")
def location_impact(spark, sf):
    """Q10."""
    return Qs.location_impact(qbase(spark, sf), "dist_subway_km", 1.5)


@query("decode_panel", """
SELECT id, month, borough, property_type, room_type FROM qpanel
""")
def decode_panel(spark, sf):
    """Q11."""
    return Qs.decode_panel(panel(spark, sf)).select("id", "month", "borough", "property_type", "room_type")


# -------------------------------------------------------------- dashboard

_SEL = "borough IN ('ASIA', 'EUROPE', 'AMERICA') AND room_type IN ('Private room', 'Entire home/apt')"


def _sel_preds(spark, sf, month=7):
    d = dash_preds(spark, sf)
    return d.filter((F.col("month") == month) & F.col("borough").isin("ASIA", "EUROPE", "AMERICA")
                    & F.col("room_type").isin("Private room", "Entire home/apt"))


@query("kpi_row", f"""
WITH k AS (SELECT count(*) AS n, quantile_cont(price_numeric, 0.5) AS ml, quantile_cont(pred_price, 0.5) AS mp
           FROM dash_preds WHERE month = 7 AND {_SEL})
SELECT n, round(ml, 6) AS median_listed, round(mp, 6) AS median_pred, round(mp - ml, 6) AS delta,
       CASE WHEN mp - ml > 0 THEN 'seasonal premium' ELSE 'seasonal discount' END AS delta_label,
       (SELECT seasonal_index FROM season_idx WHERE month = 7) AS seasonal_index
FROM k
""")
def kpi_row(spark, sf):
    """Q12."""
    return Rp.kpi_row(_sel_preds(spark, sf), season(spark, sf), 7)


@query("histogram", f"""
WITH d AS (SELECT pred_price AS v FROM dash_preds WHERE month = 7 AND {_SEL}),
s AS (SELECT min(v) AS lo, max(v) AS hi, avg(v) AS mean, quantile_cont(v, 0.5) AS median FROM d),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 40)), 39) END AS INTEGER) AS bin,
             lo, hi, mean, median FROM d, s)
SELECT bin, round(lo + bin * ((hi - lo) / 40), 6) AS bin_start, round(lo + (bin + 1) * ((hi - lo) / 40), 6) AS bin_end,
       count(*) AS n, round(mean, 6) AS mean, round(median, 6) AS median
FROM b GROUP BY bin, lo, hi, mean, median
""")
def histogram(spark, sf):
    """Q13: 40 bins of predicted price with mean and median."""
    return Rp.histogram(_sel_preds(spark, sf), "pred_price", 40)


@query("box_stats", """
WITH d AS (SELECT room_type, price_numeric AS v FROM listing_base WHERE room_type IS NOT NULL AND price_numeric IS NOT NULL),
q AS (SELECT room_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM d GROUP BY room_type),
j AS (SELECT d.*, q.q1, q.median, q.q3, d.v >= q.q1 - 1.5 * (q.q3 - q.q1) AND d.v <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM d JOIN q ON d.room_type = q.room_type)
SELECT room_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(v) FILTER (WHERE inside), 6) AS lower_whisker, round(max(v) FILTER (WHERE inside), 6) AS upper_whisker,
       CAST(count_if(NOT inside) AS BIGINT) AS n_outliers, count(*) AS n
FROM j GROUP BY room_type, q1, median, q3
""")
def box_stats(spark, sf):
    """Q14: box statistics of price by room type."""
    return Rp.box_stats(listing_base(spark, sf), "room_type", "price_numeric")


@query("local_trend", """
WITH d AS (SELECT borough, dist_subway_km AS x, price_numeric AS y FROM feature_matrix
           WHERE dist_subway_km IS NOT NULL AND price_numeric IS NOT NULL AND borough IS NOT NULL),
s AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
g AS (SELECT range AS k FROM range(0, 21)),
t AS (SELECT d.borough, g.k, d.x - (s.lo + g.k * (s.hi - s.lo) / 20) AS dx, d.y,
             abs(d.x - (s.lo + g.k * (s.hi - s.lo) / 20)) / ((s.hi - s.lo) * 0.3) AS u, s.lo, s.hi
      FROM d, s, g),
w AS (SELECT *, pow(1 - pow(u, 3), 3) AS w FROM t WHERE u < 1),
a AS (SELECT borough, k, lo, hi, sum(w) AS s0, sum(w * dx) AS s1, sum(w * dx * dx) AS s2, sum(w * y) AS t0,
             sum(w * dx * y) AS t1, count(*) AS n FROM w WHERE w > 0 GROUP BY borough, k, lo, hi)
SELECT borough, CAST(k AS INTEGER) AS k, round(lo + k * (hi - lo) / 20, 6) AS x,
       round(CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1)
                  ELSE t0 / s0 END, 4) AS fit, n
FROM a
""")
def local_trend(spark, sf):
    """Q16: local linear trend of price on subway distance by borough."""
    from lodgelens.plans.suite_features import feature_matrix
    return Rp.local_trend(feature_matrix(spark, sf), "dist_subway_km", "price_numeric", "borough", 20, 0.3)


@query("season_rows", """
SELECT month, strftime(make_date(2000, month, 1), '%b') AS month_name, seasonal_index,
       CAST(month = 7 AS INTEGER) AS selected,
       round((SELECT min(seasonal_index) FROM season_idx WHERE month BETWEEN 4 AND 11) * 0.9, 6) AS y_min,
       round((SELECT max(seasonal_index) FROM season_idx WHERE month BETWEEN 4 AND 11) * 1.1, 6) AS y_max
FROM season_idx WHERE month BETWEEN 4 AND 11
""")
def season_rows(spark, sf):
    """Q17."""
    return Rp.season_rows(season(spark, sf), 7)


@query("map_rows", f"""
WITH d AS (SELECT *, ln(pred_price) AS lp FROM dash_preds WHERE month = 7 AND {_SEL})
SELECT id, latitude, longitude, neighbourhood, room_type, round(pred_price, 6) AS pred_price,
       round(lp, 9) AS log_pred_price,
       round((SELECT quantile_cont(lp, 0.05) FROM d), 9) AS color_min,
       round((SELECT quantile_cont(lp, 0.95) FROM d), 9) AS color_max
FROM d
""")
def map_rows(spark, sf):
    """Q18."""
    return Rp.map_rows(_sel_preds(spark, sf))


@query("bounding_box", f"""
SELECT min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max,
       round((min(latitude) + max(latitude)) / 2, 9) AS lat_center,
       round((min(longitude) + max(longitude)) / 2, 9) AS lon_center
FROM dash_preds WHERE month = 7 AND {_SEL}
""")
def bounding_box(spark, sf):
    """Q19."""
    return Rp.bounding_box(_sel_preds(spark, sf))


_RADAR = ["review_scores_rating", "review_scores_accuracy", "review_scores_cleanliness", "review_scores_checkin",
          "review_scores_communication", "review_scores_location", "review_scores_value"]


@query("score_radar", " UNION ALL ".join(
    f"SELECT id, '...' || right(CAST(id AS VARCHAR), 6) AS label, '{c}' AS score, {c} AS value FROM listing_base "
    f"WHERE id IN ({', '.join(map(str, _IDS))})" for c in _RADAR))
def score_radar(spark, sf):
    """Q20."""
    return Rp.score_radar(listing_base(spark, sf), _IDS, _RADAR)


@query("explorer_table", f"""
SELECT id, borough, room_type, neighbourhood, month, price_numeric, pred_price FROM dash_preds
WHERE month = 7 AND {_SEL}
""")
def explorer_table(spark, sf):
    """Q22: filtered rows sorted by price (describe is A10)."""
    return Rp.explorer_table(_sel_preds(spark, sf),
                             ["id", "borough", "room_type", "neighbourhood", "month", "price_numeric", "pred_price"])


# ------------------------------------------- Q3-Q6 on the tools' own table

@query("describe_column_tool", """
SELECT count(review_scores_rating) AS count, round(avg(review_scores_rating), 3) AS mean,
       round(stddev_samp(review_scores_rating), 3) AS std, round(min(review_scores_rating), 3) AS min,
       round(quantile_cont(review_scores_rating, 0.25), 3) AS p25,
       round(quantile_cont(review_scores_rating, 0.5), 3) AS median,
       round(quantile_cont(review_scores_rating, 0.75), 3) AS p75, round(max(review_scores_rating), 3) AS max
FROM qbase WHERE borough = 'EUROPE'
""")
def describe_column_tool(spark, sf):
    """Q3: describe a column of the listing-level table under filters."""
    return R.describe(R.common_filters(qbase(spark, sf), borough="EUROPE"), "review_scores_rating")


@query("group_aggregate_tool", """
SELECT room_type, round(avg(estimated_revenue), 3) AS value FROM qbase WHERE room_type IS NOT NULL GROUP BY room_type
""")
def group_aggregate_tool(spark, sf):
    """Q4: chosen aggregate by a chosen dimension (decoded room labels)."""
    return R.group_aggregate(qbase(spark, sf), "room_type", "estimated_revenue", "mean").withColumn(
        "value", F.round("value", 3))


@query("top_n_tool", """
SELECT id, borough, round(price_numeric, 2) AS price, round(review_scores_rating, 2) AS rating FROM qbase
WHERE review_scores_rating >= 4.0 ORDER BY price_numeric DESC NULLS LAST, id LIMIT 8
""")
def top_n_tool(spark, sf):
    """Q5: top n listings by mean price after filters."""
    d = R.common_filters(qbase(spark, sf), min_rating=4.0)
    return R.top_n(d, "price_numeric", 8).select("id", "borough", F.round("price_numeric", 2).alias("price"),
                                                 F.round("review_scores_rating", 2).alias("rating"))


@query("correlate_tool", """
WITH s AS (SELECT dist_subway_km AS a, price_numeric AS b FROM qbase
           WHERE dist_subway_km IS NOT NULL AND price_numeric IS NOT NULL),
     r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2E0 AS ra,
                  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2E0 AS rb FROM s)
SELECT count(*) AS n, round(corr(a, b), 4) AS pearson, round(corr(ra, rb), 4) AS spearman FROM r
""")
def correlate_tool(spark, sf):
    """Q6: Pearson and Spearman of subway distance and mean price."""
    return Qs.correlate(qbase(spark, sf), "dist_subway_km", "price_numeric")


@query("correlate_tool_borough", """
WITH s AS (SELECT crime_count_500m AS a, price_numeric AS b FROM qbase
           WHERE borough = 'EUROPE' AND crime_count_500m IS NOT NULL AND price_numeric IS NOT NULL),
     r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2E0 AS ra,
                  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2E0 AS rb FROM s)
SELECT count(*) AS n, round(corr(a, b), 4) AS pearson, round(corr(ra, rb), 4) AS spearman FROM r
""")
def correlate_tool_borough(spark, sf):
    """Q6 within one borough."""
    return Qs.correlate(qbase(spark, sf), "crime_count_500m", "price_numeric", borough="EUROPE")
