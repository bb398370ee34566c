"""Registered queries: feature matrix, season index, panel, listing level
(E1-E8), dashboard filter (P9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.functions import scalar as S
from lodgelens.operators import relational as R
from lodgelens.plans import features as FE
from lodgelens.operators import ranks
from lodgelens.plans import oracle_views as V
from lodgelens.plans.registry import query
from lodgelens.plans.suite_spatial import hav_sql
from lodgelens.sources import catalog

SEASON_MIN_YEAR, SEASON_EXCLUDE = 1996, [1998]

# ------------------------------------------------------------ oracle views

_FLAGS = ",\n       ".join(
    f"CAST(coalesce(regexp_matches(lower(amenities), '{p}'), false) AS INTEGER) AS {k}"
    for k, p in S.KEY_AMENITIES.items())
_BORO = ", ".join(f"CAST(coalesce(borough = '{b}', false) AS INTEGER) AS {c}" for b, c in zip(FE.BOROUGHS, FE.BORO_COLS))
_PROP = ", ".join(f"CAST(coalesce(_prop = '{p}', false) AS INTEGER) AS {c}"
                  for p, c in zip(FE.PROPERTY_SIMPLIFIED, FE.PROP_COLS))
_ROOM = "CAST(coalesce(CASE room_type " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in S.ROOM_TYPE_MAP.items()) + " END, 1) AS INTEGER)"
_RT = "CAST(CASE lower(host_response_time) " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in S.RESPONSE_TIME_MAP.items()) + " END AS INTEGER)"

V.register("fm_encoded", f"""
SELECT id, latitude, longitude, neighbourhood, borough, price_numeric, accommodates, bedrooms, beds,
       CASE WHEN lower(bathrooms_text) LIKE '%half%' THEN 0.5E0
            ELSE TRY_CAST(nullif(regexp_extract(lower(bathrooms_text), '[0-9.]+', 0), '') AS DOUBLE) END AS bathrooms,
       {_ROOM} AS room_type_ord,
       coalesce(CAST(len(regexp_extract_all(amenities, '"[^"]+"')) AS INTEGER), 0) AS amenity_count,
       minimum_nights, availability_365, number_of_reviews, number_of_reviews_ltm, reviews_per_month,
       {", ".join(FE.REVIEW_COLS)},
       CAST(coalesce(host_is_superhost = 't', false) AS INTEGER) AS is_superhost,
       CAST(coalesce(host_identity_verified = 't', false) AS INTEGER) AS host_identity_verified_f,
       CAST(coalesce(instant_bookable = 't', false) AS INTEGER) AS is_instant_bookable,
       TRY_CAST(trim(replace(host_response_rate, '%', '')) AS DOUBLE) / 100E0 AS host_response_rate_f,
       TRY_CAST(trim(replace(host_acceptance_rate, '%', '')) AS DOUBLE) / 100E0 AS host_acceptance_rate_f,
       {_RT} AS host_response_time_ord,
       CAST(license IS NOT NULL AS INTEGER) AS has_license,
       {_FLAGS},
       estimated_occupancy, estimated_revenue, {_BORO}, {_PROP}
FROM (SELECT *, TRY_CAST(regexp_replace(price, '[$,]', '', 'g') AS DOUBLE) AS price_numeric,
             CASE WHEN property_type IS NULL THEN 'Other'
                  WHEN lower(property_type) LIKE '%entire%' THEN 'Entire home'
                  WHEN lower(property_type) LIKE '%private%' THEN 'Private room'
                  WHEN lower(property_type) LIKE '%shared%' THEN 'Shared room'
                  WHEN lower(property_type) LIKE '%hotel%' THEN 'Hotel room' ELSE 'Other' END AS _prop
      FROM fx_listings) x
WHERE minimum_nights < 28 AND price_numeric IS NOT NULL AND price_numeric > 0
""")

V.register("fm_spatial", f"""
WITH st AS (SELECT e.id, s.ref_id, s.cbd, s.ada, s.routes,
                   {hav_sql('e.latitude', 'e.longitude', 's.latitude', 's.longitude')} AS d
            FROM fm_encoded e, fx_stations s),
nn AS (SELECT id, d AS dist_subway_km, cbd AS nearest_subway_cbd, ada AS nearest_subway_ada FROM (
         SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref_id) AS rn FROM st) WHERE rn = 1),
ln AS (SELECT e.id, CAST(count(DISTINCT nullif(t.tok, '')) AS INTEGER) AS subway_lines_500m
       FROM fm_encoded e LEFT JOIN (SELECT id, unnest(string_split_regex(trim(coalesce(routes, '')), '\\s+')) AS tok
                                    FROM st WHERE d <= 0.5) t ON e.id = t.id GROUP BY e.id),
lr AS (SELECT e.id, min(st.d) AS dist_lirr_km, CAST(count_if(st.d <= 1.60934) AS INTEGER) AS lirr_count_1mi
       FROM fm_encoded e LEFT JOIN st ON e.id = st.id AND st.cbd = {FE.RAIL_FLAG} GROUP BY e.id),
pt AS (SELECT e.id, p.domain, {hav_sql('e.latitude', 'e.longitude', 'p.latitude', 'p.longitude')} AS d
       FROM fm_encoded e, fx_points p WHERE p.latitude IS NOT NULL AND p.longitude IS NOT NULL),
po AS (SELECT e.id, CAST(count_if(pt.d <= 0.5) AS INTEGER) AS poi_count_500m,
              CAST(count_if(pt.d <= 1.0) AS INTEGER) AS poi_count_1km,
              CAST(count_if(pt.d <= 0.5 AND pt.domain IN ('PROMO', 'STANDARD')) AS INTEGER) AS tourist_poi_500m
       FROM fm_encoded e LEFT JOIN pt ON e.id = pt.id GROUP BY e.id),
cr AS (SELECT e.id, CAST(count(a.ref_id) AS INTEGER) AS crime_count_500m
       FROM fm_encoded e LEFT JOIN fx_arrests a
         ON a.latitude IS NOT NULL AND abs(a.latitude - e.latitude) < 0.01
        AND {hav_sql('e.latitude', 'e.longitude', 'a.latitude', 'a.longitude')} <= 0.5
       GROUP BY e.id)
SELECT nn.id, dist_subway_km, CAST(dist_subway_km <= 0.5 AS INTEGER) AS near_subway, subway_lines_500m,
       nearest_subway_cbd, nearest_subway_ada, dist_lirr_km, lirr_count_1mi, poi_count_500m, poi_count_1km,
       tourist_poi_500m, crime_count_500m
FROM nn JOIN ln ON nn.id = ln.id JOIN lr ON nn.id = lr.id JOIN po ON nn.id = po.id JOIN cr ON nn.id = cr.id
""")

V.register("fm_joined", "SELECT e.*, s.* EXCLUDE (id) FROM fm_encoded e JOIN fm_spatial s ON e.id = s.id")

_FILL = ",\n       ".join(f"coalesce({c}, (SELECT median({c}) FROM fm_joined)) AS {c}" for c in FE.MEDIAN_FILL)
_SWEEP = ",\n       ".join(f"coalesce({c}, (SELECT median({c}) FROM fm_joined)) AS {c}"
                            for c in ["dist_subway_km", "dist_lirr_km"])
_REST = [c for c in FE.ALL_FEATURES if c not in FE.MEDIAN_FILL and c not in ("dist_subway_km", "dist_lirr_km")]

V.register("feature_matrix", f"""
SELECT {", ".join(FE.META)}, {_FILL},
       {_SWEEP},
       {", ".join(_REST)}, price_numeric, ln(1 + price_numeric) AS log_price
FROM fm_joined
""")

V.register("season_idx", f"""
WITH r AS (SELECT year(date) AS year, CAST(month(date) AS INTEGER) AS month FROM fx_reviews
           WHERE year(date) >= {SEASON_MIN_YEAR}
             AND NOT coalesce(year(date) IN ({", ".join(map(str, SEASON_EXCLUDE))}), false)),
per AS (SELECT year, month, count(*) AS n FROM r GROUP BY year, month),
m AS (SELECT month, avg(n) AS avg_reviews FROM per GROUP BY month)
SELECT month, avg_reviews, round(avg_reviews / (SELECT avg(avg_reviews) FROM m), 4) AS seasonal_index FROM m
""")

V.register("panel", """
SELECT f.* EXCLUDE (price_numeric, log_price, latitude, longitude, neighbourhood, borough),
       p.month, p.price_numeric, s.seasonal_index, ln(1 + p.price_numeric) AS log_price
FROM feature_matrix f JOIN fx_monthly_prices p ON f.id = p.id JOIN season_idx s ON p.month = s.month
WHERE p.month BETWEEN 4 AND 11 AND p.price_numeric IS NOT NULL AND p.price_numeric > 0 AND p.price_numeric <= 2000
""")

V.register("listing_level", """
SELECT a.id, a.price_numeric, a.log_price, f.* EXCLUDE (id, price_numeric, log_price, month, seasonal_index)
FROM (SELECT id, avg(price_numeric) AS price_numeric, avg(log_price) AS log_price, min(month) AS m0
      FROM panel GROUP BY id) a
JOIN panel f ON f.id = a.id AND f.month = a.m0
""")


# ------------------------------------------------------------ Spark tables

def feature_matrix(spark, sf):
    """The feature matrix, written once per application and reused."""
    from lodgelens.plans.materialize import materialized
    return materialized(spark, "feature_matrix", sf, lambda: FE.feature_matrix(spark, sf))


def season(spark, sf):
    return FE.seasonal_index(catalog.fx_reviews(spark, sf), SEASON_MIN_YEAR, SEASON_EXCLUDE)


def panel(spark, sf):
    return FE.stack_months(feature_matrix(spark, sf), catalog.fx_monthly_prices(spark, sf), season(spark, sf))


def listing_level(spark, sf):
    return FE.listing_level(panel(spark, sf))


# ------------------------------------------------------------------- keys

@query("seasonal_index", "SELECT month, round(avg_reviews, 6) AS avg_reviews, seasonal_index FROM season_idx")
def seasonal_index_q(spark, sf):
    """Season index (years >= 1996 without 1998, no upper bound)."""
    return season(spark, sf).withColumn("avg_reviews", F.round("avg_reviews", 6))


@query("seasonal_index_total", """
WITH m AS (SELECT CAST(month(date) AS INTEGER) AS month, count(*) AS review_count FROM fx_reviews
           WHERE year(date) BETWEEN 1995 AND 2000 GROUP BY ALL)
SELECT month, review_count, round(review_count / (SELECT avg(review_count) FROM m), 6) AS relative_demand,
       strftime(make_date(2000, month, 1), '%b') AS month_name,
       round((SELECT avg(review_count) FROM m WHERE month IN (6, 7, 8)) / (SELECT avg(review_count) FROM m), 6) AS summer,
       round((SELECT avg(review_count) FROM m WHERE month IN (1, 2)) / (SELECT avg(review_count) FROM m), 6) AS winter
FROM m
""")
def seasonal_index_total(spark, sf):
    """Total reviews per month over a year range / mean; summer and winter means."""
    t = FE.seasonal_index_total(catalog.fx_reviews(spark, sf), 1995, 2000)
    sw = t.agg(F.avg(F.when(F.col("month").isin(6, 7, 8), F.col("relative_demand"))).alias("summer"),
               F.avg(F.when(F.col("month").isin(1, 2), F.col("relative_demand"))).alias("winter"))
    out = t.crossJoin(F.broadcast(sw))
    return out.select("month", "review_count", F.round("relative_demand", 6).alias("relative_demand"), "month_name",
                      F.round("summer", 6).alias("summer"), F.round("winter", 6).alias("winter"))


@query("project_price", """
SELECT round((SELECT quantile_cont(price_numeric, 0.5) FROM listing_base)
             * (SELECT seasonal_index FROM season_idx WHERE month = 12)
             / (SELECT seasonal_index FROM season_idx WHERE month = 11), 6) AS projected_median,
       round((SELECT seasonal_index FROM season_idx WHERE month = 12)
             / (SELECT seasonal_index FROM season_idx WHERE month = 11), 6) AS adjustment
""")
def project_price(spark, sf):
    """November median projected to December by the index ratio."""
    from lodgelens.plans.listing_tables import listing_base
    s = season(spark, sf)
    ratio = s.agg((F.max(F.when(F.col("month") == 12, F.col("seasonal_index")))
                   / F.max(F.when(F.col("month") == 11, F.col("seasonal_index")))).alias("adjustment"))
    med = ranks.medians(listing_base(spark, sf), {"m": F.col("price_numeric")})
    return med.crossJoin(ratio).select(F.round(F.col("m") * F.col("adjustment"), 6).alias("projected_median"),
                                       F.round("adjustment", 6).alias("adjustment"))


_IMP = ["bedrooms", "beds", "bathrooms", "review_scores_rating", "reviews_per_month"]


@query("median_impute", "SELECT id, " + ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM fm_encoded)) AS {c}" for c in _IMP) + " FROM fm_encoded")
def median_impute(spark, sf):
    """Fill nulls with the medians of the filtered table."""
    enc = FE.encoded_listings(catalog.fx_listings(spark, sf)).select("id", *_IMP)
    return FE.median_impute(enc, _IMP)


@query("feature_matrix", "SELECT * FROM feature_matrix")
def feature_matrix_q(spark, sf):
    """The full feature matrix."""
    return feature_matrix(spark, sf)


@query("stacked_features", "SELECT * FROM panel")
def stacked_features(spark, sf):
    """Feature matrix stacked over months 4-11 with season index."""
    return panel(spark, sf)


@query("listing_level", "SELECT * FROM listing_level")
def listing_level_q(spark, sf):
    """One row per listing from the panel."""
    return listing_level(spark, sf)


@query("dashboard_filter", """
SELECT l.id, l.borough, l.room_type, l.neighbourhood, p.month, p.price_numeric
FROM parsed_listings l JOIN fx_monthly_prices p ON l.id = p.id
WHERE p.month = 7 AND l.borough IN ('ASIA', 'EUROPE') AND l.room_type IN ('Private room', 'Entire home/apt')
  AND l.neighbourhood IN ('NATION_2', 'NATION_3', 'NATION_12', 'NATION_13')
""")
def dashboard_filter(spark, sf):
    """Month, boroughs, rooms and optional neighbourhoods."""
    from lodgelens.plans.listing_tables import parsed_listings
    l = parsed_listings(spark, sf).select("id", "borough", "room_type", "neighbourhood")
    p = l.join(catalog.fx_monthly_prices(spark, sf), "id")
    return R.dashboard_filter(p, 7, ["ASIA", "EUROPE"], ["Private room", "Entire home/apt"],
                              ["NATION_2", "NATION_3", "NATION_12", "NATION_13"])


@query("listing_summary_by_borough", """
SELECT borough, count(*) AS n, quantile_cont(price_numeric, 0.5) AS median_price,
       round(avg(review_scores_rating), 6) AS mean_rating, round(avg(dist_subway_km), 6) AS mean_dist_subway_km,
       round(avg(poi_count_500m), 6) AS mean_poi_500m, round(avg(crime_count_500m), 6) AS mean_crime_500m,
       round(avg(subway_lines_500m), 6) AS mean_subway_lines
FROM feature_matrix WHERE borough IS NOT NULL GROUP BY borough
""")
def listing_summary_by_borough(spark, sf):
    """Flagship: the full feature pipeline summarised by borough."""
    fm = feature_matrix(spark, sf)
    g = R.group_agg(fm, "borough", F.count(F.lit(1)).alias("n"),
                       F.round(F.avg("review_scores_rating"), 6).alias("mean_rating"),
                       F.round(F.avg("dist_subway_km"), 6).alias("mean_dist_subway_km"),
                       F.round(F.avg("poi_count_500m"), 6).alias("mean_poi_500m"),
                       F.round(F.avg("crime_count_500m"), 6).alias("mean_crime_500m"),
                       F.round(F.avg("subway_lines_500m"), 6).alias("mean_subway_lines"))
    mid = ranks.medians(fm, {"median_price": F.col("price_numeric")}, "borough")
    return g.join(mid, "borough").select("borough", "n", "median_price", *g.columns[2:])


@query("stack_months", """
SELECT l.id, p.month, l.accommodates, p.price_numeric, s.seasonal_index, ln(1 + p.price_numeric) AS log_price
FROM listing_base l JOIN fx_monthly_prices p ON l.id = p.id JOIN season_idx s ON p.month = s.month
WHERE p.month BETWEEN 4 AND 11 AND p.price_numeric IS NOT NULL AND p.price_numeric > 0 AND p.price_numeric <= 2000
""")
def stack_months_q(spark, sf):
    """One join of features x monthly prices x the month's index."""
    from lodgelens.plans.listing_tables import listing_base
    feats = listing_base(spark, sf).select("id", "accommodates", "price_numeric")
    return FE.stack_months(feats, catalog.fx_monthly_prices(spark, sf), season(spark, sf)).select(
        "id", "month", "accommodates", "price_numeric", "seasonal_index", "log_price")
