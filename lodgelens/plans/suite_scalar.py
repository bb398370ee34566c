"""Registered queries: scalar functions (F1-F27) applied to fixture columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.functions import scalar as S
from lodgelens.operators import relational as R
from lodgelens.plans.listing_tables import listing_base
from lodgelens.plans.registry import query
from lodgelens.sources import catalog
from lodgelens.sources.tables import table


def _lst(spark, sf):
    return catalog.fx_listings(spark, sf)


@query("parse_price", """
SELECT id, price, TRY_CAST(regexp_replace(price, '[$,]', '', 'g') AS DOUBLE) AS price_numeric FROM fx_listings
""")
def parse_price(spark, sf):
    """F1."""
    return _lst(spark, sf).select("id", "price", S.parse_price("price").alias("price_numeric"))


@query("to_number", """
SELECT id, TRY_CAST(substr(license, 5) AS DOUBLE) AS license_no FROM fx_listings
""")
def to_number(spark, sf):
    """F2."""
    return _lst(spark, sf).select("id", S.to_number(F.substring("license", 5, 1 << 20)).alias("license_no"))


@query("parse_percent", """
SELECT id, TRY_CAST(trim(replace(host_response_rate, '%', '')) AS DOUBLE) / 100E0 AS host_response_rate_f
FROM fx_listings
""")
def parse_percent(spark, sf):
    """F3."""
    return _lst(spark, sf).select("id", S.parse_percent("host_response_rate").alias("host_response_rate_f"))


@query("parse_bathrooms", """
SELECT id, CASE WHEN lower(bathrooms_text) LIKE '%half%' THEN 0.5E0
                ELSE TRY_CAST(nullif(regexp_extract(lower(bathrooms_text), '[0-9.]+', 0), '') AS DOUBLE) END AS bathrooms
FROM fx_listings
""")
def parse_bathrooms(spark, sf):
    """F4."""
    return _lst(spark, sf).select("id", S.parse_bathrooms("bathrooms_text").alias("bathrooms"))


@query("count_quoted", """
SELECT id, coalesce(CAST(len(regexp_extract_all(amenities, '"[^"]+"')) AS INTEGER), 0) AS amenity_count
FROM fx_listings
""")
def count_quoted(spark, sf):
    """F5."""
    return _lst(spark, sf).select("id", S.count_quoted("amenities").alias("amenity_count"))


@query("json_array_len", """
SELECT id, coalesce(CASE WHEN json_valid(amenities) THEN CAST(json_array_length(amenities) AS INTEGER) END, 0)
       AS amenities_count
FROM fx_listings
""")
def json_array_len(spark, sf):
    """F6."""
    return _lst(spark, sf).select("id", S.json_array_len("amenities").alias("amenities_count"))


@query("keyword_flags", "SELECT id, " + ", ".join(
    f"CAST(coalesce(regexp_matches(lower(amenities), '{p}'), false) AS INTEGER) AS {k}"
    for k, p in S.KEY_AMENITIES_WITH_DISHWASHER.items()) + " FROM fx_listings")
def keyword_flags(spark, sf):
    """F7 (the 12-pattern variant; 'washer' also matches 'Dishwasher')."""
    flags = S.keyword_flags("amenities", S.KEY_AMENITIES_WITH_DISHWASHER)
    return _lst(spark, sf).select("id", *[v.alias(k) for k, v in flags.items()])


@query("ordinal_map", "SELECT id, CAST(CASE lower(host_response_time) " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in S.RESPONSE_TIME_MAP.items()) + " END AS INTEGER) AS host_response_time_ord FROM fx_listings")
def ordinal_map(spark, sf):
    """F8."""
    return _lst(spark, sf).select("id", S.ordinal_map("host_response_time").alias("host_response_time_ord"))


_ROOM_ORD_SQL = "CAST(coalesce(CASE room_type " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in S.ROOM_TYPE_MAP.items()) + " END, 1) AS INTEGER)"


@query("ordinal_default", f"SELECT id, {_ROOM_ORD_SQL} AS room_type_ord FROM fx_listings")
def ordinal_default(spark, sf):
    """F9."""
    return _lst(spark, sf).select("id", S.ordinal_default("room_type").alias("room_type_ord"))


@query("tf_flag", """
SELECT id, CAST(coalesce(host_is_superhost = 't', false) AS INTEGER) AS is_superhost,
       CASE host_is_superhost WHEN 't' THEN 1 WHEN 'f' THEN 0 END AS superhost_code
FROM fx_listings
""")
def tf_flag(spark, sf):
    """F10 (both forms)."""
    return _lst(spark, sf).select("id", S.tf_flag("host_is_superhost").alias("is_superhost"),
                                  S.tf_map("host_is_superhost").alias("superhost_code"))


@query("presence_flag", "SELECT id, CAST(license IS NOT NULL AS INTEGER) AS has_license FROM fx_listings")
def presence_flag(spark, sf):
    """F11."""
    return _lst(spark, sf).select("id", S.presence_flag("license").alias("has_license"))


@query("simplify_category", """
SELECT id, CASE WHEN room_type IS NULL THEN 'Other'
                WHEN lower(room_type) LIKE '%entire%' THEN 'Entire home'
                WHEN lower(room_type) LIKE '%private%' THEN 'Private room'
                WHEN lower(room_type) LIKE '%shared%' THEN 'Shared room'
                WHEN lower(room_type) LIKE '%hotel%' THEN 'Hotel room' ELSE 'Other' END AS property_simplified
FROM fx_listings
""")
def simplify_category(spark, sf):
    """F12."""
    return _lst(spark, sf).select("id", S.simplify_category("room_type").alias("property_simplified"))


_FEATS = ["accommodates", "bedrooms", "bathrooms", "amenity_count", "review_scores_rating",
          "review_scores_location", "is_superhost", "host_response_rate_f", "has_wifi", "has_pool",
          "availability_365", "number_of_reviews", "estimated_occupancy"]


def _feature_category_sql(n):
    return f"""CASE WHEN {n} IN ('month', 'seasonal_index') THEN 'Seasonal'
 WHEN starts_with({n}, 'boro_') THEN 'Borough' WHEN starts_with({n}, 'prop_') THEN 'Property type'
 WHEN contains({n}, 'subway') OR contains({n}, 'lirr') THEN 'Transit'
 WHEN contains({n}, 'poi') OR contains({n}, 'crime') THEN 'Spatial (POI/crime)'
 WHEN {n} IN ({", ".join(repr(h) for h in S.HOST_FEATURES)}) THEN 'Host'
 WHEN starts_with({n}, 'has_') OR {n} = 'amenity_count' THEN 'Amenities'
 WHEN contains({n}, 'review') THEN 'Reviews' ELSE 'Property' END"""


@query("feature_category", "WITH m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs({c})), 9) AS mean_abs FROM listing_base" for c in _FEATS)
    + f")\nSELECT feature, mean_abs, {_feature_category_sql('feature')} AS category FROM m")
def feature_category(spark, sf):
    """categories of the listing features, with their mean |value|."""
    m = R.mean_abs_ranked(listing_base(spark, sf), _FEATS)
    return m.withColumn("category", S.feature_category("feature"))


@query("log_price", """
SELECT id, round(ln(1 + price_numeric), 9) AS log_price, round(exp(ln(1 + price_numeric)) - 1, 6) AS back,
       round(ln(price_numeric), 9) AS ln_price FROM listing_base
""")
def log_price(spark, sf):
    """log1p / expm1 / log."""
    lp = F.log1p("price_numeric")
    return listing_base(spark, sf).select("id", F.round(lp, 9).alias("log_price"),
                                          F.round(F.expm1(lp), 6).alias("back"),
                                          F.round(F.log("price_numeric"), 9).alias("ln_price"))


@query("haversine", """
SELECT l.id, s.ref_id, round(6371.0E0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 9) AS dist_km FROM (
  SELECT l.id, s.ref_id, pow(sin((radians(s.latitude) - radians(l.latitude)) / 2), 2)
         + cos(radians(l.latitude)) * cos(radians(s.latitude)) * pow(sin((radians(s.longitude) - radians(l.longitude)) / 2), 2) AS a
  FROM fx_listings l JOIN fx_stations s ON l.id % 100 = s.ref_id) t
""".replace("SELECT l.id, s.ref_id, round", "SELECT t.id, t.ref_id, round").replace(
    "FROM (\n  SELECT", "FROM (\n  SELECT"))
def haversine(spark, sf):
    """distance from each listing to one assigned station."""
    lst = _lst(spark, sf).select("id", F.col("latitude").alias("la"), F.col("longitude").alias("lo"),
                                 (F.col("id") % 100).alias("ref_id"))
    st = catalog.fx_stations(spark, sf).select("ref_id", "latitude", "longitude")
    return lst.join(st, "ref_id").select("id", "ref_id",
                                         F.round(S.haversine_km("la", "lo", "latitude", "longitude"), 9).alias("dist_km"))


@query("date_parts", """
SELECT review_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       strftime(date, '%b') AS month_name FROM fx_reviews
""")
def date_parts(spark, sf):
    """F16."""
    r = catalog.fx_reviews(spark, sf)
    return r.select("review_id", F.year("date").cast("int").alias("year"), F.month("date").cast("int").alias("month"),
                    F.date_format("date", "MMM").alias("month_name"))


@query("label_map", f"""
SELECT id, coalesce(CASE {_ROOM_ORD_SQL} """ + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in S.ROOM_CODE_DECODE.items()) + """ END, 'Unknown') AS room_label
FROM fx_listings
""")
def label_map(spark, sf):
    """room code decoding of the question tools (0 -> 'Unknown')."""
    return _lst(spark, sf).select("id", S.label_map(S.ordinal_default("room_type"), S.ROOM_CODE_DECODE).alias("room_label"))


@query("sentiment_label", """
SELECT event_id, CASE WHEN value - 50 > 0 THEN 'positive' WHEN value - 50 < 0 THEN 'negative' ELSE 'neutral' END
       AS label FROM events
""")
def sentiment_label(spark, sf):
    """F18 on a signed score."""
    return table(spark, sf, "events").select("event_id", S.sentiment_label(F.col("value") - 50).alias("label"))


@query("segment_listing", """
SELECT user_id, round(avg(CAST(event_type <> 'error' AS INTEGER)), 9) AS positive_ratio,
       CASE WHEN avg(CAST(event_type <> 'error' AS INTEGER)) >= 0.9 THEN 'satisfactory'
            WHEN avg(CAST(event_type <> 'error' AS INTEGER)) >= 0.5 THEN 'moderate' ELSE 'dissatisfactory' END AS segment
FROM events GROUP BY user_id
""")
def segment_listing(spark, sf):
    """F19 on a per-key ratio."""
    g = table(spark, sf, "events").groupBy("user_id").agg(
        F.avg((F.col("event_type") != "error").cast("int")).alias("r"))
    return g.select("user_id", F.round("r", 9).alias("positive_ratio"), S.segment_listing("r").alias("segment"))


_PB = [0, 100, 500, 1000, 2000, 3000]
_PL = ["0-100", "100-500", "500-1000", "1000-2000", "2000-3000"]


@query("cut_bins", "SELECT id, CASE " + " ".join(
    f"WHEN price_numeric > {lo} AND price_numeric <= {hi} THEN '{lab}'" for lo, hi, lab in zip(_PB, _PB[1:], _PL))
    + " END AS price_bin FROM listing_base")
def cut_bins(spark, sf):
    """F20."""
    return listing_base(spark, sf).select("id", S.cut_bins("price_numeric", _PB, _PL).alias("price_bin"))


@query("minmax_clip", """
WITH b AS (SELECT min(c_quantity) AS lo, max(c_quantity) AS hi FROM fx_contributions)
SELECT id, line, round(CASE WHEN hi = lo THEN 0.5 WHEN c_quantity IS NULL THEN 0.5
       ELSE greatest(0.0, least(1.0, (c_quantity - lo) / (hi - lo))) END, 9) AS scaled
FROM fx_contributions, b
""")
def minmax_clip(spark, sf):
    """min-max scaling by the whole table's range."""
    c = catalog.fx_contributions(spark, sf)
    t = R.attach_scalars(c, lo=F.min("c_quantity"), hi=F.max("c_quantity"))
    return t.select("id", "line", F.round(S.minmax_clip("c_quantity", F.col("lo"), F.col("hi")), 9).alias("scaled"))


@query("short_id", "SELECT id, '...' || right(CAST(id AS VARCHAR), 6) AS short FROM fx_listings")
def short_id(spark, sf):
    """F24."""
    return _lst(spark, sf).select("id", S.short_id("id").alias("short"))


@query("split_join", """
SELECT ref_id, array_to_string(list_filter(string_split_regex(trim(routes), '\\s+'), lambda x: x <> ''), ', ') AS routes_csv,
       CAST(len(list_filter(string_split_regex(trim(routes), '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_routes
FROM fx_stations WHERE routes IS NOT NULL
""")
def split_join(spark, sf):
    """F25."""
    st = catalog.fx_stations(spark, sf).filter(F.col("routes").isNotNull())
    w = S.split_words("routes")
    return st.select("ref_id", F.array_join(w, ", ").alias("routes_csv"), F.size(w).alias("n_routes"))


@query("truncate_words", """
SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:12], ' ') AS head
FROM documents
""")
def truncate_words(spark, sf):
    """first 12 words of every document."""
    return table(spark, sf, "documents").select("doc_id", S.truncate_words("text", 12).alias("head"))
