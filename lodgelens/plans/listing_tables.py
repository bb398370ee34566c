"""Shared derived tables over the fixture views (Spark side) and their SQL
twins for the oracle (registered as views in ``oracle_views``).

``listing_base``: the short-stay listings with parsed fields (F1, F3, F4, F5,
F7, F10) - the table the analytic questions run on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodgelens.functions import scalar as S
from lodgelens.operators import relational as R
from lodgelens.plans import oracle_views as V
from lodgelens.sources import catalog

SCORE_COLS = ["review_scores_rating", "review_scores_accuracy", "review_scores_cleanliness",
              "review_scores_checkin", "review_scores_communication", "review_scores_location",
              "review_scores_value"]
AMENITY_FLAGS = list(S.KEY_AMENITIES)


def parsed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lst = catalog.fx_listings(spark, sf_dir)
    return lst.select(
        "id", "borough", "neighbourhood", "property_type", "room_type", "latitude", "longitude",
        S.parse_price("price").alias("price_numeric"), "minimum_nights", "accommodates", "bedrooms", "beds",
        S.parse_bathrooms("bathrooms_text").alias("bathrooms"),
        *SCORE_COLS,
        S.parse_percent("host_response_rate").alias("host_response_rate_f"),
        S.tf_flag("host_is_superhost").alias("is_superhost"),
        S.tf_flag("instant_bookable").alias("is_instant_bookable"),
        S.count_quoted("amenities").alias("amenity_count"),
        *[v.alias(k) for k, v in S.keyword_flags("amenities").items()],
        "availability_365", "number_of_reviews", "estimated_occupancy", "estimated_revenue",
    )


def listing_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.short_stay_filter(parsed_listings(spark, sf_dir))


_FLAG_SQL = ",\n       ".join(
    f"CAST(coalesce(regexp_matches(lower(amenities), '{p}'), false) AS INTEGER) AS {k}"
    for k, p in S.KEY_AMENITIES.items())

V.register("parsed_listings", f"""
SELECT id, borough, neighbourhood, property_type, room_type, latitude, longitude,
       TRY_CAST(regexp_replace(price, '[$,]', '', 'g') AS DOUBLE) AS price_numeric,
       minimum_nights, accommodates, bedrooms, beds,
       CASE WHEN lower(bathrooms_text) LIKE '%half%' THEN 0.5E0
            ELSE TRY_CAST(nullif(regexp_extract(lower(bathrooms_text), '[0-9.]+', 0), '') AS DOUBLE) END AS bathrooms,
       {", ".join(SCORE_COLS)},
       TRY_CAST(trim(replace(host_response_rate, '%', '')) AS DOUBLE) / 100E0 AS host_response_rate_f,
       CAST(coalesce(host_is_superhost = 't', false) AS INTEGER) AS is_superhost,
       CAST(coalesce(instant_bookable = 't', false) AS INTEGER) AS is_instant_bookable,
       coalesce(CAST(len(regexp_extract_all(amenities, '"[^"]+"')) AS INTEGER), 0) AS amenity_count,
       {_FLAG_SQL},
       availability_365, number_of_reviews, estimated_occupancy, estimated_revenue
FROM fx_listings
""")

V.register("listing_base", """
SELECT * FROM parsed_listings
WHERE minimum_nights < 28 AND price_numeric IS NOT NULL AND price_numeric > 0
""")
