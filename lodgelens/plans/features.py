"""Feature, season and panel jobs.

``feature_matrix``: parse -> short-stay filter -> encodings -> spatial joins
(a checkpoint each) -> median imputation -> log target.  Spatial features are
computed on the narrow (id, lat, lon) probe table and joined back by id, so
the wide listing rows never travel through the grid joins.  The medians for
imputation come from one range sort, attached as a 1-row broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.functions import scalar as S
from lodgelens.operators import ranks
from lodgelens.operators import relational as R
from lodgelens.operators import spatial as G
from lodgelens.session import ensure_checkpoint_dir
from lodgelens.sources import catalog

REVIEW_COLS = ["review_scores_rating", "review_scores_accuracy", "review_scores_cleanliness",
               "review_scores_checkin", "review_scores_communication", "review_scores_location",
               "review_scores_value"]
HOST_COLS = ["is_superhost", "host_identity_verified_f", "is_instant_bookable", "host_response_rate_f",
             "host_acceptance_rate_f", "host_response_time_ord", "has_license"]
SPATIAL_COLS = ["dist_subway_km", "near_subway", "subway_lines_500m", "nearest_subway_cbd", "nearest_subway_ada",
                "dist_lirr_km", "lirr_count_1mi", "poi_count_500m", "poi_count_1km", "tourist_poi_500m",
                "crime_count_500m"]
FEATURE_COLS = (["accommodates", "bedrooms", "beds", "bathrooms", "room_type_ord", "amenity_count",
                 "minimum_nights", "availability_365", "number_of_reviews", "number_of_reviews_ltm",
                 "reviews_per_month"] + REVIEW_COLS + HOST_COLS + list(S.KEY_AMENITIES) + SPATIAL_COLS
                + ["estimated_occupancy", "estimated_revenue"])
# Explicit category lists: the one-hot plan needs no distinct pass over data.
BOROUGHS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PROPERTY_SIMPLIFIED = ["Entire home", "Hotel room", "Other", "Private room", "Shared room"]
MEDIAN_FILL = (["bathrooms", "host_response_rate_f", "host_acceptance_rate_f", "host_response_time_ord"]
               + REVIEW_COLS + ["bedrooms", "beds", "reviews_per_month", "estimated_occupancy", "estimated_revenue"])
META = ["id", "latitude", "longitude", "neighbourhood", "borough"]
TOURIST_DOMAINS = ["PROMO", "STANDARD"]
RAIL_FLAG = 1  # fixture: stations with cbd = 1 play the commuter-rail set


def col_name(prefix: str, value: str) -> str:
    return f"{prefix}_" + value.replace(" ", "_")


BORO_COLS = [col_name("boro", b) for b in BOROUGHS]
PROP_COLS = [col_name("prop", p) for p in PROPERTY_SIMPLIFIED]
ALL_FEATURES = FEATURE_COLS + BORO_COLS + PROP_COLS


def encoded_listings(lst: DataFrame, boroughs: list[str] = BOROUGHS, property_types: list[str] = PROPERTY_SIMPLIFIED) -> DataFrame:
    """Parse and encode the raw listing fields (F1-F12, R4); short-stay filter.
    One 0/1 column per borough and property type named."""
    parsed = lst.withColumn("price_numeric", S.parse_price("price"))
    df = R.short_stay_filter(parsed)
    flags = S.keyword_flags("amenities")
    df = df.select(
        *META, "price_numeric", "accommodates", "bedrooms", "beds",
        S.parse_bathrooms("bathrooms_text").alias("bathrooms"),
        S.ordinal_default("room_type").alias("room_type_ord"),
        S.count_quoted("amenities").alias("amenity_count"),
        "minimum_nights", "availability_365", "number_of_reviews", "number_of_reviews_ltm", "reviews_per_month",
        *REVIEW_COLS,
        S.tf_flag("host_is_superhost").alias("is_superhost"),
        S.tf_flag("host_identity_verified").alias("host_identity_verified_f"),
        S.tf_flag("instant_bookable").alias("is_instant_bookable"),
        S.parse_percent("host_response_rate").alias("host_response_rate_f"),
        S.parse_percent("host_acceptance_rate").alias("host_acceptance_rate_f"),
        S.ordinal_map("host_response_time").alias("host_response_time_ord"),
        S.presence_flag("license").alias("has_license"),
        *[v.alias(k) for k, v in flags.items()],
        "estimated_occupancy", "estimated_revenue",
        S.simplify_category("property_type").alias("_prop"),
    )
    df = df.withColumns({c: F.coalesce((F.col("borough") == b).cast("int"), F.lit(0))
                         for b, c in ((b, col_name("boro", b)) for b in boroughs)})
    df = df.withColumns({c: F.coalesce((F.col("_prop") == p).cast("int"), F.lit(0))
                         for p, c in ((p, col_name("prop", p)) for p in property_types)})
    return df.drop("_prop")


def spatial_features(probes: DataFrame, stations: DataFrame, points: DataFrame, arrests: DataFrame,
                     tourist_domains: list[str] = TOURIST_DOMAINS, rail_flag: int = RAIL_FLAG) -> DataFrame:
    """J6-J11 for the probe table (id, latitude, longitude): one candidate
    join per reference set and distance question.  Each question's table and
    the tables between its joins are checkpointed, one after the other: the
    driver plans a join at a time and never writes out a long plan."""
    ensure_checkpoint_dir(probes.sparkSession)

    def step(df: DataFrame) -> DataFrame:
        return df.checkpoint()
    probes = step(probes)
    rail = stations.filter(F.col("cbd") == rail_flag)
    subway = G.nearest(probes, stations, attrs=["cbd", "ada"], stage=step).select(
        "id", F.col("dist_km").alias("dist_subway_km"), F.col("cbd").alias("nearest_subway_cbd"),
        F.col("ada").alias("nearest_subway_ada"))
    lines = G.radius_distinct_tokens(probes, stations, "routes", 0.5, "subway_lines_500m", stage=step)
    lirr = G.nearest_and_count(probes, rail, 1.60934, "lirr_count_1mi", stage=step).withColumnRenamed("dist_km", "dist_lirr_km")
    tourist = F.coalesce(F.col("domain").isin(tourist_domains), F.lit(False))
    poi = G.radius_counts(probes, points, {"poi_count_500m": 0.5, "poi_count_1km": 1.0, "tourist_poi_500m": (0.5, tourist)}, stage=step)
    crime = G.radius_counts(probes, arrests, {"crime_count_500m": 0.5}, stage=step)
    parts = [p.checkpoint() for p in (subway, lines, lirr, poi, crime)]
    out = reduce(lambda a, b: a.join(b.hint("merge"), "id"), parts)
    return out.withColumn("near_subway", (F.col("dist_subway_km") <= 0.5).cast("int"))


def median_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill nulls with the median of the non-null values of this
    table; all medians from one range sort, attached as one broadcast row."""
    med = ranks.medians(df, {f"_m_{c}": F.col(c) for c in cols})
    return df.crossJoin(F.broadcast(med)).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}).drop(*[f"_m_{c}" for c in cols])


def build_features(listings: DataFrame, stations: DataFrame, points: DataFrame, arrests: DataFrame, *,
                   boroughs: list[str] = BOROUGHS, property_types: list[str] = PROPERTY_SIMPLIFIED,
                   tourist_domains: list[str] = TOURIST_DOMAINS, rail_flag: int = RAIL_FLAG) -> DataFrame:
    """One row per short-stay listing: meta + features + price targets,
    from any listing, station, point and incident tables.  Categories and the
    reference subsets are arguments; the defaults are the fixture's."""
    enc = encoded_listings(listings, boroughs, property_types)
    sp = spatial_features(enc.select("id", "latitude", "longitude"), stations, points, arrests, tourist_domains, rail_flag)
    features = FEATURE_COLS + [col_name("boro", b) for b in boroughs] + [col_name("prop", p) for p in property_types]
    df = enc.join(sp.hint("merge"), "id").checkpoint()  # read by the medians and the fill
    # the listed columns and every other double (distances are null when a set is empty)
    sweep = [c for c in features if c not in MEDIAN_FILL and df.schema[c].dataType.typeName() == "double"]
    df = median_impute(df, MEDIAN_FILL + sweep)
    return df.select(*META, *features, "price_numeric", F.log1p("price_numeric").alias("log_price"))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 over the fixture tables."""
    return build_features(catalog.fx_listings(spark, sf_dir), catalog.fx_stations(spark, sf_dir),
                          catalog.fx_points(spark, sf_dir), catalog.fx_arrests(spark, sf_dir))


def seasonal_index(reviews: DataFrame, min_year: int, exclude_years: list[int], max_year: int | None = None,
                   digits: int = 4) -> DataFrame:
    """Reviews per (year, month) -> mean over years per month -> ratio to
    the mean of the months.  The monthly table has at most 12 rows."""
    r = reviews.select(F.year("date").alias("year"), F.month("date").cast("int").alias("month"))
    r = r.filter(F.col("year") >= min_year)
    if max_year is not None:
        r = r.filter(F.col("year") <= max_year)
    r = R.exclude_values(r, "year", exclude_years)
    per = r.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))
    monthly = per.groupBy("month").agg(F.avg("n").alias("avg_reviews"))
    mean = monthly.agg(F.avg("avg_reviews").alias("_mu"))
    return monthly.crossJoin(F.broadcast(mean)).select(
        "month", "avg_reviews", F.round(F.col("avg_reviews") / F.col("_mu"), digits).alias("seasonal_index"))


def seasonal_index_total(reviews: DataFrame, min_year: int, max_year: int) -> DataFrame:
    """Total reviews per month over a year range / mean of months."""
    r = reviews.filter(F.year("date").between(min_year, max_year))
    monthly = r.groupBy(F.month("date").cast("int").alias("month")).agg(F.count(F.lit(1)).alias("review_count"))
    mean = monthly.agg(F.avg("review_count").alias("_mu"))
    return monthly.crossJoin(F.broadcast(mean)).select(
        "month", "review_count", (F.col("review_count") / F.col("_mu")).alias("relative_demand"),
        S.month_name("month").alias("month_name"))


def stack_months(features: DataFrame, prices: DataFrame, season: DataFrame, months=(4, 11),
                 cap: float = 2000.0) -> DataFrame:
    """Features x monthly prices (months in range, 0 < price <= cap,
    listing kept) with the month's season index; one join replaces the loop
    over months.  ``season`` has at most 12 rows, so it is broadcast."""
    drop = ["price_numeric", "log_price", "latitude", "longitude", "neighbourhood", "borough"]
    base = features.drop(*[c for c in drop if c in features.columns])
    p = prices.filter(F.col("month").between(*months) & F.col("price_numeric").isNotNull())
    p = R.price_cap(p, "price_numeric", cap)
    stacked = base.join(p.hint("merge"), "id").join(F.broadcast(season.select("month", "seasonal_index")), "month")
    return stacked.withColumn("log_price", F.log1p("price_numeric"))


def listing_level(panel: DataFrame) -> DataFrame:
    """One row per listing: mean price and log price over months, other
    columns from the earliest month (``min_by``: a partial aggregate).  A
    ``min_by`` for each column, as Spark drops those that aren't asked for;
    all of them see the same rows, so a tie gives one row's values."""
    others = [c for c in panel.columns if c not in ("id", "price_numeric", "log_price", "month", "seasonal_index")]
    return panel.groupBy("id").agg(
        F.avg("price_numeric").alias("price_numeric"), F.avg("log_price").alias("log_price"),
        *[F.min_by(c, "month").alias(c) for c in others])
