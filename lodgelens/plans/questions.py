"""The parameterised analytic questions (Q1-Q11) as DataFrame builders.

Each function takes the listing-level (or panel) DataFrame plus the question's
arguments and returns a small result DataFrame; unknown columns raise
``ValueError`` while the plan is built (the tools' "unknown column" error).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.functions import scalar as S
from lodgelens.operators import relational as R

PRICE, RATING, REVENUE, OCCUPANCY = "price_numeric", "review_scores_rating", "estimated_revenue", "estimated_occupancy"


def decode_panel(df: DataFrame) -> DataFrame:
    """Q11: borough and property type from their one-hot columns (first
    maximal column, prefix stripped), room label from the room code."""
    boro, prop = R.prefix_columns(df, "boro_"), R.prefix_columns(df, "prop_")
    return df.withColumns({
        "borough": S.strip_prefix(S.first_max_label(boro), "boro_"),
        "property_type": S.strip_prefix(S.first_max_label(prop), "prop_"),
        "room_type": S.label_map("room_type_ord", S.ROOM_CODE_DECODE, "Unknown"),
    })


def _require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Unknown column: {', '.join(missing)}")


def query_listings(df: DataFrame, *, borough=None, property_type=None, room_type=None, price_max=None,
                   price_min=None, min_rating=None, min_bedrooms=None, max_bedrooms=None, min_accommodates=None,
                   is_superhost=None, is_instant_bookable=None, required_amenities=None) -> DataFrame:
    """Q1: attribute and amenity filters, then the summary record."""
    d = R.common_filters(df, borough=borough, property_type=property_type, room_type=room_type,
                         price_max=price_max, price_min=price_min, min_rating=min_rating)
    conds: list[Column] = []
    if min_bedrooms is not None:
        conds.append(F.col("bedrooms") >= min_bedrooms)
    if max_bedrooms is not None:
        conds.append(F.col("bedrooms") <= max_bedrooms)
    if min_accommodates is not None:
        conds.append(F.col("accommodates") >= min_accommodates)
    if is_superhost is not None:
        conds.append(F.col("is_superhost") == (1 if is_superhost else 0))
    if is_instant_bookable is not None:
        conds.append(F.col("is_instant_bookable") == (1 if is_instant_bookable else 0))
    for a in required_amenities or []:
        if f"has_{a}" in df.columns:
            conds.append(F.col(f"has_{a}") == 1)
    if conds:
        d = d.filter(reduce(lambda a, b: a & b, conds))
    return R.summary_stats(d, PRICE, RATING, REVENUE)


def listing_details(df: DataFrame, ids: list[int]) -> DataFrame:
    """Q2: details of the given listings with their amenity names; ids that
    do not exist give no row (the tool's 'not found')."""
    names = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c[len("has_"):])) for c in S.KEY_AMENITIES]))
    return df.filter(F.col("id").isin(ids)).select(
        "id", "borough", "property_type", "room_type", "accommodates", "bedrooms", "beds", "bathrooms",
        F.round(PRICE, 2).alias("price_avg"), "minimum_nights", "availability_365",
        (F.col("is_superhost") == 1).alias("is_superhost"),
        (F.col("is_instant_bookable") == 1).alias("is_instant_bookable"),
        F.round("host_response_rate_f", 2).alias("host_response_rate"), "number_of_reviews",
        F.round(RATING, 2).alias("review_scores_rating"),
        F.round("review_scores_cleanliness", 2).alias("review_scores_cleanliness"),
        F.round("review_scores_location", 2).alias("review_scores_location"),
        F.array_join(names, ", ").alias("amenities"),
        F.round("dist_subway_km", 3).alias("dist_subway_km"), "subway_lines_500m", "crime_count_500m",
        "poi_count_500m", F.round(OCCUPANCY, 1).alias("estimated_occupancy"),
        F.round(REVENUE, 2).alias("estimated_revenue"))


def _side_stats(cond: Column, suffix: str) -> list[Column]:
    def m(c, d):
        return F.round(F.avg(F.when(cond, F.col(c))), d)
    return [F.count_if(cond).alias(f"n_{suffix}"), m(PRICE, 2).alias(f"price_mean_{suffix}"),
            m(RATING, 2).alias(f"rating_mean_{suffix}"), m(OCCUPANCY, 1).alias(f"occupancy_mean_{suffix}"),
            m(REVENUE, 2).alias(f"revenue_mean_{suffix}")]


def amenity_impact(df: DataFrame, amenity: str, borough=None) -> DataFrame:
    """Q7: listings with vs without an amenity, one aggregate with filtered
    means; deltas of the rounded means."""
    col = f"has_{amenity}"
    _require(df, col)
    d = df.filter(F.col("borough") == borough) if borough else df
    w = d.agg(*_side_stats(F.col(col) == 1, "with"), *_side_stats(F.col(col) == 0, "without"))
    return w.withColumns({f"delta_{k}": F.round(F.col(f"{k}_with") - F.col(f"{k}_without"), 2)
                          for k in ("price_mean", "rating_mean", "occupancy_mean", "revenue_mean")})


def seasonal_trend(panel: DataFrame, metric: str, aggregation: str = "mean", borough=None) -> DataFrame:
    """Q8: a metric per month over the panel, mean or median, 3 dp."""
    _require(panel, metric)
    d = panel.filter(F.col("borough") == borough) if borough else panel
    return R.aggregate_by(d, "month", metric, aggregation).withColumn("value", F.round("value", 3))


def correlate(df: DataFrame, a: str, b: str, borough=None) -> DataFrame:
    """Q6: Pearson and Spearman of two columns, of one borough if given."""
    _require(df, a, b)
    d = df.filter(F.col("borough") == borough) if borough else df
    return R.pearson_spearman(d, a, b)


def _location_filtered(df: DataFrame, *, max_subway_km=None, min_subway_lines_500m=None, require_ada_subway=False,
                       max_lirr_km=None, min_lirr_count_1mi=None, min_poi_500m=None, min_tourist_poi_500m=None,
                       max_crime_500m=None, borough=None, room_type=None, price_max=None,
                       min_rating=None) -> DataFrame:
    conds: list[Column] = []
    for col, v, op in [("dist_subway_km", max_subway_km, "le"), ("subway_lines_500m", min_subway_lines_500m, "ge"),
                       ("dist_lirr_km", max_lirr_km, "le"), ("lirr_count_1mi", min_lirr_count_1mi, "ge"),
                       ("poi_count_500m", min_poi_500m, "ge"), ("tourist_poi_500m", min_tourist_poi_500m, "ge"),
                       ("crime_count_500m", max_crime_500m, "le")]:
        if v is not None:
            conds.append(F.col(col) <= v if op == "le" else F.col(col) >= v)
    if require_ada_subway:
        conds.append(F.col("nearest_subway_ada") == 1)
    d = df.filter(reduce(lambda a, b: a & b, conds)) if conds else df
    return R.common_filters(d, borough=borough, room_type=room_type, price_max=price_max, min_rating=min_rating)


def location_search(df: DataFrame, **kw) -> DataFrame:
    """Q9: proximity filters + summary."""
    return R.summary_stats(_location_filtered(df, **kw), PRICE, RATING, REVENUE)


def location_search_top(df: DataFrame, top_n: int, sort_by: str = REVENUE, **kw) -> DataFrame:
    """Q9: the optional top matches by a sort column."""
    _require(df, sort_by)
    d = _location_filtered(df, **kw)
    return R.top_n(d, sort_by, top_n).select(
        "id", "borough", "property_type", "room_type", "bedrooms", F.round(PRICE, 2).alias("price"),
        F.round(RATING, 2).alias("rating"), F.round(REVENUE, 2).alias("revenue"), "dist_subway_km",
        "subway_lines_500m", "crime_count_500m")


def location_impact(df: DataFrame, feature: str, threshold: float, borough=None) -> DataFrame:
    """Q10: split on a threshold (<= / >) and compare; an empty side has n = 0."""
    _require(df, feature)
    d = df.filter(F.col("borough") == borough) if borough else df
    low = F.col(feature) <= threshold
    high = F.col(feature) > threshold
    w = d.agg(*_side_stats(low, "low"), *_side_stats(high, "high"))
    rows = [F.struct(F.lit(name).alias("group"), F.lit(cond).alias("condition"), F.col(f"n_{s}").alias("n"),
                     F.col(f"price_mean_{s}").alias("price_mean"), F.col(f"rating_mean_{s}").alias("rating_mean"),
                     F.col(f"occupancy_mean_{s}").alias("occupancy_mean"),
                     F.col(f"revenue_mean_{s}").alias("revenue_mean"))
            for name, s, cond in [("group_low", "low", f"{feature} <= {threshold}"),
                                  ("group_high", "high", f"{feature} > {threshold}")]]
    return w.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
