"""Fixture views: the driver's tables given the shape of listing data.

The raw listing, station, point, review and prediction files of the original
project are not available, so each input the operators expect is derived from
the driver's tables by fixed modular rules (the same rules are written in SQL
for the DuckDB oracle, see ``lodgelens.plans.oracle_views``).  All views are
lazy DataFrames; joins to ``nation``/``region`` are to 25- and 5-row
dimension tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.sources.tables import table


def _case(key: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def _score(k: Column, mult: int) -> Column:
    return F.when(k % 11 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(3.0) + ((k * mult) % 200) / F.lit(100.0))


def fx_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    base = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    price = F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 50 == 1, F.lit("n/a")).otherwise(
        F.concat(F.lit("$"), (k % 3).cast("string"), F.lit(","),
                 F.lpad(((k * 37) % 1000).cast("string"), 3, "0"), F.lit(".50")))
    return base.select(
        k.alias("id"),
        F.col("r_name").alias("borough"),
        F.col("n_name").alias("neighbourhood"),
        F.col("c_mktsegment").alias("property_type"),
        _case(k % 4, {0: "Shared room", 1: "Hotel room", 2: "Private room"}, "Entire home/apt").alias("room_type"),
        (F.lit(40.5) + ((k * 7919) % 10007) / F.lit(10007.0) * F.lit(0.4)).alias("latitude"),
        (F.lit(-74.2) + ((k * 104729) % 10009) / F.lit(10009.0) * F.lit(0.5)).alias("longitude"),
        price.alias("price"),
        ((k * 7) % 60).cast("int").alias("minimum_nights"),
        (F.lit(1) + k % 6).cast("int").alias("accommodates"),
        F.when(k % 13 == 0, F.lit(None).cast("double")).otherwise((k % 5).cast("double")).alias("bedrooms"),
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise((F.lit(1) + k % 4).cast("double")).alias("beds"),
        _score(k, 1).alias("review_scores_rating"),
        _score(k, 3).alias("review_scores_accuracy"),
        _score(k, 7).alias("review_scores_cleanliness"),
        _score(k, 11).alias("review_scores_checkin"),
        _score(k, 13).alias("review_scores_communication"),
        _score(k, 17).alias("review_scores_location"),
        _score(k, 19).alias("review_scores_value"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(
            F.concat((k % 101).cast("string"), F.lit("%"))).alias("host_response_rate"),
        F.when(k % 8 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(((k * 3) % 101).cast("string"), F.lit("%"))).alias("host_acceptance_rate"),
        _case(k % 5, {0: "within an hour", 1: "Within a few hours", 2: "within a day",
                      3: "a few days or more"}).alias("host_response_time"),
        _case(k % 3, {0: "t", 1: "f"}).alias("host_is_superhost"),
        _case(k % 3, {1: "t"}, "f").alias("host_identity_verified"),
        _case(k % 2, {0: "t"}, "f").alias("instant_bookable"),
        F.when(k % 6 == 0, F.concat(F.lit("LIC-"), k.cast("string"))).alias("license"),
        _case(k % 5, {0: "Half-bath", 1: "1.5 baths", 2: "2 shared baths", 3: "Shared half-bath"}).alias("bathrooms_text"),
        _case(k % 4, {0: '["Wifi", "Hair dryer"]', 1: '["Dishwasher", "Pool", "Gym"]', 2: "not json"}).alias("amenities"),
        ((k * 13) % 366).cast("int").alias("availability_365"),
        ((k * 3) % 250).cast("int").alias("number_of_reviews"),
        (k % 40).cast("int").alias("number_of_reviews_ltm"),
        F.when(k % 10 == 0, F.lit(None).cast("double")).otherwise(((k * 3) % 500) / F.lit(100.0)).alias("reviews_per_month"),
        ((k * 29) % 256).cast("double").alias("estimated_occupancy"),
        F.col("c_acctbal").alias("estimated_revenue"),
    )


def fx_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k, nk = F.col("s_suppkey"), F.col("s_nationkey")
    return s.select(
        k.alias("ref_id"),
        (F.lit(40.5) + ((k * 6151) % 1009) / F.lit(1009.0) * F.lit(0.4)).alias("latitude"),
        (F.lit(-74.2) + ((k * 12289) % 1013) / F.lit(1013.0) * F.lit(0.5)).alias("longitude"),
        (nk % 2).cast("int").alias("cbd"),
        (nk % 3).cast("int").alias("ada"),
        _case(nk % 4, {0: "A C E", 1: "N W", 2: "7"}).alias("routes"),
    )


def fx_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("ref_id"),
        F.col("p_type").alias("domain"),
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise(
            F.lit(40.5) + ((k * 6151) % 10007) / F.lit(10007.0) * F.lit(0.4)).alias("latitude"),
        (F.lit(-74.2) + ((k * 12289) % 10009) / F.lit(10009.0) * F.lit(0.5)).alias("longitude"),
    )


def fx_monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_custkey").alias("id"), F.month("o_orderdate").cast("int").alias("month"))
            .agg((F.min("o_totalprice") / F.lit(100.0)).alias("price_numeric")))


def fx_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("listing_id"),
                    (F.col("o_orderkey") % 997).alias("reviewer_id"),
                    F.col("o_orderdate").cast("date").alias("date"))


def fx_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("review_id"), F.col("source").alias("listing_id"),
                    F.col("text").alias("comments"), F.col("lang").alias("language"))


def fx_comment_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    topic = _case(F.col("event_type"), {"error": -1, "click": 0, "view": 1, "signup": 2}, 3)
    return e.select(F.col("event_id").alias("review_id"), F.col("user_id").alias("listing_id"),
                    topic.cast("int").alias("topic"))


def fx_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    true_price = F.col("l_extendedprice") / F.lit(100.0)
    return li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.month("l_shipdate").cast("int").alias("month"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        true_price.alias("true_price"),
        (true_price * (F.lit(1.0) - F.col("l_discount") + F.col("l_tax"))).alias("pred_price"),
    )


def fx_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        (F.col("l_discount") - F.lit(0.05)).alias("c_discount"),
        (F.col("l_tax") - F.lit(0.04)).alias("c_tax"),
        ((F.col("l_quantity") - F.lit(25.0)) / F.lit(100.0)).alias("c_quantity"),
    )


def fx_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly listing snapshots: one row per order, snapshot = order month,
    price missing where the order status is 'P'."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("id"),
        F.date_trunc("month", F.col("o_orderdate")).cast("date").alias("snapshot"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price_numeric"),
        ((F.col("o_orderkey") * 7) % 60).cast("int").alias("minimum_nights"),
    )


def fx_arrests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large point set (one point per line item) for density counts."""
    li = table(spark, sf_dir, "lineitem")
    k, ln = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        (k * 10 + ln).alias("ref_id"),
        F.col("l_returnflag").alias("offense"),
        _case(ln % 6, {0: "B", 1: "M", 2: "Q", 3: "K", 4: "S"}, "X").alias("boro_letter"),
        F.when(k % 23 == 0, F.lit(None).cast("double")).otherwise(
            F.lit(40.5) + ((k * 31 + ln * 7919) % 10007) / F.lit(10007.0) * F.lit(0.4)).alias("latitude"),
        (F.lit(-74.2) + ((k * 17 + ln * 104729) % 10009) / F.lit(10009.0) * F.lit(0.5)).alias("longitude"),
    )
