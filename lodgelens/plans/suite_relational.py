"""Registered queries: filters, joins, aggregates, windows, sorts, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.operators import relational as R
from lodgelens.plans.listing_tables import listing_base, parsed_listings
from lodgelens.plans.registry import query
from lodgelens.sources import catalog


@query("median_by_group", """
SELECT borough, quantile_cont(price_numeric, 0.5) AS median_price, count(*) AS n
FROM listing_base WHERE borough IS NOT NULL GROUP BY borough
""")
def median_by_group(spark, sf):
    """A1 (+P1, F1): median short-stay price by borough (exact, and no task
    holds a hot borough's whole value map)."""
    return R.median_and_count(listing_base(spark, sf), "borough", "price_numeric", "median_price", "n")


# ----------------------------------------------------------------- filters

@query("short_stay_filter", """
SELECT id, price_numeric, minimum_nights FROM listing_base
""")
def short_stay_filter(spark, sf):
    """P1."""
    return listing_base(spark, sf).select("id", "price_numeric", "minimum_nights")


@query("drop_missing_coords", """
SELECT ref_id, latitude, longitude FROM fx_points WHERE latitude IS NOT NULL AND longitude IS NOT NULL
""")
def drop_missing_coords(spark, sf):
    """P2."""
    return R.drop_missing(catalog.fx_points(spark, sf), ["latitude", "longitude"]).select(
        "ref_id", "latitude", "longitude")


@query("isin_filter", """
SELECT id, room_type FROM listing_base WHERE room_type IN ('Private room', 'Entire home/apt')
""")
def isin_filter(spark, sf):
    """P3."""
    return R.isin_filter(listing_base(spark, sf), "room_type", ["Private room", "Entire home/apt"]).select(
        "id", "room_type")


@query("exclude_years", """
SELECT review_id, CAST(year(date) AS INTEGER) AS year FROM fx_reviews
WHERE NOT coalesce(year(date) IN (1996, 1997), false)
""")
def exclude_years(spark, sf):
    """Drop given years, keep rows whose year is unknown."""
    r = catalog.fx_reviews(spark, sf).withColumn("year", F.year("date").cast("int"))
    return R.exclude_values(r, "year", [1996, 1997]).select("review_id", "year")


@query("month_between", """
SELECT id, month, price_numeric FROM fx_monthly_prices WHERE month BETWEEN 4 AND 11
""")
def month_between(spark, sf):
    """P5."""
    return R.between_filter(catalog.fx_monthly_prices(spark, sf), "month", 4, 11)


@query("price_cap", """
SELECT id, month, price_numeric FROM fx_monthly_prices WHERE price_numeric > 0 AND price_numeric <= 2000
""")
def price_cap(spark, sf):
    """P6."""
    return R.price_cap(catalog.fx_monthly_prices(spark, sf), "price_numeric", 2000.0)


@query("percentile_cap", """
SELECT id, price_numeric FROM listing_base
WHERE price_numeric <= (SELECT quantile_cont(price_numeric, 0.99) FROM listing_base)
""")
def percentile_cap(spark, sf):
    """Keep rows at or below the table's 99th percentile."""
    return R.percentile_cap(listing_base(spark, sf).select("id", "price_numeric"), "price_numeric", 0.99)


@query("safe_area", """
SELECT id, estimated_occupancy FROM listing_base
WHERE estimated_occupancy < (SELECT quantile_cont(estimated_occupancy, 0.25) FROM listing_base)
""")
def safe_area(spark, sf):
    """Metric below its own 25th percentile."""
    return R.percentile_cap(listing_base(spark, sf).select("id", "estimated_occupancy"),
                            "estimated_occupancy", 0.25, keep_below=True)


@query("common_filters", """
SELECT id, borough, room_type, price_numeric, review_scores_rating FROM listing_base
WHERE borough = 'EUROPE' AND room_type = 'Private room' AND price_numeric <= 2000
  AND price_numeric >= 100 AND review_scores_rating >= 3.5
""")
def common_filters(spark, sf):
    """P8."""
    return R.common_filters(listing_base(spark, sf), borough="EUROPE", room_type="Private room",
                            price_max=2000, price_min=100, min_rating=3.5).select(
        "id", "borough", "room_type", "price_numeric", "review_scores_rating")


@query("project_rename", """
SELECT id, price_numeric AS nightly_price, borough, '2025-11' AS snapshot FROM listing_base
""")
def project_rename(spark, sf):
    """P10: projection, rename, drop, literal column."""
    df = listing_base(spark, sf).withColumnRenamed("price_numeric", "nightly_price")
    keep = R.existing_columns(df, ["id", "nightly_price", "borough", "not_a_column"])
    return df.select(*keep).withColumn("snapshot", F.lit("2025-11"))


# ------------------------------------------------------------------- joins

@query("left_join_extra", """
SELECT l.id, l.borough, r.n_reviews
FROM listing_base l LEFT JOIN (SELECT listing_id, count(*) AS n_reviews FROM fx_reviews GROUP BY listing_id) r
  ON l.id = r.listing_id
""")
def left_join_extra(spark, sf):
    """J1."""
    counts = catalog.fx_reviews(spark, sf).groupBy(F.col("listing_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_reviews"))
    return listing_base(spark, sf).select("id", "borough").join(counts, "id", "left")


@query("inner_join_features", """
SELECT l.id, p.month, p.price_numeric AS month_price, l.borough
FROM listing_base l JOIN fx_monthly_prices p ON l.id = p.id
""")
def inner_join_features(spark, sf):
    """J2."""
    p = catalog.fx_monthly_prices(spark, sf).withColumnRenamed("price_numeric", "month_price")
    return listing_base(spark, sf).select("id", "borough").join(p, "id")


@query("topics_join_features", """
WITH m AS (SELECT listing_id, topic, count(*) AS n FROM fx_comment_topics GROUP BY ALL),
     mode AS (SELECT listing_id, arg_max(topic, n * 100 - topic) AS dominant_topic FROM m GROUP BY listing_id)
SELECT l.id, l.price_numeric, mode.dominant_topic
FROM listing_base l JOIN mode ON l.id = mode.listing_id
""")
def topics_join_features(spark, sf):
    """Different key names on the two sides."""
    mode = R.mode_per_key(catalog.fx_comment_topics(spark, sf), "listing_id", "topic", "dominant_topic")
    lb = listing_base(spark, sf)
    return lb.join(mode, lb.id == mode.listing_id).select("id", "price_numeric", "dominant_topic")


@query("semi_join_ids", """
SELECT * FROM fx_monthly_prices WHERE id IN (SELECT id FROM listing_base)
""")
def semi_join_ids(spark, sf):
    """J4."""
    return R.semi_join(catalog.fx_monthly_prices(spark, sf), listing_base(spark, sf), "id")


@query("anti_join_missing", """
SELECT review_id, listing_id FROM fx_reviews WHERE listing_id NOT IN (SELECT id FROM listing_base)
""")
def anti_join_missing(spark, sf):
    """Reviews of listings that are not kept."""
    return R.anti_join(catalog.fx_reviews(spark, sf).select("review_id", "listing_id"),
                       listing_base(spark, sf), "listing_id", "id")


# -------------------------------------------------------------- aggregates

@query("multi_agg_by_group", """
SELECT room_type, quantile_cont(price_numeric, 0.5) AS median_price, count(*) AS n
FROM listing_base WHERE room_type IS NOT NULL GROUP BY room_type
""")
def multi_agg_by_group(spark, sf):
    """A2."""
    return R.median_and_count(listing_base(spark, sf), "room_type", "price_numeric", "median_price", "n")


@query("group_aggregate", """
SELECT property_type, round(avg(review_scores_rating), 3) AS value
FROM listing_base WHERE property_type IS NOT NULL GROUP BY property_type
""")
def group_aggregate(spark, sf):
    """A3/Q4: mean rating by property type, 3 dp."""
    return R.group_aggregate(listing_base(spark, sf), "property_type", "review_scores_rating", "mean").withColumn(
        "value", F.round("value", 3))


@query("group_aggregate_median", """
SELECT borough, round(quantile_cont(estimated_revenue, 0.5), 3) AS value
FROM listing_base WHERE borough IS NOT NULL GROUP BY borough
""")
def group_aggregate_median(spark, sf):
    """A3/Q4 with the median aggregation."""
    return R.group_aggregate(listing_base(spark, sf), "borough", "estimated_revenue", "median").withColumn(
        "value", F.round("value", 3))


@query("count_by_group", """
SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, count(*) AS n
FROM fx_reviews GROUP BY ALL
""")
def count_by_group(spark, sf):
    """A4: rows per (year, month)."""
    r = catalog.fx_reviews(spark, sf)
    return r.groupBy(F.year("date").cast("int").alias("year"), F.month("date").cast("int").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


@query("value_counts", """
SELECT neighbourhood, count(*) AS n FROM listing_base WHERE neighbourhood IS NOT NULL
GROUP BY neighbourhood ORDER BY n DESC, neighbourhood LIMIT 10
""")
def value_counts(spark, sf):
    """Top 10 values."""
    return R.value_counts(listing_base(spark, sf), "neighbourhood", 10)


@query("value_share", """
SELECT room_type, count(*) AS n, count(*) * 100E0 / sum(count(*)) OVER () AS pct
FROM listing_base WHERE room_type IS NOT NULL GROUP BY room_type
""")
def value_share(spark, sf):
    """A7."""
    return R.value_share(listing_base(spark, sf), "room_type")


@query("distinct_count", """
SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT listing_id) AS n_listings,
       count(DISTINCT reviewer_id) AS n_reviewers
FROM fx_reviews GROUP BY ALL
""")
def distinct_count(spark, sf):
    """A8."""
    r = catalog.fx_reviews(spark, sf)
    return r.groupBy(F.year("date").cast("int").alias("year")).agg(
        F.count_distinct("listing_id").alias("n_listings"), F.count_distinct("reviewer_id").alias("n_reviewers"))


@query("conditional_share", """
SELECT borough, CAST(count_if(minimum_nights >= 28) AS BIGINT) AS n_long,
       round(avg(CAST(minimum_nights >= 28 AS INTEGER)) * 100, 6) AS pct_long
FROM parsed_listings WHERE borough IS NOT NULL GROUP BY borough
""")
def conditional_share(spark, sf):
    """Count and percent of long-stay listings by borough."""
    return R.group_agg(parsed_listings(spark, sf), "borough",
                       F.count_if(F.col("minimum_nights") >= 28).alias("n_long"),
                       F.round(F.avg((F.col("minimum_nights") >= 28).cast("int")) * 100, 6).alias("pct_long"))


@query("describe_column", """
SELECT count(price_numeric) AS count, round(avg(price_numeric), 3) AS mean,
       round(stddev_samp(price_numeric), 3) AS std, round(min(price_numeric), 3) AS min,
       round(quantile_cont(price_numeric, 0.25), 3) AS p25, round(quantile_cont(price_numeric, 0.5), 3) AS median,
       round(quantile_cont(price_numeric, 0.75), 3) AS p75, round(max(price_numeric), 3) AS max
FROM listing_base WHERE borough = 'ASIA'
""")
def describe_column(spark, sf):
    """A10/Q3: describe one numeric column under filters."""
    return R.describe(R.common_filters(listing_base(spark, sf), borough="ASIA"), "price_numeric")


_DESC_COLS = ["price_numeric", "accommodates", "bedrooms", "review_scores_rating"]


@query("describe_table", " UNION ALL ".join(f"""
SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
       round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS p75,
       round(CAST(max({c}) AS DOUBLE), 6) AS max
FROM listing_base""" for c in _DESC_COLS))
def describe_table(spark, sf):
    """A10: describe several columns in one pass."""
    return R.describe_table(listing_base(spark, sf), _DESC_COLS)


@query("describe_categorical", """
SELECT property_type, count(*) AS n, (SELECT count(DISTINCT property_type) FROM listing_base) AS unique
FROM listing_base WHERE property_type IS NOT NULL
GROUP BY property_type ORDER BY n DESC, property_type LIMIT 20
""")
def describe_categorical(spark, sf):
    """A11/Q3 non-numeric branch."""
    return R.describe_categorical(listing_base(spark, sf), "property_type", 20)


_QS = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query("quantiles", " UNION ALL ".join(
    f"SELECT {q}E0 AS q, quantile_cont(price_numeric, {q}) AS value FROM listing_base" for q in _QS))
def quantiles(spark, sf):
    """A quantile vector in one aggregate, returned long."""
    one = R.exact_quantiles(listing_base(spark, sf), "price_numeric", _QS)
    rows = [F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("value")) for i, q in enumerate(_QS)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_AUDIT = ["price", "bedrooms", "beds", "review_scores_rating", "host_response_rate", "host_is_superhost",
          "bathrooms_text", "amenities", "license"]


@query("null_audit", " UNION ALL ".join(f"""
SELECT '{c}' AS column, count(*) - count({c}) AS n_null,
       round((count(*) - count({c})) * 100E0 / count(*), 6) AS pct_null FROM fx_listings""" for c in _AUDIT))
def null_audit(spark, sf):
    """A13."""
    return R.null_audit(catalog.fx_listings(spark, sf), _AUDIT)


_SUMMARY_SQL = """
SELECT count(*) AS count, round(quantile_cont(price_numeric, 0.5), 2) AS price_median,
       round(avg(price_numeric), 2) AS price_mean, round(avg(review_scores_rating), 2) AS rating_mean,
       round(quantile_cont(estimated_revenue, 0.5), 2) AS revenue_median
FROM listing_base"""


@query("summary_stats", _SUMMARY_SQL)
def summary_stats(spark, sf):
    """A14."""
    return R.summary_stats(listing_base(spark, sf))


@query("summary_stats_empty", _SUMMARY_SQL + " WHERE price_numeric < 0")
def summary_stats_empty(spark, sf):
    """A14 on an empty selection: one row, count = 0."""
    return R.summary_stats(listing_base(spark, sf).filter(F.col("price_numeric") < 0))


_SCORES = ["review_scores_rating", "review_scores_cleanliness", "review_scores_location"]


@query("mean_matrix", " UNION ALL ".join(f"""
SELECT borough, '{c}' AS column, round(avg({c}), 6) AS mean FROM listing_base
WHERE borough IS NOT NULL GROUP BY borough""" for c in _SCORES))
def mean_matrix(spark, sf):
    """Mean of several columns per key, long form."""
    return R.mean_matrix(listing_base(spark, sf), "borough", _SCORES)


_FLAGS = ["has_wifi", "has_kitchen", "has_gym", "has_pool", "has_washer", "has_dryer"]


@query("flag_prevalence", " UNION ALL ".join(f"""
SELECT '{c}' AS column, round(avg({c}), 6) AS mean FROM listing_base""" for c in _FLAGS))
def flag_prevalence(spark, sf):
    """Share of listings with each flag."""
    return R.mean_matrix(listing_base(spark, sf), None, _FLAGS)


@query("mode_per_key", """
WITH m AS (SELECT listing_id, topic, count(*) AS n FROM fx_comment_topics GROUP BY ALL)
SELECT listing_id, arg_max(topic, n * 100 - topic) AS mode FROM m GROUP BY listing_id
""")
def mode_per_key(spark, sf):
    """Most frequent topic per listing, ties -> smallest topic."""
    return R.mode_per_key(catalog.fx_comment_topics(spark, sf), "listing_id", "topic")


_EDGES = [0, 75, 150, 250, 500, 10000]
_LABELS = ["<$75", "$75-150", "$150-250", "$250-500", "$500+"]


@query("error_by_bucket", """
WITH e AS (SELECT true_price, abs(pred_price - true_price) AS abs_err,
       CASE WHEN true_price > 0 AND true_price <= 75 THEN '<$75'
            WHEN true_price > 75 AND true_price <= 150 THEN '$75-150'
            WHEN true_price > 150 AND true_price <= 250 THEN '$150-250'
            WHEN true_price > 250 AND true_price <= 500 THEN '$250-500'
            WHEN true_price > 500 AND true_price <= 10000 THEN '$500+' END AS bucket
       FROM fx_predictions)
SELECT bucket, count(abs_err) AS count, round(avg(abs_err), 4) AS mae,
       round(avg(abs_err / true_price) * 100, 4) AS mape
FROM e WHERE bucket IS NOT NULL GROUP BY bucket
""")
def error_by_bucket(spark, sf):
    """Error report by price bucket, empty buckets omitted."""
    from lodgelens.functions import scalar as S
    e = catalog.fx_predictions(spark, sf).select(
        "true_price", S.abs_error("true_price", "pred_price").alias("abs_err"),
        S.cut_bins("true_price", _EDGES, _LABELS).alias("bucket"))
    return R.group_agg(e, "bucket", F.count("abs_err").alias("count"), F.round(F.avg("abs_err"), 4).alias("mae"),
                       F.round(F.avg(F.col("abs_err") / F.col("true_price")) * 100, 4).alias("mape"))


_RF_EDGES = [0, 5, 10, 15, 20, 25, 35, 45, 55, 65, 75, 85, 95, 100]
_RF_LABELS = ["1-5", "6-10", "11-15", "16-20", "21-25", "26-35", "36-45", "46-55", "56-65", "66-75",
              "76-85", "86-95", "96-100", "100+"]


def _rf_sql() -> str:
    bins = " UNION ALL ".join(
        f"SELECT {i} AS bin_order, '{lab}' AS bin, {lo} AS lo, "
        + (f"{hi}" if hi is not None else "(SELECT max(n) FROM per)") + " AS hi"
        for i, (lab, lo, hi) in enumerate(zip(_RF_LABELS, _RF_EDGES, _RF_EDGES[1:] + [None])))
    return f"""
WITH per AS (SELECT reviewer_id, count(*) AS n FROM fx_reviews GROUP BY reviewer_id),
     bins AS ({bins}),
     c AS (SELECT b.bin_order, b.bin, count(per.n) AS num_reviewers
           FROM bins b LEFT JOIN per ON per.n > b.lo AND per.n <= b.hi GROUP BY b.bin_order, b.bin)
SELECT CAST(bin_order AS INTEGER) AS bin_order, bin, num_reviewers,
       round(num_reviewers * 100E0 / sum(num_reviewers) OVER (), 2) AS percentage,
       (SELECT round(count_if(n > 1) * 100E0 / count(*), 6) FROM per) AS pct_multi
FROM c
"""


@query("reviewer_frequency", _rf_sql())
def reviewer_frequency(spark, sf):
    """Reviews per reviewer, share with more than one, binned histogram
    (all bins reported, empty ones with 0; last edge = the maximum count)."""
    from lodgelens.functions import scalar as S
    per = catalog.fx_reviews(spark, sf).groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("n"))
    stats = per.agg(F.max("n").alias("_max"),
                    F.round(F.count_if(F.col("n") > 1) * 100.0 / F.count(F.lit(1)), 6).alias("pct_multi"))
    binned = per.crossJoin(F.broadcast(stats)).withColumn(
        "bin_order", F.coalesce(S.cut_order("n", _RF_EDGES), F.when(F.col("n") > 100, F.lit(len(_RF_LABELS) - 1))))
    counts = binned.groupBy("bin_order").agg(F.count(F.lit(1)).alias("num_reviewers"))
    spark_ = per.sparkSession
    bins = spark_.createDataFrame([(i, lab) for i, lab in enumerate(_RF_LABELS)], "bin_order int, bin string")
    full = bins.join(F.broadcast(counts), "bin_order", "left").fillna(0, ["num_reviewers"])
    total = full.agg(F.sum("num_reviewers").alias("_t"))
    return full.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(stats.select("pct_multi"))).select(
        "bin_order", "bin", "num_reviewers",
        F.round(F.col("num_reviewers") * 100.0 / F.col("_t"), 2).alias("percentage"), "pct_multi")


@query("correlate_pair", """
WITH s AS (SELECT price_numeric AS a, review_scores_rating AS b FROM listing_base
           WHERE price_numeric IS NOT NULL AND review_scores_rating IS NOT NULL),
     r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2E0 AS ra,
                  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2E0 AS rb FROM s)
SELECT count(*) AS n, round(corr(a, b), 4) AS pearson, round(corr(ra, rb), 4) AS spearman FROM r
""")
def correlate_pair(spark, sf):
    """Pearson and Spearman of price and rating."""
    return R.pearson_spearman(listing_base(spark, sf), "price_numeric", "review_scores_rating")


_CORR_COLS = ["price_numeric", "accommodates", "amenity_count", "availability_365", "estimated_revenue"]


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@query("corr_matrix", " UNION ALL ".join(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM listing_base""" for a, b in _pairs(_CORR_COLS)))
def corr_matrix(spark, sf):
    """A27 Pearson: all pairs in one aggregate, then long form."""
    df = listing_base(spark, sf)
    pairs = _pairs(_CORR_COLS)
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "r")
    return long.select(F.split("pair", r"\|")[0].alias("col_a"), F.split("pair", r"\|")[1].alias("col_b"),
                       F.round("r", 6).alias("r"))


def _rank_sql(cols, src):
    rk = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2E0 AS {c}" for c in cols)
    return f"SELECT {rk} FROM {src}"


@query("spearman_matrix", f"WITH rk AS ({_rank_sql(_CORR_COLS, 'listing_base')})\n" + " UNION ALL ".join(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM rk""" for a, b in _pairs(_CORR_COLS)))
def spearman_matrix(spark, sf):
    """A27 Spearman: each pair ranked over its complete rows, one rank pass."""
    return R.spearman_pairs(listing_base(spark, sf), _pairs(_CORR_COLS)).withColumn("r", F.round("r", 6))


_TARGET_COLS = ["accommodates", "amenity_count", "availability_365", "estimated_revenue", "number_of_reviews",
                "estimated_occupancy", "minimum_nights"]


@query("corr_with_target",
       f"WITH rk AS ({_rank_sql(_TARGET_COLS + ['price_numeric'], 'listing_base')}),\n c AS ("
       + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, price_numeric)) AS abs_r FROM rk"
                            for c in _TARGET_COLS)
       + ")\nSELECT feature, round(abs_r, 6) AS abs_r FROM c ORDER BY abs_r DESC, feature LIMIT 20")
def corr_with_target(spark, sf):
    """|Spearman| of every feature with the target, top 20."""
    r = R.spearman_pairs(listing_base(spark, sf), [(c, "price_numeric") for c in _TARGET_COLS])
    long = r.select(F.col("col_a").alias("feature"), F.abs("r").alias("abs_r"))
    return long.orderBy(F.desc("abs_r"), "feature").limit(20).withColumn("abs_r", F.round("abs_r", 6))


_NULL_COLS = ["bathrooms", "review_scores_rating", "host_response_rate_f", "estimated_revenue", "price_numeric"]


@query("spearman_complete_pairs", " UNION ALL ".join(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT count(*) FROM listing_base WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr(ra, rb), 6) AS r
FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2E0 AS ra,
             rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2E0 AS rb
      FROM listing_base WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in _pairs(_NULL_COLS)))
def spearman_complete_pairs(spark, sf):
    """A27 on columns with nulls: every pair over its own complete rows."""
    df = listing_base(spark, sf)
    n = df.agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"{a}|{b}") for a, b in _pairs(_NULL_COLS)])
    n = n.unpivot([], [f"`{a}|{b}`" for a, b in _pairs(_NULL_COLS)], "pair", "n")
    n = n.select(F.split("pair", r"\|")[0].alias("col_a"), F.split("pair", r"\|")[1].alias("col_b"), "n")
    return R.spearman_pairs(df, _pairs(_NULL_COLS)).withColumn("r", F.round("r", 6)).join(n, ["col_a", "col_b"]).select("col_a", "col_b", "n", "r")


_CONTRIB = ["c_discount", "c_tax", "c_quantity"]


@query("mean_abs_ranked", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(avg(abs({c})), 9) AS mean_abs FROM fx_contributions""" for c in _CONTRIB))
def mean_abs_ranked(spark, sf):
    """Mean |contribution| per feature, ranked."""
    return R.mean_abs_ranked(catalog.fx_contributions(spark, sf), _CONTRIB)


# ------------------------------------------------------------------ windows

_SHARE_SQL = """
WITH c AS (SELECT listing_id, topic, count(*) AS n FROM fx_comment_topics GROUP BY ALL)
SELECT listing_id, topic, n, n / sum(n) OVER (PARTITION BY listing_id) AS share FROM c
"""


@query("topic_proportions", _SHARE_SQL)
def topic_proportions(spark, sf):
    """Share of each topic in a listing's comments."""
    c = catalog.fx_comment_topics(spark, sf).groupBy("listing_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    return R.share_of_group(c, "listing_id", "n")


@query("top3_topics", f"""
WITH s AS ({_SHARE_SQL.strip()}),
r AS (SELECT listing_id, topic, share, row_number() OVER (PARTITION BY listing_id ORDER BY share DESC, topic) AS rank
      FROM s)
SELECT listing_id, CAST(rank AS INTEGER) AS rank, topic, round(share, 9) AS prob FROM r WHERE rank <= 3
""")
def top3_topics(spark, sf):
    """Three most probable topics per listing (ties: smaller topic)."""
    s = topic_proportions(spark, sf)
    top = R.top_per_group(s, "listing_id", [F.desc("share"), F.asc("topic")], 3)
    return top.select("listing_id", F.col("rank").cast("int").alias("rank"), "topic",
                      F.round("share", 9).alias("prob"))


@query("first_per_id", """
SELECT id, arg_min(month, month) AS month, arg_min(price_numeric, month) AS price_numeric
FROM fx_monthly_prices GROUP BY id
""")
def first_per_id(spark, sf):
    """First row per id by an explicit order (earliest month)."""
    return R.first_per_key(catalog.fx_monthly_prices(spark, sf), "id", [F.col("month")])


@query("last_turns", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
     k AS (SELECT * FROM l WHERE rn <= 6),
     fu AS (SELECT conv_id, min(turn) AS fu FROM k WHERE role = 'user' GROUP BY conv_id)
SELECT k.conv_id, k.turn, k.role, CAST(length(k.text) AS INTEGER) AS n_chars FROM k JOIN fu ON k.conv_id = fu.conv_id
WHERE k.turn >= fu.fu
""")
def last_turns(spark, sf):
    """Last 6 turns of each conversation, starting at a user turn."""
    from lodgelens.sources.tables import table
    c = table(spark, sf, "conversations")
    return R.last_turns(c, "conv_id", "turn", "role", 6).select(
        "conv_id", "turn", "role", F.length("text").alias("n_chars"))


# ---------------------------------------------------------- sorts and limits

@query("top_n", """
SELECT id, borough, estimated_revenue FROM listing_base
ORDER BY estimated_revenue DESC NULLS LAST, id LIMIT 5
""")
def top_n(spark, sf):
    """L1/Q5."""
    return R.top_n(listing_base(spark, sf), "estimated_revenue", 5).select("id", "borough", "estimated_revenue")


@query("bottom_n", """
SELECT id, review_scores_rating FROM listing_base
ORDER BY review_scores_rating ASC NULLS LAST, id LIMIT 50
""")
def bottom_n(spark, sf):
    """L1 ascending."""
    return R.top_n(listing_base(spark, sf), "review_scores_rating", 50, ascending=True).select(
        "id", "review_scores_rating")


@query("top_groups", """
SELECT neighbourhood, quantile_cont(price_numeric, 0.5) AS median_price FROM listing_base
WHERE neighbourhood IS NOT NULL GROUP BY neighbourhood ORDER BY median_price DESC, neighbourhood LIMIT 10
""")
def top_groups(spark, sf):
    """L2."""
    g = R.aggregate_by(listing_base(spark, sf), "neighbourhood", "price_numeric", "median", "median_price")
    return g.orderBy(F.desc("median_price"), "neighbourhood").limit(10)


@query("head_complete_rows", """
SELECT ref_id, domain, latitude, longitude FROM fx_points
WHERE latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY ref_id LIMIT 200
""")
def head_complete_rows(spark, sf):
    """L3."""
    return R.drop_missing(catalog.fx_points(spark, sf), ["latitude", "longitude"]).orderBy("ref_id").limit(200)


@query("seeded_sample", """
SELECT id, price_numeric FROM listing_base ORDER BY (id * 7919 + 42 * 104729) % 1000003, id LIMIT 50
""")
def seeded_sample(spark, sf):
    """L4."""
    return R.seeded_sample(listing_base(spark, sf).select("id", "price_numeric"), 50, 42)


@query("distinct_values", """
SELECT DISTINCT neighbourhood FROM listing_base WHERE neighbourhood IS NOT NULL
""")
def distinct_values(spark, sf):
    """L5."""
    return R.distinct_values(listing_base(spark, sf), "neighbourhood")


# ------------------------------------------------------ sets and reshaping

@query("union_slices", """
SELECT id, month, price_numeric FROM fx_monthly_prices WHERE month = 4
UNION ALL SELECT id, month, price_numeric FROM fx_monthly_prices WHERE month = 5
""")
def union_slices(spark, sf):
    """U1."""
    p = catalog.fx_monthly_prices(spark, sf)
    return p.filter("month = 4").unionByName(p.filter("month = 5").select("price_numeric", "id", "month"))


@query("union_distinct", """
SELECT room_type AS word FROM fx_listings UNION SELECT property_type FROM fx_listings
""")
def union_distinct(spark, sf):
    """Set union of two word lists."""
    lst = catalog.fx_listings(spark, sf)
    return lst.select(F.col("room_type").alias("word")).union(lst.select("property_type")).distinct()


@query("except_rows", """
SELECT id FROM fx_listings EXCEPT SELECT id FROM listing_base
""")
def except_rows(spark, sf):
    """Set difference."""
    return catalog.fx_listings(spark, sf).select("id").exceptAll(listing_base(spark, sf).select("id")).distinct()


_TOPICS = [-1, 0, 1, 2, 3]
_TNAME = {-1: "t_outlier", 0: "t0", 1: "t1", 2: "t2", 3: "t3"}


@query("pivot_counts", "SELECT listing_id, " + ", ".join(
    f"count(*) FILTER (WHERE topic = {t}) AS {_TNAME[t]}" for t in _TOPICS) + " FROM fx_comment_topics GROUP BY listing_id")
def pivot_counts(spark, sf):
    """Topic counts per listing as columns, fill 0."""
    p = R.pivot_counts(catalog.fx_comment_topics(spark, sf), "listing_id", "topic", _TOPICS)
    return p.select("listing_id", *[F.col(str(t)).alias(_TNAME[t]) for t in _TOPICS])


_ROOMS = ["Shared room", "Hotel room", "Private room", "Entire home/apt"]
_RNAME = ["shared", "hotel", "private", "entire"]


@query("crosstab_share", "SELECT borough, " + ", ".join(
    f"round(count(*) FILTER (WHERE room_type = '{r}') / count(*), 9) AS {n}" for r, n in zip(_ROOMS, _RNAME))
    + " FROM listing_base WHERE borough IS NOT NULL GROUP BY borough")
def crosstab_share(spark, sf):
    """R2: borough x room type, row-normalised."""
    lb = listing_base(spark, sf).withColumn("rt", F.regexp_replace(F.lower(F.split("room_type", " ")[0]), "/apt", ""))
    ct = R.crosstab_share(lb, "borough", "rt", _RNAME)
    return ct.select("borough", *[F.round(n, 9).alias(n) for n in _RNAME])


@query("unpivot_ratios", " UNION ALL ".join(
    f"SELECT id, '{c}' AS score, {c} AS value FROM listing_base" for c in _SCORES))
def unpivot_ratios(spark, sf):
    """R3."""
    return listing_base(spark, sf).select("id", *_SCORES).unpivot("id", _SCORES, "score", "value")


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _boro(v):
    return "boro_" + v.replace(" ", "_")


@query("one_hot", "SELECT id, " + ", ".join(
    f"CAST(coalesce(borough = '{v}', false) AS INTEGER) AS {_boro(v)}" for v in _REGIONS) + " FROM listing_base")
def one_hot(spark, sf):
    """One column per value from an explicit list (no data pass)."""
    oh = R.one_hot(listing_base(spark, sf).select("id", "borough"), "borough", _REGIONS, "boro")
    return oh.select("id", *[F.col(f"`boro_{v}`").alias(_boro(v)) for v in _REGIONS])


@query("un_one_hot", "SELECT id, CASE " + " ".join(
    f"WHEN borough = '{v}' THEN '{_boro(v)[5:]}'" for v in _REGIONS) + " END AS borough FROM listing_base")
def un_one_hot(spark, sf):
    """Name of the first maximal one-hot column, prefix stripped."""
    from lodgelens.functions import scalar as S
    oh = one_hot(spark, sf)
    cols = [_boro(v) for v in _REGIONS]
    return oh.select("id", S.strip_prefix(S.first_max_label(cols), "boro_").alias("borough"))


@query("topic_mass", f"""
WITH s AS ({_SHARE_SQL.strip()}),
w AS (SELECT listing_id, """ + ", ".join(
    f"coalesce(sum(share) FILTER (WHERE topic = {t}), 0) AS {_TNAME[t]}" for t in _TOPICS) + """ FROM s GROUP BY listing_id)
SELECT listing_id, round(t0 + t1 + t2, 9) AS mass_012,
       CAST((t0 > 0.2)::INTEGER + (t1 > 0.2)::INTEGER + (t2 > 0.2)::INTEGER + (t3 > 0.2)::INTEGER AS INTEGER) AS n_above
FROM w
""")
def topic_mass(spark, sf):
    """Row-wise sum and count-above-threshold over topic columns."""
    from lodgelens.functions import scalar as S
    s = topic_proportions(spark, sf)
    wide = s.groupBy("listing_id").pivot("topic", _TOPICS).agg(F.first("share")).fillna(0.0)
    wide = wide.select("listing_id", *[F.col(str(t)).alias(_TNAME[t]) for t in _TOPICS])
    return wide.select("listing_id", F.round(S.row_sum(["t0", "t1", "t2"]), 9).alias("mass_012"),
                       S.row_count_above(["t0", "t1", "t2", "t3"], 0.2).alias("n_above"))


@query("topic_diversity", f"""
WITH s AS ({_SHARE_SQL.strip()}),
w AS (SELECT listing_id, """ + ", ".join(
    f"coalesce(sum(share) FILTER (WHERE topic = {t}), 0) AS {_TNAME[t]}" for t in _TOPICS) + """ FROM s GROUP BY listing_id)
SELECT listing_id, CAST((t0 > 0.05)::INTEGER + (t1 > 0.05)::INTEGER + (t2 > 0.05)::INTEGER + (t3 > 0.05)::INTEGER
       AS INTEGER) AS n_topics_above_5pct FROM w
""")
def topic_diversity(spark, sf):
    """Number of topics above 5 % per listing."""
    from lodgelens.functions import scalar as S
    s = topic_proportions(spark, sf)
    wide = s.groupBy("listing_id").pivot("topic", _TOPICS).agg(F.first("share")).fillna(0.0)
    wide = wide.select("listing_id", *[F.col(str(t)).alias(_TNAME[t]) for t in _TOPICS])
    return wide.select("listing_id", S.row_count_above(["t0", "t1", "t2", "t3"], 0.05).alias("n_topics_above_5pct"))
