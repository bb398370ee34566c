"""Registered queries: data-quality checks (G1-G6) and sources/sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.operators import quality as Q
from lodgelens.operators import relational as R
from lodgelens.plans import features as FE
from lodgelens.plans.listing_tables import listing_base
from lodgelens.plans.registry import query
from lodgelens.plans.suite_features import feature_matrix, panel
from lodgelens.sources import catalog, io
from lodgelens.sources.tables import table

_REQ = ["property_type", "bathrooms_text", "amenities", "host_is_superhost", "host_response_time",
        "host_response_rate", "host_acceptance_rate", "host_identity_verified", "review_scores_rating",
        "instant_bookable", "license", "estimated_occupancy_l365d", "estimated_revenue_l365d"]


@query("require_columns", " UNION ALL ".join(
    (f"SELECT '{c}' AS column, true AS present, count({c}) AS non_null FROM fx_listings"
     if c not in ("estimated_occupancy_l365d", "estimated_revenue_l365d")
     else f"SELECT '{c}' AS column, false AS present, CAST(0 AS BIGINT) AS non_null") for c in _REQ))
def require_columns(spark, sf):
    """G1: required listing columns present (the two *_l365d names are
    missing in the fixture and reported as such)."""
    return Q.require_columns(catalog.fx_listings(spark, sf), _REQ)


@query("assert_no_nulls", "SELECT " + " + ".join(f"(count(*) - count({c}))" for c in FE.ALL_FEATURES)
       + " AS n_null, count(*) AS n_rows, (" + " + ".join(f"(count(*) - count({c}))" for c in FE.ALL_FEATURES)
       + ") = 0 AS ok FROM feature_matrix")
def assert_no_nulls(spark, sf):
    """No nulls left in the model features."""
    return Q.count_nulls(feature_matrix(spark, sf), FE.ALL_FEATURES)


@query("assert_median", """
SELECT round(quantile_cont(price_numeric, 0.5), 6) AS median,
       abs(quantile_cont(price_numeric, 0.5) - 222) < 30 AS ok FROM panel WHERE month = 11
""")
def assert_median(spark, sf):
    """November median near the expected value."""
    return Q.median_within(panel(spark, sf).filter(F.col("month") == 11), "price_numeric", 222.0, 30.0)


_STATIC = ["accommodates", "bedrooms", "amenity_count", "dist_subway_km", "review_scores_rating", "seasonal_index"]


@query("static_features_constant", " UNION ALL ".join(f"""
SELECT '{c}' AS column, CAST(count_if(n > 1) AS BIGINT) AS n_varying
FROM (SELECT id, count(DISTINCT {c}) AS n FROM panel GROUP BY id)""" for c in _STATIC))
def static_features_constant(spark, sf):
    """Static features must not vary across a listing's months
    (seasonal_index does, as a control)."""
    return Q.constant_within_key(panel(spark, sf), "id", _STATIC)


@query("placeholder_audit", """
SELECT max(price_numeric) AS max_value,
       CAST(count_if(price_numeric = (SELECT max(price_numeric) FROM fx_monthly_prices)) AS BIGINT) AS n_at_max,
       count(price_numeric) AS n, round(quantile_cont(price_numeric, 0.97), 6) AS p97,
       round(quantile_cont(price_numeric, 0.98), 6) AS p98, round(quantile_cont(price_numeric, 0.99), 6) AS p99
FROM fx_monthly_prices
""")
def placeholder_audit(spark, sf):
    """G5."""
    return Q.placeholder_audit(catalog.fx_monthly_prices(spark, sf), "price_numeric")


@query("missing_attribution", """
SELECT CAST(count_if(price_numeric IS NULL) AS BIGINT) AS n_missing,
       round(avg(CAST(minimum_nights >= 28 AS INTEGER)) FILTER (WHERE price_numeric IS NULL) * 100, 6) AS pct_long_missing,
       CAST(count_if(price_numeric IS NOT NULL) AS BIGINT) AS n_present,
       round(avg(CAST(minimum_nights >= 28 AS INTEGER)) FILTER (WHERE price_numeric IS NOT NULL) * 100, 6) AS pct_long_present
FROM fx_snapshots
""")
def missing_attribution(spark, sf):
    """G6."""
    return Q.missing_attribution(catalog.fx_snapshots(spark, sf), "price_numeric", "minimum_nights")


@query("snapshot_coverage", """
SELECT snapshot, count(*) AS n, round(avg(CAST(price_numeric IS NOT NULL AS INTEGER)) * 100, 6) AS pct_priced
FROM fx_snapshots GROUP BY snapshot
""")
def snapshot_coverage(spark, sf):
    """Computed per snapshot instead of a literal table."""
    return Q.snapshot_coverage(catalog.fx_snapshots(spark, sf), "snapshot", "price_numeric")


@query("scan_pruned", "SELECT o_custkey AS listing_id, CAST(o_orderdate AS DATE) AS date FROM orders "
       "WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def scan_pruned(spark, sf):
    """S3: two columns of a wide table with a pushed-down date predicate."""
    o = table(spark, sf, "orders")
    return o.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        F.col("o_custkey").alias("listing_id"), F.col("o_orderdate").cast("date").alias("date"))


@query("scan_dates", """
SELECT review_id, date, CAST(year(date) AS INTEGER) AS year FROM fx_reviews
""")
def scan_dates(spark, sf):
    """Dates parsed at scan time."""
    r = catalog.fx_reviews(spark, sf)
    return r.select("review_id", F.to_date("date").alias("date"), F.year("date").cast("int").alias("year"))


@query("scan_reviews", """
SELECT review_id, listing_id, comments FROM fx_comments WHERE language = 'en' AND comments IS NOT NULL
""")
def scan_reviews(spark, sf):
    """Language predicate and null drop pushed to the scan."""
    c = catalog.fx_comments(spark, sf)
    return c.filter((F.col("language") == "en") & F.col("comments").isNotNull()).select(
        "review_id", "listing_id", "comments")


@query("sink_roundtrip", "SELECT * FROM listing_base")
def sink_roundtrip(spark, sf):
    """Write to Parquet in the shared folder and read back."""
    path = io.write_parquet(listing_base(spark, sf), io.scratch_path(spark, "listing_base"))
    return spark.read.parquet(path)


@query("scan_csv", "SELECT doc_id, text, lang FROM documents")
def scan_csv(spark, sf):
    """Gzip CSV with quoted newlines, read back with a declared schema."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = io.scratch_path(spark, "documents_csv")
    io.write_csv(docs, path, compression="gzip")
    return io.scan_csv(spark, path, "doc_id long, text string, lang string", multiline=True)


@query("scan_csv_plain", "SELECT id, borough, room_type, neighbourhood, price_numeric, review_scores_rating FROM listing_base")
def scan_csv_plain(spark, sf):
    """Plain CSV, split among tasks, read back with a declared schema."""
    cols = listing_base(spark, sf).select("id", "borough", "room_type", "neighbourhood", "price_numeric", "review_scores_rating")
    path = io.write_csv(cols, io.scratch_path(spark, "listings_csv"))
    return io.scan_csv(spark, path, cols.schema)


_EXPORT = ["id", "borough", "room_type", "neighbourhood", "price_numeric", "accommodates", "bedrooms", "review_scores_rating"]


@query("export_csv", f"""
SELECT {", ".join(_EXPORT)} FROM listing_base
WHERE borough IN ('ASIA', 'EUROPE') AND room_type IN ('Private room', 'Entire home/apt') AND price_numeric <= 1500
""")
def export_csv(spark, sf):
    """The filtered selection's shown columns written as CSV for download, read back."""
    d = R.common_filters(listing_base(spark, sf), price_max=1500).filter(
        F.col("borough").isin("ASIA", "EUROPE") & F.col("room_type").isin("Private room", "Entire home/apt")).select(*_EXPORT)
    return io.scan_csv(spark, io.write_csv(d, io.scratch_path(spark, "export_csv")), d.schema)


@query("scan_snapshots", "SELECT snapshot, count(*) AS n FROM fx_snapshots GROUP BY snapshot")
def scan_snapshots(spark, sf):
    """Several gzip snapshot files read in one scan; the snapshot date comes
    from each file's name and must equal the snapshot it was written from."""
    snaps = catalog.fx_snapshots(spark, sf).withColumn("d", F.date_format("snapshot", "yyyy-MM-dd"))
    base = io.scratch_path(spark, "snapshots")
    io.write_csv(snaps.drop("snapshot"), base, partition_by=["d"], compression="gzip")
    df = io.scan_snapshots(spark, f"{base}/d=*/*.csv.gz", "id long, price_numeric double, minimum_nights int")
    return df.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))


@query("decode_words", """
WITH t AS (SELECT doc_id, '[' || array_to_string(list_transform(
             list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' +'), lambda x: x <> ''),
             lambda w: '''' || w || ''''), ', ') || ']' AS words FROM documents)
SELECT doc_id, words, array_to_string(CAST(json(replace(words, '''', '"')) AS VARCHAR[]), '|') AS decoded FROM t
""")
def decode_words(spark, sf):
    """List text "['a', 'b']" decoded to an array (built from the words of each document)."""
    d = table(spark, sf, "documents")
    words = F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), " +"), lambda w: w != "")
    t = d.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform(words, lambda w: F.concat(
        F.lit("'"), w, F.lit("'"))), ", "), F.lit("]")).alias("words"))
    return t.select("doc_id", "words", F.array_join(io.decode_list_text("words"), "|").alias("decoded"))
