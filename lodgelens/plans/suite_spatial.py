"""Registered queries: spatial joins (J6-J11), near flag (P12), density grid
(Q15).  Oracles are brute force over all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.operators import spatial as G
from lodgelens.plans.listing_tables import listing_base
from lodgelens.plans.registry import query
from lodgelens.sources import catalog


def hav_sql(la1, lo1, la2, lo2) -> str:
    a = (f"(pow(sin((radians({la2}) - radians({la1})) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) "
         f"* pow(sin((radians({lo2}) - radians({lo1})) / 2), 2))")
    return f"(6371.0E0 * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


_PAIRS_ST = f"""
SELECT l.id, s.ref_id, s.cbd, s.ada, s.routes, {hav_sql('l.latitude', 'l.longitude', 's.latitude', 's.longitude')} AS d
FROM listing_base l, fx_stations s
"""
_PAIRS_PT = f"""
SELECT l.id, p.ref_id, p.domain, {hav_sql('l.latitude', 'l.longitude', 'p.latitude', 'p.longitude')} AS d
FROM listing_base l, fx_points p WHERE p.latitude IS NOT NULL AND p.longitude IS NOT NULL
"""


def _probes(spark, sf):
    return listing_base(spark, sf).select("id", "latitude", "longitude")


@query("nearest_distance", f"""
WITH p AS ({_PAIRS_ST}) SELECT id, round(min(d), 9) AS dist_subway_km FROM p GROUP BY id
""")
def nearest_distance(spark, sf):
    """Distance to the nearest station."""
    n = G.nearest(_probes(spark, sf), catalog.fx_stations(spark, sf))
    return n.select("id", F.round("dist_km", 9).alias("dist_subway_km"))


@query("nearest_attrs", f"""
WITH p AS ({_PAIRS_ST}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref_id) AS rn FROM p)
SELECT id, ref_id AS nearest_ref, cbd AS nearest_subway_cbd, ada AS nearest_subway_ada FROM r WHERE rn = 1
""")
def nearest_attrs(spark, sf):
    """Attributes of the nearest station (ties: smallest id)."""
    n = G.nearest(_probes(spark, sf), catalog.fx_stations(spark, sf), attrs=["cbd", "ada"])
    return n.select("id", F.col("ref_id").alias("nearest_ref"), F.col("cbd").alias("nearest_subway_cbd"),
                    F.col("ada").alias("nearest_subway_ada"))


@query("radius_count", f"""
WITH p AS ({_PAIRS_PT})
SELECT l.id, CAST(count(p.ref_id) AS INTEGER) AS poi_count_1km
FROM listing_base l LEFT JOIN p ON l.id = p.id AND p.d <= 1.0 GROUP BY l.id
""")
def radius_count(spark, sf):
    """Points within 1 km, zeros kept."""
    return G.radius_counts(_probes(spark, sf), catalog.fx_points(spark, sf), {"poi_count_1km": 1.0})


@query("nearest_and_count", f"""
WITH p AS ({_PAIRS_ST})
SELECT id, round(min(d), 9) AS dist_lirr_km, CAST(count_if(d <= 1.60934) AS INTEGER) AS lirr_count_1mi
FROM p GROUP BY id
""")
def nearest_and_count(spark, sf):
    """Nearest distance and 1-mile count from one candidate set."""
    probes = _probes(spark, sf)
    st = catalog.fx_stations(spark, sf)
    n = G.nearest_and_count(probes, st, 1.60934, "lirr_count_1mi")
    return n.select("id", F.round("dist_km", 9).alias("dist_lirr_km"), "lirr_count_1mi")


@query("radius_distinct", f"""
WITH p AS ({_PAIRS_ST}),
t AS (SELECT id, unnest(string_split_regex(trim(coalesce(routes, '')), '\\s+')) AS tok FROM p WHERE d <= 2.0)
SELECT l.id, CAST(count(DISTINCT nullif(t.tok, '')) AS INTEGER) AS subway_lines_2km
FROM listing_base l LEFT JOIN t ON l.id = t.id GROUP BY l.id
""")
def radius_distinct(spark, sf):
    """Distinct route letters of stations within 2 km."""
    return G.radius_distinct_tokens(_probes(spark, sf), catalog.fx_stations(spark, sf), "routes", 2.0,
                                    "subway_lines_2km")


_TOURIST = ["PROMO", "STANDARD"]


@query("radius_multi", f"""
WITH p AS ({_PAIRS_PT}),
t AS (SELECT * FROM p WHERE domain IN ('PROMO', 'STANDARD'))
SELECT l.id, CAST(count_if(t.d <= 0.5) AS INTEGER) AS tourist_poi_500m,
       CAST(count_if(t.d <= 1.0) AS INTEGER) AS tourist_poi_1km
FROM listing_base l LEFT JOIN t ON l.id = t.id GROUP BY l.id
""")
def radius_multi(spark, sf):
    """Counts over a filtered reference subset at two radii in one join."""
    pts = catalog.fx_points(spark, sf).filter(F.col("domain").isin(_TOURIST))
    return G.radius_counts(_probes(spark, sf), pts, {"tourist_poi_500m": 0.5, "tourist_poi_1km": 1.0})


@query("near_flag", f"""
WITH p AS ({_PAIRS_ST}) SELECT id, CAST(min(d) <= 0.5 AS INTEGER) AS near_subway FROM p GROUP BY id
""")
def near_flag(spark, sf):
    """P12."""
    n = G.nearest(_probes(spark, sf), catalog.fx_stations(spark, sf))
    return n.select("id", (F.col("dist_km") <= 0.5).cast("int").alias("near_subway"))


@query("density_grid", """
SELECT CAST(floor(latitude / 0.05) AS BIGINT) AS cell_y, CAST(floor(longitude / 0.05) AS BIGINT) AS cell_x,
       count(*) AS n, round(sum(price_numeric), 6) AS total, round(avg(price_numeric), 6) AS mean
FROM listing_base GROUP BY ALL
""")
def density_grid(spark, sf):
    """Q15: price-weighted grid."""
    g = G.density_grid(listing_base(spark, sf), "price_numeric", 0.05)
    return g.withColumn("total", F.round("total", 6)).withColumn("mean", F.round("mean", 6))
