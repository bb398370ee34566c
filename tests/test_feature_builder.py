"""The feature builder's reference subsets and categories are arguments."""

from pyspark.sql import functions as F

from lodgelens.operators import spatial as G
from lodgelens.plans import features as FE
from lodgelens.plans import questions as Q
from lodgelens.sources import catalog


def test_subsets_and_categories(spark, sf):
    lst, st, pts, arr = (f(spark, sf) for f in (catalog.fx_listings, catalog.fx_stations, catalog.fx_points, catalog.fx_arrests))
    m = FE.build_features(lst, st, pts, arr, boroughs=["ASIA", "EUROPE"], property_types=["Hotel room"], tourist_domains=["ECONOMY"], rail_flag=0)
    assert [c for c in m.columns if c.startswith(("boro_", "prop_"))] == ["boro_ASIA", "boro_EUROPE", "prop_Hotel_room"]
    probes = m.select("id", "latitude", "longitude")
    want = {r["id"]: r["n"] for r in G.radius_counts(probes, pts.where("domain = 'ECONOMY'"), {"n": 0.5}).collect()}
    rail = {r["id"]: r["n"] for r in G.radius_counts(probes, st.where("cbd = 0"), {"n": 1.60934}).collect()}
    rows = m.collect()
    assert rows and all(r["tourist_poi_500m"] == want[r["id"]] and r["lirr_count_1mi"] == rail[r["id"]] for r in rows)
    decoded = {(r["borough"], r["property_type"]) for r in Q.decode_panel(m.drop("borough")).where(F.col("boro_ASIA") == 1).collect()}
    assert {b for b, _ in decoded} <= {"ASIA"} and {p for _, p in decoded} <= {"Hotel_room", "Hotel room", None}
