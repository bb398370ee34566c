"""Grid joins equal brute force, including a hot cell that is salted."""

import numpy as np
from pyspark.sql import functions as F

from lodgelens.operators import spatial as G


def _hav(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    x = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 6371.0 * 2 * np.arctan2(np.sqrt(x), np.sqrt(1 - x))


def _points(n, seed, hot=0):
    rng = np.random.default_rng(seed)
    lat = 40.5 + rng.random(n) * 0.4
    lon = -74.2 + rng.random(n) * 0.5
    lat[:hot] = 40.7 + rng.random(hot) * 0.001  # one dense cell
    lon[:hot] = -73.9 + rng.random(hot) * 0.001
    return lat, lon


def test_radius_counts_and_nearest(spark):
    la, lo = _points(600, 1, hot=250)
    ra, ro = _points(300, 2, hot=40)
    left = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(la, lo))],
                                 "id long, latitude double, longitude double")
    right = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(ra, ro))],
                                  "ref_id long, latitude double, longitude double")
    d = _hav(la[:, None], lo[:, None], ra[None, :], ro[None, :])
    for fineness in (1, 4, 7):
        got = {r["id"]: (r["c05"], r["c2"]) for r in
               G.radius_counts(left, right, {"c05": 0.5, "c2": 2.0}, fineness=fineness).collect()}
        assert len(got) == len(la)
        for i in range(len(la)):
            assert got[i] == (int((d[i] <= 0.5).sum()), int((d[i] <= 2.0).sum()))
    near = {r["id"]: (r["ref_id"], r["dist_km"]) for r in G.nearest(left, right).collect()}
    both = {r["id"]: (r["dist_km"], r["n"]) for r in G.nearest_and_count(left, right, 1.5, "n").collect()}
    for i in range(len(la)):
        j = int(np.argmin(d[i]))
        assert near[i][0] == j and abs(near[i][1] - d[i, j]) < 1e-9
        assert abs(both[i][0] - d[i, j]) < 1e-9 and both[i][1] == int((d[i] <= 1.5).sum())


def test_nearest_far_points_resolve(spark):
    left = spark.createDataFrame([(1, 40.0, -74.0), (2, 10.0, 10.0), (3, None, 1.0)],
                                 "id long, latitude double, longitude double")
    right = spark.createDataFrame([(7, 40.001, -74.0), (8, 11.0, 10.0)], "ref_id long, latitude double, longitude double")
    got = {r["id"]: r["ref_id"] for r in G.nearest(left, right).collect()}
    assert got == {1: 7, 2: 8, 3: None}


def _frames(spark, left, right):
    return (spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(left)], "id long, latitude double, longitude double"),
            spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(right)], "ref_id long, latitude double, longitude double"))


def test_whole_globe_equals_brute_force(spark):
    """Pairs across +/-180 degrees, poles, far outliers and points spread over the globe."""
    rng = np.random.default_rng(3)
    right = [(-17.0, 179.99), (-17.01, -179.99), (89.99, 10.0), (89.98, -170.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (60.0, 25.0)]
    right += list(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, 60))), rng.uniform(-180, 180, 60)))
    left = [(-17.0, -179.995), (-17.0, 179.995), (90.0, 0.0), (-89.9, 120.0), (0.0, 179.9), (40.0, -74.0), (-45.0, -120.0)]
    left += list(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, 40))), rng.uniform(-180, 180, 40)))
    la, lo, ra, ro = (np.array(v) for v in (*zip(*left), *zip(*right)))
    d = _hav(la[:, None], lo[:, None], ra[None, :], ro[None, :])
    L, R = _frames(spark, left, right)
    near = {r["id"]: (r["ref_id"], r["dist_km"]) for r in G.nearest(L, R).collect()}
    for radius in (3.0, 50.0, 2500.0, 12_000.0):
        count = {r["id"]: r["n"] for r in G.radius_counts(L, R, {"n": radius}).collect()}
        both = {r["id"]: (r["dist_km"], r["n"]) for r in G.nearest_and_count(L, R, radius, "n").collect()}
        pairs = {(r["id"], r["ref_id"]) for r in G.candidate_pairs(L, R, radius, right_cols=["ref_id"]).collect()}
        assert pairs == set(zip(*(v.tolist() for v in np.nonzero(d <= radius))))
        for i in range(len(left)):
            n = int((d[i] <= radius).sum())
            assert count[i] == n and both[i][1] == n and abs(both[i][0] - d[i].min()) < 1e-6
    for i in range(len(left)):
        assert abs(near[i][1] - d[i].min()) < 1e-6 and abs(d[i, near[i][0]] - d[i].min()) < 1e-6


def test_one_far_outlier_and_copies_of_a_place(spark):
    right = [(40.7 + k * 1e-5, -74.0) for k in range(200)] + [(-40.0, 100.0)] + [(40.7, -74.0)] * 300
    left = [(40.7, -74.0), (40.69, -74.02), (-39.0, 100.0), (10.0, 10.0)] + [(40.7, -74.0)] * 50
    L, R = _frames(spark, left, right)
    near = {r["id"]: r["ref_id"] for r in G.nearest(L, R).collect()}
    assert near[0] == 0 and near[53] == 0 and near[2] == 200
    assert {r["n"] for r in G.radius_counts(L, R, {"n": 1.0}).collect() if r["id"] == 0 or r["id"] > 3} == {500}


def _pairs(spark, left, right, radius):
    L, R = _frames(spark, left, right)
    d = f"{G.degrees_of(radius / 4)!r}D"
    units = G._units(R, d, {"_n": G.F.lit(True)}, "latitude", "longitude")
    return G._in_circle(G._places(L, "latitude", "longitude"), units, d, [radius]).count()


def test_pair_table_does_not_grow_with_the_count(spark):
    """A hot cell wholly inside the circle is one row, however many points it holds."""
    rng = np.random.default_rng(1)
    hot = lambda n: [(40.7 + rng.random() * 1e-4, -74.0 + rng.random() * 1e-4) for _ in range(n)]
    left = [(40.7 + rng.random() * 1e-4, -74.0 + rng.random() * 1e-4) for _ in range(20)]
    sizes = [_pairs(spark, left, hot(n), 1.0) for n in (100, 1000, 4000)]
    assert sizes[0] == sizes[1] == sizes[2] <= 20 * 4


def test_no_reference_points(spark):
    L, R = _frames(spark, [(1.0, 2.0)], [(1.0, 2.0)])
    assert G.nearest(L, R.limit(0)).collect()[0]["ref_id"] is None
    row = G.nearest_and_count(L, R.limit(0), 1.0, "n").collect()[0]
    assert row["dist_km"] is None and row["n"] == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reference_tables_stay_off_the_driver(spark):
    """Small files may hold many rows: no reference table is broadcast, and probes are dealt over a fixed number of tasks."""
    left, right = _frames(spark, [(40.5, -74.0), (40.6, -74.1)], [(40.5, -74.0), (40.61, -74.1)])
    right = right.withColumn("routes", F.lit("A C"))
    found = [G.radius_counts(left, right, {"n": 1.0}), G.nearest(left, right), G.nearest_and_count(left, right, 1.0, "n"),
             G.radius_distinct_tokens(left, right, "routes", 1.0, "n")]
    for df in found:
        assert "BroadcastExchange" not in _plan(df) and "REPARTITION_BY_NUM" in _plan(df)


def test_distinct_tokens_at_the_edge(spark):
    """Rare tokens near the circle's edge are found by each probe alone, common ones by whole probe cells."""
    rng = np.random.default_rng(8)
    left, right = rng.random((300, 2)) * 0.06 + [40.5, -74.0], rng.random((900, 2)) * 0.06 + [40.5, -74.0]
    words = [f"{'common' if i % 3 else ''} t{i % 60}" for i in range(len(right))]
    probes, points = _frames(spark, left, right)
    points = points.join(spark.createDataFrame(list(enumerate(words)), "ref_id long, routes string"), "ref_id")
    d = _hav(left[:, None, 0], left[:, None, 1], right[None, :, 0], right[None, :, 1])
    for r in (0.3, 1.5):
        got = {x["id"]: x["n"] for x in G.radius_distinct_tokens(probes, points, "routes", r, "n").collect()}
        assert got == {i: len({w for j in np.where(d[i] <= r)[0] for w in words[j].split()}) for i in range(len(left))}


def test_staged_plans_of_nearest_and_count_stay_short(spark):
    """With ``stage`` no plan reads the points three times over: the longest stays under half of what it was (81 KB)."""
    left, right = _frames(spark, [(40.5, -74.0), (40.6, -74.1)], [(40.5, -74.0), (40.61, -74.1)])
    texts = []

    def step(df):
        texts.append(_plan(df))
        return df.checkpoint()
    rows = G.nearest_and_count(left, right, 1.0, "n", stage=step).collect()
    assert len(rows) == 2 and max(len(t) for t in texts) < 40_000


def test_units_come_from_one_scan(spark):
    """Points and cell totals are two grouping sets of one pass."""
    _, right = _frames(spark, [(40.5, -74.0)], [(40.5, -74.0), (40.5, -74.0), (40.5001, -74.0), (41.0, -75.0)])
    units = G._units(right, "0.01D", {"_n": F.col("ref_id") > 0}, "latitude", "longitude")
    got = sorted((r["_open"], r["_rlat"] or 0.0, r["_n"]) for r in units.collect())
    assert got == [(0, 0.0, 1), (0, 0.0, 2), (1, 40.5, 1), (1, 40.5001, 1), (1, 41.0, 1)]
    assert _plan(units).count("Expand") == 1 and "Union" not in _plan(units)
