"""The tile kernels of the spatial joins: work by the root of the points, large tiles in parts, exact edges."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_spatial import _frames, _hav

from lodgelens.operators import spatial as G
from lodgelens.operators import tiles

SIDE = G.degrees_of(1.0)


def _batches(probes, points, size=64):
    """Rows of one tile in the kernels' order."""
    rows = [(k, a, o) for k, ps in ((0, probes), (1, points)) for a, o in ps]
    t = pa.table({"_t": pa.array([k for k, _, _ in rows], pa.int64()), "_lat": [float(a) for _, a, _ in rows], "_lon": [float(o) for _, _, o in rows]})
    return t.to_batches(max_chunksize=size)


def test_pairs_grow_with_the_root_of_the_points(monkeypatch):
    """A circle in 16 times as many points looks at some 4 times as many pairs, not 16."""
    rng = np.random.default_rng(5)
    seen, apart = [], tiles.Stripes.apart
    monkeypatch.setattr(tiles.Stripes, "apart", lambda self, *a: seen.append(len(a[-1])) or apart(self, *a))
    schema = pa.schema([("_plat", "double"), ("_plon", "double"), ("_k", "int32"), ("_rlat", "double"), ("_rlon", "double"), ("n", "int64")])
    lon = lambda v: -180 + v * SIDE
    work = {}
    for n in (5_000, 80_000):
        points = np.column_stack([rng.random(n) * SIDE, lon(rng.random(n))])
        probes = np.column_stack([0.5 * SIDE + rng.random(20) * 0.01 * SIDE, lon(0.5 + rng.random(20) * 0.01)])
        seen.clear()
        got = pa.Table.from_batches(tiles.counts(SIDE, [0.3], {"n": 0}, {}, schema)(_batches(probes, points, 10_000)))
        work[n] = sum(seen)
        d = _hav(probes[:, None, 0], probes[:, None, 1], points[None, :, 0], points[None, :, 1])
        assert dict(zip(got["_plat"].to_pylist(), got["n"].to_pylist())) == dict(zip(probes[:, 0], (d <= 0.3).sum(axis=1).tolist()))
    assert work[80_000] < 6 * work[5_000] and work[80_000] < 20 * 80_000 * 0.1


@pytest.mark.parametrize("rows", [16, 100, 1 << 19])
def test_a_large_tile_comes_in_parts(rows):
    probes, points = [(0.0, i / 100) for i in range(30)], [(1.0, i / 100) for i in range(500)]
    more = [pa.RecordBatch.from_arrays([pa.array([4, 5], pa.int64()), pa.array([9.0, 9.0]), pa.array([9.0, 9.0])], ["_t", "_lat", "_lon"])]
    got = list(tiles.chunks(iter(_batches(probes, points) + more), rows))
    pairs = sorted((t, a, b) for p, q in got for t, a in zip(p["_t"].to_pylist(), p["_lon"].to_pylist()) for u, b in zip(q["_t"].to_pylist(), q["_lon"].to_pylist()) if t == u - 1)
    assert pairs == sorted([(0, a, b) for _, a in probes for _, b in points] + [(4, 9.0, 9.0)])
    assert rows > 1000 or len(got) > 2


def test_edges_conditions_and_copies(spark):
    """Points at the very radius, copies of a place, null conditions and null coordinates; Spark's haversine decides."""
    left, right = [(40.7, -73.95), (40.7, -73.95), (40.71, -73.95)], [(40.7 + i / 1000, -73.95) for i in range(12)] * 3
    L, R = _frames(spark, left, right)
    R = R.unionByName(spark.createDataFrame([(99, None, 1.0)], R.schema))
    d = L.crossJoin(R.toDF("r", "a", "o")).select("id", "r", G.haversine_km(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("o")).alias("d")).collect()
    odd = F.when(F.col("ref_id") % 3 == 0, None).otherwise(F.col("ref_id") % 2 == 1)
    for radius in sorted({x["d"] for x in d if x["d"]})[:4]:
        got = {x["id"]: (x["n"], x["odd"]) for x in G.radius_counts(L, R, {"n": radius, "odd": (2 * radius, odd)}).collect()}
        assert got == {i: (sum(x["id"] == i and x["d"] is not None and x["d"] <= radius for x in d),
                           sum(x["id"] == i and x["d"] is not None and x["d"] <= 2 * radius and x["r"] % 3 != 0 and x["r"] % 2 == 1 for x in d)) for i in range(3)}


def test_nearest_over_tile_borders_and_empty_tiles(spark):
    """The nearest point in a neighbouring tile, in a far one, and equal distances (the smallest id)."""
    rng = np.random.default_rng(6)
    left = np.vstack([rng.random((200, 2)) * 0.3 + [40.5, -74.2], [[10.0, 10.0]]])
    right = np.vstack([rng.random((40, 2)) * 0.3 + [40.5, -74.2]] * 2)
    d = _hav(left[:, None, 0], left[:, None, 1], right[None, :, 0], right[None, :, 1])
    got = {x["id"]: (x["ref_id"], x["dist_km"]) for x in G.nearest(*_frames(spark, left, right)).collect()}
    assert len(got) == 201
    for i in range(201):
        assert got[i][0] == int(np.argmin(d[i])) and abs(got[i][1] - d[i].min()) < 1e-8
