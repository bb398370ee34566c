"""The feature matrix is planned join by join: no plan of it is long, however many questions it asks."""

from lodgelens.operators import spatial as G
from lodgelens.plans import features as FE


def _frames(spark):
    probes = spark.createDataFrame([(i, 40.5 + i * 0.003, -74.0 - i * 0.002) for i in range(12)], "id long, latitude double, longitude double")
    stations = spark.createDataFrame([(i, 40.5 + i * 0.004, -74.0, i % 2, i % 3, "A C") for i in range(9)],
                                     "ref_id long, latitude double, longitude double, cbd int, ada int, routes string")
    points = spark.createDataFrame([(i, 40.5 + i * 0.001, -74.0, "PROMO") for i in range(30)],
                                   "ref_id long, latitude double, longitude double, domain string")
    return probes, stations, points


def test_spatial_features_have_no_long_plan(spark, monkeypatch):
    probes, stations, points = _frames(spark)
    kind, sizes = type(probes), []
    real = kind.checkpoint

    def checkpoint(df, *args):
        sizes.append(len(df._jdf.queryExecution().executedPlan().toString()))
        return real(df, *args)
    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    FE.spatial_features(probes, stations, points, points)
    assert max(sizes) < 25_000


def test_stages_give_the_same_rows(spark):
    probes, stations, points = _frames(spark)
    probes = probes.unionByName(spark.createDataFrame([(90, None, -74.0), (91, 40.5, -74.0), (91, 40.5, -74.0)], probes.schema))
    for ask in (lambda **kw: G.nearest(probes, stations, attrs=["cbd"], **kw), lambda **kw: G.nearest_and_count(probes, points, 0.8, "n", **kw),
                lambda **kw: G.radius_distinct_tokens(probes, stations, "routes", 0.7, "n", **kw), lambda **kw: G.radius_counts(probes, points, {"a": 0.5, "b": 1.0}, **kw)):
        assert sorted(map(str, ask().collect())) == sorted(map(str, ask(stage=lambda df: df.checkpoint()).collect()))
