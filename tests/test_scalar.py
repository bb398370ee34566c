"""Literal tests for the scalar functions and the pandas/Spark traps."""

import math

from pyspark.sql import functions as F

from lodgelens.functions import scalar as S
from lodgelens.operators import relational as R


def _one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first()["y"]


def test_parse_price(spark):
    assert _one(spark, S.parse_price("x"), "$1,087.00") == 1087.0
    assert _one(spark, S.parse_price("x"), "n/a") is None
    assert _one(spark, S.parse_price("x"), None) is None


def test_percent_and_flags(spark):
    assert abs(_one(spark, S.parse_percent("x"), "97%") - 0.97) < 1e-12
    assert _one(spark, S.tf_flag("x"), "t") == 1
    assert _one(spark, S.tf_flag("x"), None) == 0
    assert _one(spark, S.tf_map("x"), "x") is None


def test_bathrooms_half_first(spark):
    assert _one(spark, S.parse_bathrooms("x"), "Shared half-bath") == 0.5
    assert _one(spark, S.parse_bathrooms("x"), "1.5 baths") == 1.5
    assert _one(spark, S.parse_bathrooms("x"), "Private bath") is None


def test_amenities(spark):
    text = '["Dishwasher", "Hair dryer"]'
    flags = S.keyword_flags("x")
    row = spark.createDataFrame([(text,)], "x string").select(*[v.alias(k) for k, v in flags.items()]).first()
    assert row["has_washer"] == 1 and row["has_dryer"] == 1 and row["has_wifi"] == 0
    assert _one(spark, S.count_quoted("x"), text) == 2
    assert _one(spark, S.json_array_len("x"), "not json") == 0
    assert _one(spark, S.count_quoted("x"), None) == 0


def test_maps_and_bins(spark):
    assert _one(spark, S.ordinal_map("x"), "Within A Day") == 3
    assert _one(spark, S.ordinal_default("x"), "Castle") == 1
    assert _one(spark, S.simplify_category("x"), None) == "Other"
    assert _one(spark, S.cut_bins("x", [0, 75, 150], ["a", "b"]), 75.0, "x double") == "a"
    assert _one(spark, S.cut_bins("x", [0, 75, 150], ["a", "b"]), 0.0, "x double") is None
    assert _one(spark, S.feature_category("x"), "dist_subway_km") == "Transit"
    assert _one(spark, S.feature_category("x"), "host_response_rate_f") == "Host"


def test_haversine(spark):
    d = spark.createDataFrame([(40.0, -74.0, 41.0, -74.0)], "a double, b double, c double, d double").select(
        S.haversine_km("a", "b", "c", "d").alias("k")).first()["k"]
    assert abs(d - 6371.0 * math.radians(1.0)) < 1e-6


def test_null_keys_dropped_and_negation(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", 3.0)], "k string, v double")
    out = R.group_agg(df, "k", F.median("v").alias("m")).collect()
    assert [(r["k"], r["m"]) for r in out] == [("a", 2.0)]
    keep = R.exclude_values(spark.createDataFrame([(2020,), (None,), (2019,)], "y int"), "y", [2020]).collect()
    assert sorted([r["y"] for r in keep], key=lambda v: (v is None, v)) == [2019, None]


def test_average_rank_matches_pandas(spark):
    import pandas as pd
    vals = [3.0, 1.0, 3.0, 2.0, 5.0, 3.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = {r["i"]: r["rank"] for r in R.average_rank(df, "v").collect()}
    want = pd.Series(vals).rank()
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(len(vals)))


def test_first_max_label(spark):
    df = spark.createDataFrame([(0, 1, 1)], "boro_a int, boro_b int, boro_c int")
    lab = df.select(S.strip_prefix(S.first_max_label(["boro_a", "boro_b", "boro_c"]), "boro_").alias("x")).first()
    assert lab["x"] == "b"


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=500), np.full(300, 0.25), rng.integers(0, 5, 200).astype(float)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.99, 1.0]
    row = R.exact_quantiles(df, "x", qs).first()
    for i, q in enumerate(qs):
        assert abs(row[f"q{i}"] - np.quantile(v, q)) < 1e-12


def test_group_quantiles_match_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(9)
    g = np.array(["hot"] * 700 + ["a"] * 50 + ["b"] * 3 + ["c"])
    v = np.concatenate([rng.normal(size=400), np.full(300, 1.5), rng.random(54)])
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0), ("a", None)], "g string, v double"))
    qs = [0.25, 0.5, 0.9]
    got = {r["g"]: [r[f"q{i}"] for i in range(3)] for r in R.group_quantiles(df, "g", "v", qs).collect()}
    want = pdf.groupby("g")["v"].quantile(qs).unstack()
    assert set(got) == set(want.index)
    for k in got:
        assert np.allclose(got[k], want.loc[k].to_numpy(), atol=1e-12)
