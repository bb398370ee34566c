"""The shared rank pass against numpy and pandas, with nulls, ties, hot values and groups."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodgelens.operators import ranks
from lodgelens.operators import relational as R


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c", None], n, p=[0.7, 0.1, 0.1, 0.1]), "x": rng.normal(size=n).round(2),
                        "y": rng.integers(0, 5, n).astype(float), "z": rng.exponential(size=n), "k": 3.0})
    pdf.loc[rng.random(n) < 0.3, "x"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "z"] = np.nan
    pdf.loc[pdf["g"] == "c", "y"] = np.nan  # a group without a value
    rows = [tuple(None if v is None or v != v else v for v in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "g string, x double, y double, z double, k double").repartition(5)


QS = [0.0, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_of_many_columns(table):
    pdf, df = table
    row = ranks.quantiles(df, ["x", "y", "z"], QS).collect()
    assert len(row) == 1
    for c in "xyz":
        assert np.allclose([row[0][f"{c}_{i}"] for i in range(len(QS))], pdf[c].quantile(QS))
    got = {r["g"]: r for r in ranks.quantiles(df, {"x": F.col("x"), "w": F.col("z") * 2, "y": F.col("y")}, QS, "g").collect()}
    assert set(got) == {"a", "b", "c"}
    for g, part in pdf.groupby("g"):
        assert np.allclose([got[g][f"x_{i}"] for i in range(len(QS))], part["x"].quantile(QS))
        assert np.allclose([got[g][f"w_{i}"] for i in range(len(QS))], part["z"].quantile(QS) * 2)
    assert got["c"]["y_2"] is None and got["a"]["y_2"] == pdf[pdf["g"] == "a"]["y"].median()


def test_no_rows(table):
    _, df = table
    assert ranks.medians(df.limit(0), ["x", "y"]).collect()[0].asDict() == {"x": None, "y": None}
    assert ranks.medians(df.limit(0), ["x"], "g").count() == 0
    assert R.pearson_spearman(df.limit(0), "x", "y").collect()[0].asDict() == {"n": 0, "pearson": None, "spearman": None}
    assert [r["r"] for r in R.spearman_pairs(df.limit(0), [("x", "y")]).collect()] == [None]


def test_spearman_ranks_each_pair_on_its_complete_rows(table):
    pdf, df = table
    pairs = [("x", "y"), ("x", "z"), ("z", "y"), ("x", "k")]
    got = {(r["col_a"], r["col_b"]): r["r"] for r in R.spearman_pairs(df, pairs).collect()}
    for a, b in pairs[:3]:
        both = pdf[[a, b]].dropna()
        assert got[a, b] == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-12)
    assert got["x", "k"] is None


KEYS = ["group_aggregate_median", "describe_table", "describe_column", "project_price", "median_impute", "feature_matrix", "regression_metrics",
        "cv_summary", "baseline_improvement", "kpi_row", "histogram", "box_stats", "sentiment_segments", "seasonal_trend", "topic_price",
        "topic_confidence", "listing_summary_by_borough", "top_groups", "summary_stats", "query_listings"]


@pytest.mark.parametrize("key", KEYS)
def test_no_value_map_aggregate(spark, sf, key):
    plan = entry.queries()[key](spark, sf)._jdf.queryExecution().toString()
    assert not re.search(r"\b(median|percentile|percentile_cont)\(", plan)
