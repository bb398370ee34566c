"""TreeSHAP: additivity against spark.ml predictions and equality with
brute-force Shapley values (same path-dependent value function)."""

import itertools
import math

import numpy as np

from lodgelens.operators import model as M
from lodgelens.operators import shap as SH


def _cond_value(t, x, s, j=0):
    if t["left"][j] < 0:
        return t["value"][j]
    f = t["feature"][j]
    a, b = t["left"][j], t["right"][j]
    if f in s:
        return _cond_value(t, x, s, a if x[f] <= t["threshold"][j] else b)
    return (t["cover"][a] * _cond_value(t, x, s, a) + t["cover"][b] * _cond_value(t, x, s, b)) / t["cover"][j]


def test_tree_shap(spark):
    rng = np.random.default_rng(0)
    n = 300
    x = rng.normal(size=(n, 3))
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0, 1.5, -0.5) + 0.3 * x[:, 2] * x[:, 0]
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)],
                               "id long, a double, b double, c double, log_price double")
    feats = ["a", "b", "c"]
    model = M.gbt_regressor({"n_estimators": 4, "max_depth": 3, "subsample": 1.0, "colsample_bytree": 1.0,
                             "min_child_weight": 1}).fit(M.assemble(df, feats))
    contrib = SH.contributions(df.limit(25), model, feats, ["id"]).toPandas().set_index("id")
    pred = model.transform(M.assemble(df.limit(25), feats)).select("id", "pred_log").toPandas().set_index("id")
    got = contrib["base_value"] + contrib[[f"c_{f}" for f in feats]].sum(axis=1)
    assert np.allclose(got.loc[pred.index], pred["pred_log"], atol=1e-9)
    trees, weights = SH.tree_tables(model, spark)
    for rid in list(pred.index)[:5]:
        xr = x[rid]
        for fi in range(3):
            phi = 0.0
            others = [k for k in range(3) if k != fi]
            for r in range(len(others) + 1):
                for sub in itertools.combinations(others, r):
                    wgt = math.factorial(r) * math.factorial(3 - r - 1) / math.factorial(3)
                    s = set(sub)
                    for t, w in zip(trees, weights):
                        phi += wgt * w * (_cond_value(t, xr, s | {fi}) - _cond_value(t, xr, s))
            assert abs(phi - contrib.loc[rid, f"c_{feats[fi]}"]) < 1e-9


def test_deep_trees_missing_values_and_batches(spark):
    """Features repeated on a path, missing values, several batches: sums equal the model's predictions."""
    rng = np.random.default_rng(3)
    n = 400
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 0] > 0) + 0.1 * rng.normal(size=n)
    kind, feats = "id long, a double, b double, c double, d double, log_price double", ["a", "b", "c", "d"]
    whole = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)], kind)
    model = M.gbt_regressor({"n_estimators": 12, "max_depth": 6, "min_child_weight": 2}).fit(M.assemble(whole, feats))
    x[rng.random((n, 4)) < 0.1] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(n)], kind)
    got = SH.contributions(df, model, feats, ["id"], rows=64).toPandas().set_index("id")
    pred = model.transform(M.assemble(df, feats)).select("id", "pred_log").toPandas().set_index("id")
    assert len(got) == n
    assert np.allclose((got["base_value"] + got[[f"c_{f}" for f in feats]].sum(axis=1)).loc[pred.index], pred["pred_log"], atol=1e-9)


def test_contributions_by_category(spark, sf):
    from lodgelens.plans import suite_ml as Q
    rows = Q.contribution_categories(spark, sf).collect()
    feats = Q._split(spark, sf)[2]
    table = Q.contributions_table(spark, sf).toPandas()
    assert sum(r["n_features"] for r in rows) == len(feats) and abs(sum(r["share"] for r in rows) - 1) < 1e-6
    assert abs(sum(r["total"] for r in rows) - table[[f"c_{f}" for f in feats]].abs().mean().sum()) < 1e-6
