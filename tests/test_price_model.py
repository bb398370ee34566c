"""The price queries score with the refit model of the folds' median tree count."""

import statistics

import numpy as np

from lodgelens.operators import model as M
from lodgelens.operators import shap as SH
from lodgelens.plans import suite_ml as Q
from lodgelens.plans.suite_features import listing_level, season


def _leaf(t, x, j=0):
    while t["left"][j] >= 0:
        j = t["left"][j] if x[t["feature"][j]] <= t["threshold"][j] else t["right"][j]
    return t["value"][j]


def test_months_are_scored_by_the_refit_model(spark, sf):
    feats = Q._split(spark, sf)[2]
    counts = [r["n_trees"] for r in Q.train_price_model(spark, sf).collect()]
    model = Q.price_model(spark, sf)
    assert model.getNumTrees == int(statistics.median(counts)) > 1
    assert Q.refit_median_trees(spark, sf).first()["n_trees"] == model.getNumTrees
    trees, weights = SH.tree_tables(model, spark)
    index = {r["month"]: r["seasonal_index"] for r in season(spark, sf).collect()}
    rows = {r["id"]: r.asDict() for r in listing_level(spark, sf).collect()}
    scored = Q.score_months(spark, sf).collect()
    assert {(r["id"], r["month"]) for r in scored} == {(i, m) for i in rows for m in range(4, 13) if m in index}
    for r in scored:
        row = rows[r["id"]] | {"month": r["month"], "seasonal_index": index[r["month"]]}
        x = [float("nan") if row[f] is None else float(row[f]) for f in feats]
        want = np.expm1(sum(w * _leaf(t, x) for t, w in zip(trees, weights)))
        assert abs(r["pred_price"] - want) <= 1e-9 * max(1, abs(want))


def test_best_prefix():
    assert M.best_prefix([3.0, 2.0, 2.0, 2.5, 1.0], 2) == (1, True)  # the later improvement is out of reach
    assert M.best_prefix([3.0, 2.0, 2.0, 1.5, 1.0], 3) == (4, False)
    assert M.best_prefix([1.0], 30) == (0, False)
    assert M.best_prefix([1.0, 1.0, 1.0], 2) == (0, True)


def test_fold_table_equals_oracle_over_staged_predictions(spark, sf):
    """Tree by tree predictions of a longer fit give the errors, the stop and the fold's metrics."""
    train, _, feats = Q._split(spark, sf)
    folds = {r["fold"]: r for r in Q.train_price_model(spark, sf).collect()}
    stages = {}
    for r in Q.price_fold_stages(spark, sf).collect():
        stages.setdefault(r["fold"], []).append((r["iteration"], r["rmse"], r["best_so_far"]))
    assert sorted(folds) == sorted(stages) == [1, 2, 3, 4, 5]
    for f, rows in stages.items():
        rows.sort()
        best = min(range(len(rows)), key=lambda i: rows[i][1])
        assert folds[f]["n_trees"] == best and len(rows) in (best + 31, 500)
        assert rows[-1][2] == rows[best][1]
    data = M.assemble(train, feats).withColumn("_fold", M.fold_of("id", 5, 42)).checkpoint()
    own = data.filter("_fold = 1").collect()
    model = M.gbt_regressor({"n_estimators": len(stages[2])}).fit(data.filter("_fold <> 1"))
    trees, weights = SH.tree_tables(model, spark)
    out = np.array([[w * _leaf(t, r["features"].toArray()) for t, w in zip(trees, weights)] for r in own]).cumsum(axis=1)
    y = np.array([r["log_price"] for r in own])[:, None]
    rmse = np.sqrt(((out - y) ** 2).mean(axis=0))
    assert np.allclose(rmse, [e for _, e, _ in stages[2]], rtol=1e-9)
    pred, true = np.expm1(out[:, folds[2]["n_trees"]]), np.array([r["price_numeric"] for r in own])
    assert abs(np.abs(pred - true).mean() - folds[2]["mae_price"]) < 1e-5


def test_best_prefix_is_cut_and_not_fitted_again(spark, monkeypatch):
    """One fit while the first ensemble shows the stop; the cut model is the one that a fit of that many trees gives."""
    from pyspark.ml.regression import GBTRegressor
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, x), float(x[0] * 3 + rng.normal())) for i, x in enumerate(rng.random((600, 3)))]
    df = M.assemble(spark.createDataFrame(rows, "id int, a double, b double, c double, log_price double"), ["a", "b", "c"]).checkpoint()
    train, own = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    sizes, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, *a: sizes.append(self.getMaxIter()) or fit(self, *a))
    params = {"early_stopping_rounds": 8, "learning_rate": 0.3, "max_depth": 4}
    model, best, errors = M.fit_with_patience(train, own, params)
    assert sizes == [16] and model.getNumTrees == best + 1 < 16 and len(errors) == best + 9
    again = fit(M.gbt_regressor(params | {"n_estimators": best + 1}), train)
    assert model.toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:]
    assert model.treeWeights == again.treeWeights and model.getPredictionCol() == "pred_log"
    assert [r["pred_log"] for r in model.transform(own).collect()] == [r["pred_log"] for r in again.transform(own).collect()]
