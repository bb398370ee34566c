"""Model preparation, evaluation and explanation.

Evaluation metrics are single aggregates over the prediction table (partial
aggregation) and exact medians from one range sort.  Training uses ``spark.ml`` gradient-boosted
trees; contributions are exact TreeSHAP evaluated in ``mapInPandas`` against
tree tables broadcast from the fitted model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.functions import scalar as S
from lodgelens.operators import ranks
from lodgelens.operators import relational as R

# The original model settings.
GBT_PARAMS = {"n_estimators": 500, "learning_rate": 0.05, "max_depth": 6, "min_child_weight": 5,
              "subsample": 0.8, "colsample_bytree": 0.8, "reg_alpha": 0.1, "reg_lambda": 1.0,
              "random_state": 42, "early_stopping_rounds": 30}
# Columns that leak the target (price = revenue / occupancy).
LEAK_FEATURES = ["estimated_revenue", "estimated_occupancy"]
NON_FEATURES = ["id", "price_numeric", "log_price"]


def feature_list(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Every column except ids, targets and leaking columns."""
    drop = set(NON_FEATURES) | set(LEAK_FEATURES) | set(exclude or [])
    return [c for c in df.columns if c not in drop]


def leakage_check(df: DataFrame, target: str, ratios: dict[str, tuple[str, str]], tol: float = 1.0) -> DataFrame:
    """M1: share of rows where a ratio of two columns equals the target
    within ``tol`` - a ratio that holds everywhere leaks the target."""
    aggs = []
    for name, (num, den) in ratios.items():
        ok = F.abs(F.col(num) / F.col(den) - F.col(target)) <= tol
        aggs.append(F.round(F.avg(F.when(F.col(den) != 0, ok.cast("int"))), 6).alias(name))
    wide = df.agg(*aggs)
    return wide.unpivot([], list(ratios), "ratio", "share_within")


def fold_of(id_col: str, k: int = 5, seed: int = 42) -> Column:
    """M3: shuffled k-fold assignment from the id alone (independent of row
    order and partitioning)."""
    return F.pmod(F.pmod(F.pmod(F.col(id_col), F.lit(1000003)) * 7919 + F.lit(seed) * 104729, F.lit(1000003)), F.lit(k)).cast("int")


def regression_metrics(df: DataFrame, true_col: str, pred_col: str, by: list[str] | None = None,
                       log_space: bool = True) -> DataFrame:
    """M6: RMSE and R^2 on log1p scale, MAE, MAPE, MedAE, MdAPE on the price
    scale; one aggregate (per group) and one range sort for both medians."""
    t, p = F.col(true_col), F.col(pred_col)
    yt, yp = (F.log1p(t), F.log1p(p)) if log_space else (t, p)
    err = F.abs(t - p)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.round(F.sqrt(F.avg(F.pow(yp - yt, 2))), 6).alias("rmse_log"),
            F.round(F.avg(err), 6).alias("mae_price"),
            F.round(1 - F.sum(F.pow(yt - yp, 2)) / (F.count(F.lit(1)) * F.var_pop(yt)), 6).alias("r2"),
            F.round(F.avg(err / t) * 100, 6).alias("mape_pct")]
    mid = ranks.medians(df, {"_medae": err, "_mdape": err / t * 100}, by or [])
    found = (df.groupBy(*by).agg(*aggs).join(mid, by, "left") if by else df.agg(*aggs).crossJoin(F.broadcast(mid)))
    return found.withColumns({"medae": F.round("_medae", 6), "mdape_pct": F.round("_mdape", 6)}).drop("_medae", "_mdape")


def cv_summary(per_fold: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """M7: fold rows, their mean and sample std, and the test row (union by name)."""
    folds = per_fold.select(F.col("fold").cast("string").alias("split"), *cols)
    mean = per_fold.agg(*[F.round(F.avg(c), 6).alias(c) for c in cols]).withColumn("split", F.lit("mean"))
    std = per_fold.agg(*[F.round(F.stddev_samp(c), 6).alias(c) for c in cols]).withColumn("split", F.lit("std"))
    tst = test.select(*cols).withColumn("split", F.lit("test"))
    return reduce(lambda a, b: a.unionByName(b), [folds, mean, std, tst])


def baseline_improvement(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """M8: MAE of always predicting the median vs the model's MAE."""
    t = df.crossJoin(F.broadcast(ranks.medians(df, {"_med": F.col(true_col)})))
    a = t.agg(F.avg(F.abs(F.col(true_col) - F.col("_med"))).alias("baseline_mae"),
              F.avg(F.abs(F.col(true_col) - F.col(pred_col))).alias("model_mae"))
    return a.select(F.round("baseline_mae", 6).alias("baseline_mae"), F.round("model_mae", 6).alias("model_mae"),
                    F.round((1 - F.col("model_mae") / F.col("baseline_mae")) * 100, 6).alias("improvement_pct"))


def within_tolerance(df: DataFrame, true_col: str, pred_col: str, rel: float = 0.2, absolute: float = 50.0
                     ) -> DataFrame:
    """M9: share of predictions within 20 % and within 50 units."""
    r = F.abs(F.col(true_col) - F.col(pred_col))
    return df.agg(F.round(F.avg((r <= rel * F.col(true_col)).cast("int")) * 100, 6).alias("pct_within_rel"),
                  F.round(F.avg((r <= absolute).cast("int")) * 100, 6).alias("pct_within_abs"))


def pred_vs_actual(df: DataFrame, true_col: str, pred_col: str, cap: float = 2000.0) -> DataFrame:
    """Rows under the cap with residual and percent error."""
    d = df.filter((F.col(true_col) <= cap) & (F.col(pred_col) <= cap))
    return d.withColumns({"residual": F.col(true_col) - F.col(pred_col),
                          "pct_error": S.pct_error(true_col, pred_col)})


def filtered_importance(contrib: DataFrame, cond: Column, features: list[str], min_rows: int = 5) -> DataFrame:
    """Mean |contribution| under filters, falling back to all rows when
    fewer than ``min_rows`` match.  The count is a 1-row broadcast, so the
    choice is made inside the plan."""
    marked = contrib.withColumn("_sel", F.coalesce(cond, F.lit(False)))
    cnt = marked.agg(F.count_if("_sel").alias("_n"))
    use = marked.crossJoin(F.broadcast(cnt)).filter(F.col("_sel") | (F.col("_n") < min_rows))
    wide = use.agg(*[F.avg(F.abs(c)).alias(c) for c in features], F.first("_n").alias("n_selected"))
    long = wide.unpivot(["n_selected"], features, "feature", "mean_abs")
    return long.select("feature", F.round("mean_abs", 9).alias("mean_abs"), "n_selected",
                       (F.col("n_selected") < min_rows).alias("fallback_all"))


def directional_contributions(df: DataFrame, id_cols: list[str], pairs: dict[str, tuple[str, str]],
                              n: int, seed: int = 42, order_col: str = "id",
                              tie_break: list[str] | None = None) -> DataFrame:
    """(contribution, feature value scaled by the whole table's range)
    per feature for a seeded sample of rows, long form."""
    feats = [v for _, v in pairs.values()]
    t = R.attach_scalars(df, **{f"_lo_{f}": F.min(f) for f in feats}, **{f"_hi_{f}": F.max(f) for f in feats})
    rows = [F.struct(F.lit(name).alias("feature"), F.col(c).alias("contribution"),
                     F.round(S.minmax_clip(v, F.col(f"_lo_{v}"), F.col(f"_hi_{v}")), 9).alias("scaled_value"))
            for name, (c, v) in pairs.items()]
    sample = t.orderBy(R.seeded_order(order_col, seed), *[F.col(c) for c in id_cols + (tie_break or [])]).limit(n)
    return sample.select(*id_cols, F.explode(F.array(*rows)).alias("r")).select(*id_cols, "r.*")


# ------------------------------------------------------------ training (M4)

def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def gbt_regressor(params: dict | None = None, label: str = "log_price"):
    """M4: spark.ml gradient-boosted trees with the original settings mapped
    (n_estimators -> maxIter, learning_rate -> stepSize, max_depth, min
    child weight -> minInstancesPerNode, subsample -> subsamplingRate, column
    sample -> featureSubsetStrategy per node).  Differences: no L1/L2 terms
    and column sampling per node instead of per tree.  The early stop is
    ``fit_with_patience``."""
    from pyspark.ml.regression import GBTRegressor
    p = dict(GBT_PARAMS, **(params or {}))
    return GBTRegressor(labelCol=label, featuresCol="features", predictionCol="pred_log",
                        maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"],
                        minInstancesPerNode=p["min_child_weight"], subsamplingRate=p["subsample"],
                        featureSubsetStrategy=str(p["colsample_bytree"]), seed=p["random_state"])


def best_prefix(errors: list[float], patience: int) -> tuple[int, bool]:
    """Index of the first smallest error before ``patience`` rounds in a row
    without a new smallest one, and whether such a row of rounds was seen."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def fit_with_patience(train: DataFrame, validation: DataFrame, params: dict | None = None):
    """M4's early stop: boosting ends ``early_stopping_rounds`` trees after the
    validation error's last improvement, and the best prefix is the model.

    ``evaluateEachIteration`` gives the error of every prefix in one pass (a
    running sum of weighted tree outputs per row, one aggregate).  As boosting
    can't be resumed, the ensemble is grown to twice the size while the stop
    isn't reached; trees are seeded by their number, so a longer run has the
    shorter one as its prefix.  That goes for the best prefix too, so it is cut
    from the ensemble and not fitted again.  Returns the model of the best prefix, the
    0-based best iteration and the validation errors (RMSE) seen."""
    p = dict(GBT_PARAMS, **(params or {}))
    patience, most = p["early_stopping_rounds"], p["n_estimators"]
    size = min(most, 2 * patience)
    while True:
        model = gbt_regressor(dict(p, n_estimators=size)).fit(train)
        errors = [e ** 0.5 for e in model.evaluateEachIteration(validation, "squared")]
        best, stopped = best_prefix(errors, patience)
        if stopped or size == most:
            break
        size = min(most, 2 * size)
    return prefix_model(model, best + 1), best, errors[:best + patience + 1]


def prefix_model(model, n: int):
    """The model of an ensemble's first ``n`` trees: what a fit of ``n`` trees gives."""
    from pyspark.ml.regression import GBTRegressionModel
    if n >= model.getNumTrees:
        return model
    java = model._java_obj
    gateway = SparkSession.active().sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml
    trees, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(n):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    cut = GBTRegressionModel(java.copyValues(ml.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures()), ml.param.ParamMap()))
    cut._transfer_params_from_java()
    return cut


FOLD_METRICS = ["fold", "n_trees", "n", "rmse_log", "mae_price", "r2", "mape_pct"]


def cross_validate(train: DataFrame, features: list[str], k: int = 5, seed: int = 42,
                   params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """M4: k folds by id hash; each fold trains on the others, stops early on
    its own rows and is scored on them.  Folds are fitted side by side.

    Returns the fold metric table (``n_trees`` is the 0-based best iteration)
    and the validation error of every prefix (fold, iteration, rmse)."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from lodgelens.session import ensure_checkpoint_dir
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    data = assemble(train, features).withColumn("_fold", fold_of("id", k, seed)).checkpoint()

    @inheritable_thread_target(spark)
    def one(f: int):
        own = data.filter(F.col("_fold") == f)
        model, best, errors = fit_with_patience(data.filter(F.col("_fold") != f), own, params)
        pred = model.transform(own).withColumn("pred_price", F.expm1("pred_log"))
        m = regression_metrics(pred, "price_numeric", "pred_price")
        return m.select(F.lit(f + 1).alias("fold"), F.lit(best).alias("n_trees"), *FOLD_METRICS[2:]), [(f + 1, i, e) for i, e in enumerate(errors)]

    with ThreadPoolExecutor(k) as pool:
        done = list(pool.map(one, range(k)))
    stages = spark.createDataFrame([s for _, rows in done for s in rows], "fold int, iteration int, rmse double")
    return reduce(lambda a, b: a.unionByName(b), [m for m, _ in done]), stages


def refit_and_test(train: DataFrame, test: DataFrame, features: list[str], n_trees: int,
                   params: dict | None = None):
    """M5: refit on all training rows with the median of the folds' best
    iterations (at least one tree), no early stopping; the held-out rows'
    predictions."""
    p = dict(params or {}, n_estimators=max(1, int(n_trees)))
    model = gbt_regressor(p).fit(assemble(train, features))
    return model, predict_price(model, test, features)


def predict_price(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with the model's log price and price."""
    return model.transform(assemble(rows, features)).withColumn("pred_price", F.expm1("pred_log"))


def score_months(model, listings: DataFrame, season: DataFrame, features: list[str],
                 months: tuple[int, int] = (4, 12)) -> DataFrame:
    """Every listing scored for every month in range with that month's
    season index (the month list is generated per row, no join fan-out
    beyond the months)."""
    rows = listings.drop("month", "seasonal_index").withColumn(
        "month", F.explode(F.sequence(F.lit(months[0]), F.lit(months[1]))))
    rows = rows.join(F.broadcast(season.select("month", "seasonal_index")), "month")
    pred = model.transform(assemble(rows, features))
    return pred.select("id", "month", "seasonal_index", F.expm1("pred_log").alias("pred_price"))
