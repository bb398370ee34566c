"""Registered queries: model preparation and evaluation (M1-M3, M6-M10,
M12-M14) over the prediction and contribution fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgelens.functions import scalar as S
from lodgelens.operators import model as M
from lodgelens.operators import relational as R
from lodgelens.plans.listing_tables import listing_base
from lodgelens.plans.registry import query
from lodgelens.plans.suite_scalar import _feature_category_sql
from lodgelens.sources import catalog
from lodgelens.sources.tables import table


def _metrics_sql(where: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""
SELECT {g}count(*) AS n,
       round(sqrt(avg(pow(ln(1 + pred_price) - ln(1 + true_price), 2))), 6) AS rmse_log,
       round(avg(abs(true_price - pred_price)), 6) AS mae_price,
       round(1 - sum(pow(ln(1 + true_price) - ln(1 + pred_price), 2)) / (count(*) * var_pop(ln(1 + true_price))), 6) AS r2,
       round(avg(abs(true_price - pred_price) / true_price) * 100, 6) AS mape_pct,
       round(quantile_cont(abs(true_price - pred_price), 0.5), 6) AS medae,
       round(quantile_cont(abs(true_price - pred_price) / true_price * 100, 0.5), 6) AS mdape_pct
FROM fx_predictions WHERE {where}{gb}"""


def _preds(spark, sf):
    return catalog.fx_predictions(spark, sf)


@query("regression_metrics", _metrics_sql("month = 11"))
def regression_metrics(spark, sf):
    """M6: metrics on the held-out month."""
    return M.regression_metrics(_preds(spark, sf).filter("month = 11"), "true_price", "pred_price")


_CVC = ["rmse_log", "mae_price", "r2", "mape_pct"]


@query("cv_summary", f"""
WITH f AS ({_metrics_sql("month <> 11", "fold")}),
t AS ({_metrics_sql("month = 11")})
SELECT CAST(fold AS VARCHAR) AS split, {", ".join(_CVC)} FROM f
UNION ALL SELECT 'mean', {", ".join(f"round(avg({c}), 6)" for c in _CVC)} FROM f
UNION ALL SELECT 'std', {", ".join(f"round(stddev_samp({c}), 6)" for c in _CVC)} FROM f
UNION ALL SELECT 'test', {", ".join(_CVC)} FROM t
""")
def cv_summary(spark, sf):
    """M7: per-fold metrics on the training months, mean, std and test row."""
    p = _preds(spark, sf)
    folds = M.regression_metrics(p.filter("month <> 11"), "true_price", "pred_price", by=["fold"])
    test = M.regression_metrics(p.filter("month = 11"), "true_price", "pred_price")
    return M.cv_summary(folds, test, _CVC)


@query("month_split", """
SELECT CASE WHEN month = 11 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM fx_predictions GROUP BY 1
""")
def month_split(spark, sf):
    """M2: one month held out."""
    return _preds(spark, sf).groupBy(
        F.when(F.col("month") == 11, "test").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("fold_assign", """
SELECT id, CAST(((id * 7919 + 42 * 104729) % 1000003) % 5 AS INTEGER) AS fold FROM listing_base
""")
def fold_assign(spark, sf):
    """M3: shuffled 5-fold assignment by id."""
    return listing_base(spark, sf).select("id", M.fold_of("id", 5, 42).alias("fold"))


@query("leakage_check", """
SELECT 'revenue_per_occupancy' AS ratio,
       round(avg(CASE WHEN estimated_occupancy <> 0 THEN
             CAST(abs(estimated_revenue / estimated_occupancy - price_numeric) <= 1 AS INTEGER) END), 6) AS share_within
FROM listing_base
UNION ALL
SELECT 'revenue_per_available_night',
       round(avg(CASE WHEN availability_365 <> 0 THEN
             CAST(abs(estimated_revenue / availability_365 - price_numeric) <= 1 AS INTEGER) END), 6)
FROM listing_base
""")
def leakage_check(spark, sf):
    """M1: is the target a ratio of two candidate features?"""
    return M.leakage_check(listing_base(spark, sf), "price_numeric",
                           {"revenue_per_occupancy": ("estimated_revenue", "estimated_occupancy"),
                            "revenue_per_available_night": ("estimated_revenue", "availability_365")})


@query("baseline_improvement", """
WITH d AS (SELECT * FROM fx_predictions WHERE month = 11),
m AS (SELECT quantile_cont(true_price, 0.5) AS med FROM d),
a AS (SELECT avg(abs(true_price - med)) AS b, avg(abs(true_price - pred_price)) AS e FROM d, m)
SELECT round(b, 6) AS baseline_mae, round(e, 6) AS model_mae, round((1 - e / b) * 100, 6) AS improvement_pct FROM a
""")
def baseline_improvement(spark, sf):
    """M8."""
    return M.baseline_improvement(_preds(spark, sf).filter("month = 11"), "true_price", "pred_price")


@query("within_tolerance", """
SELECT round(avg(CAST(abs(true_price - pred_price) <= 0.2 * true_price AS INTEGER)) * 100, 6) AS pct_within_rel,
       round(avg(CAST(abs(true_price - pred_price) <= 50 AS INTEGER)) * 100, 6) AS pct_within_abs
FROM fx_predictions WHERE month = 11
""")
def within_tolerance(spark, sf):
    """M9."""
    return M.within_tolerance(_preds(spark, sf).filter("month = 11"), "true_price", "pred_price")


@query("pred_vs_actual", """
SELECT id, line, true_price, pred_price, round(true_price - pred_price, 9) AS residual,
       round(abs(true_price - pred_price) / true_price * 100, 9) AS pct_error
FROM fx_predictions WHERE month = 11 AND true_price <= 2000 AND pred_price <= 2000
""")
def pred_vs_actual(spark, sf):
    """M10."""
    d = M.pred_vs_actual(_preds(spark, sf).filter("month = 11"), "true_price", "pred_price")
    return d.select("id", "line", "true_price", "pred_price", F.round("residual", 9).alias("residual"),
                    F.round("pct_error", 9).alias("pct_error"))


_CF = ["c_discount", "c_tax", "c_quantity"]


def _imp_sql(cond: str) -> str:
    return f"""
WITH j AS (SELECT c.*, coalesce({cond}, false) AS sel FROM fx_contributions c JOIN fx_predictions p
           ON c.id = p.id AND c.line = p.line),
n AS (SELECT CAST(count_if(sel) AS BIGINT) AS n_selected FROM j),
u AS (SELECT j.* FROM j, n WHERE sel OR n.n_selected < 5)
""" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs({c})), 9) AS mean_abs, (SELECT n_selected FROM n) AS n_selected, "
        f"(SELECT n_selected FROM n) < 5 AS fallback_all FROM u" for c in _CF)


@query("filtered_importance", _imp_sql("p.month = 7 AND p.fold = 2"))
def filtered_importance(spark, sf):
    """Importance under filters."""
    j = catalog.fx_contributions(spark, sf).join(_preds(spark, sf).select("id", "line", "month", "fold"),
                                                 ["id", "line"])
    return M.filtered_importance(j, (F.col("month") == 7) & (F.col("fold") == 2), _CF)


@query("filtered_importance_fallback", _imp_sql("p.month = 7 AND p.fold = 9"))
def filtered_importance_fallback(spark, sf):
    """M12 when fewer than 5 rows match: all rows are used."""
    j = catalog.fx_contributions(spark, sf).join(_preds(spark, sf).select("id", "line", "month", "fold"),
                                                 ["id", "line"])
    return M.filtered_importance(j, (F.col("month") == 7) & (F.col("fold") == 9), _CF)


_DIR = {"discount": ("c_discount", "l_discount"), "tax": ("c_tax", "l_tax"), "quantity": ("c_quantity", "l_quantity")}


@query("directional_contributions", """
WITH j AS (SELECT c.*, l.l_discount, l.l_tax, l.l_quantity FROM fx_contributions c
           JOIN lineitem l ON c.id = l.l_orderkey AND c.line = l.l_linenumber),
b AS (SELECT min(l_discount) AS lo_d, max(l_discount) AS hi_d, min(l_tax) AS lo_t, max(l_tax) AS hi_t,
             min(l_quantity) AS lo_q, max(l_quantity) AS hi_q FROM j),
s AS (SELECT j.*, b.* FROM j, b ORDER BY (j.id * 7919 + 42 * 104729) % 1000003, j.id, j.line, j.l_discount, j.l_tax, j.l_quantity LIMIT 50)
""" + " UNION ALL ".join(
    f"""SELECT id, line, '{name}' AS feature, {c} AS contribution,
       round(CASE WHEN hi_{v[2]} = lo_{v[2]} THEN 0.5 WHEN {v} IS NULL THEN 0.5
                  ELSE greatest(0.0, least(1.0, ({v} - lo_{v[2]}) / (hi_{v[2]} - lo_{v[2]}))) END, 9) AS scaled_value
FROM s""" for name, (c, v) in _DIR.items()))
def directional_contributions(spark, sf):
    """Contribution vs scaled feature value for a seeded sample."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                                             "l_discount", "l_tax", "l_quantity")
    j = catalog.fx_contributions(spark, sf).join(li, ["id", "line"])
    return M.directional_contributions(j, ["id", "line"], _DIR, 50, 42,
                                       tie_break=["l_discount", "l_tax", "l_quantity"])


_FEATS = ["accommodates", "bedrooms", "bathrooms", "amenity_count", "review_scores_rating",
          "review_scores_location", "is_superhost", "host_response_rate_f", "has_wifi", "has_pool",
          "availability_365", "number_of_reviews", "estimated_occupancy"]


@query("importance_by_category", "WITH m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(abs({c})) AS mean_abs FROM listing_base" for c in _FEATS)
    + f"), c AS (SELECT *, {_feature_category_sql('feature')} AS category FROM m)\n"
    + "SELECT category, round(sum(mean_abs), 6) AS total, count(*) AS n_features FROM c GROUP BY category")
def importance_by_category(spark, sf):
    """Importance summed by feature category."""
    m = R.mean_abs_ranked(listing_base(spark, sf), _FEATS, digits=15)
    return m.withColumn("category", S.feature_category("feature")).groupBy("category").agg(
        F.round(F.sum("mean_abs"), 6).alias("total"), F.count(F.lit(1)).alias("n_features"))
