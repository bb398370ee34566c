"""Dashboard datasets (Q12-Q22): the data behind each chart as a DataFrame.

Scalar inputs of a chart (medians, ranges, percentiles) are 1-row aggregates
attached by broadcast; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.functions import scalar as S
from lodgelens.operators import ranks
from lodgelens.operators import relational as R


def kpi_row(preds: DataFrame, season: DataFrame, month: int) -> DataFrame:
    """Q12: n, median listed, median predicted, delta and its label, index."""
    mid = ranks.medians(preds, {"median_listed": F.col("price_numeric"), "median_pred": F.col("pred_price")})
    k = preds.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(mid))
    idx = season.filter(F.col("month") == month).agg(F.max("seasonal_index").alias("seasonal_index"))
    delta = F.col("median_pred") - F.col("median_listed")
    return k.crossJoin(F.broadcast(idx)).select(
        "n", F.round("median_listed", 6).alias("median_listed"), F.round("median_pred", 6).alias("median_pred"),
        F.round(delta, 6).alias("delta"),
        F.when(delta > 0, F.lit("seasonal premium")).otherwise(F.lit("seasonal discount")).alias("delta_label"),
        "seasonal_index")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Q13: fixed-width bins between min and max (last bin closed), with the
    column's mean and median; bins are counted by a partial aggregate."""
    d = df.filter(F.col(col).isNotNull())
    t = R.attach_scalars(d, _lo=F.min(col), _hi=F.max(col), mean=F.avg(col))
    t = t.crossJoin(F.broadcast(ranks.medians(d, {"median": F.col(col)})))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    g = t.groupBy(b.alias("bin"), "_lo", "_hi", "mean", "median").agg(F.count(F.lit(1)).alias("n"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return g.select("bin", F.round(F.col("_lo") + F.col("bin") * w, 6).alias("bin_start"),
                    F.round(F.col("_lo") + (F.col("bin") + 1) * w, 6).alias("bin_end"), "n",
                    F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


def box_stats(df: DataFrame, key: str, col: str) -> DataFrame:
    """Q14: quartiles, 1.5 IQR whiskers (most extreme values inside the
    fences) and outlier counts per category; rows are counted per distinct
    value before they meet the quartiles."""
    d = df.filter(F.col(key).isNotNull() & F.col(col).isNotNull()).groupBy(key, col).agg(F.count(F.lit(1)).alias("_c"))
    q = ranks.quantiles(df, {"_q": F.col(col)}, [0.25, 0.5, 0.75], key).withColumnsRenamed({"_q_0": "q1", "_q_1": "median", "_q_2": "q3"})
    j = d.join(q, key)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = (F.col(col) >= lo_f) & (F.col(col) <= hi_f)
    out = j.groupBy(key, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(col))).alias("lower_whisker"),
        F.max(F.when(inside, F.col(col))).alias("upper_whisker"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_c"))).alias("n_outliers"), F.sum("_c").alias("n"))
    return out.select(key, *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "lower_whisker", "upper_whisker")],
                      "n_outliers", "n")


def local_trend(df: DataFrame, x: str, y: str, by: str, n_grid: int, bandwidth_frac: float) -> DataFrame:
    """Q16: local linear regression of y on x with tricube weights at
    ``n_grid + 1`` evenly spaced points over x's range, per group.

    No range join: each row is exploded to the grid points within one
    bandwidth of its x (at most 2h/step + 1 of them), then weighted sums are
    aggregated per (group, grid point) - a partial aggregate.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(by).isNotNull())
    t = R.attach_scalars(d, _lo=F.min(x), _hi=F.max(x))
    step = (F.col("_hi") - F.col("_lo")) / n_grid
    h = (F.col("_hi") - F.col("_lo")) * bandwidth_frac
    # one extra grid point each side absorbs rounding; the exact u < 1 test decides
    k_lo = F.greatest(F.lit(0), F.ceil((F.col(x) - h - F.col("_lo")) / step) - 1)
    k_hi = F.least(F.lit(n_grid), F.floor((F.col(x) + h - F.col("_lo")) / step) + 1)
    t = t.filter(F.col("_hi") > F.col("_lo")).withColumn(
        "k", F.explode(F.sequence(k_lo.cast("int"), k_hi.cast("int"))))
    g = F.col("_lo") + F.col("k") * (F.col("_hi") - F.col("_lo")) / n_grid
    u = F.abs(F.col(x) - g) / h
    w = F.when(u < 1, F.pow(1 - F.pow(u, 3), 3)).otherwise(F.lit(0.0))
    dx = F.col(x) - g
    t = t.withColumn("w", w).withColumn("dx", dx).filter((u < 1) & (F.col("w") > 0))
    s = t.groupBy(by, "k", "_lo", "_hi").agg(
        F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("dx")).alias("s1"),
        F.sum(F.col("w") * F.col("dx") * F.col("dx")).alias("s2"), F.sum(F.col("w") * F.col(y)).alias("t0"),
        F.sum(F.col("w") * F.col("dx") * F.col(y)).alias("t1"), F.count(F.lit(1)).alias("n"))
    den = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = F.when(F.abs(den) > 1e-12, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / den).otherwise(
        F.col("t0") / F.col("s0"))
    return s.select(by, F.col("k").cast("int").alias("k"),
                    F.round(F.col("_lo") + F.col("k") * (F.col("_hi") - F.col("_lo")) / n_grid, 6).alias("x"),
                    F.round(fit, 4).alias("fit"), "n")


def season_rows(season: DataFrame, month: int, months=(4, 11)) -> DataFrame:
    """Q17: months in range, the selected one flagged, y-range +/-10 %."""
    d = season.filter(F.col("month").between(*months))
    t = R.attach_scalars(d, _mn=F.min("seasonal_index"), _mx=F.max("seasonal_index"))
    return t.select("month", S.month_name("month").alias("month_name"), "seasonal_index",
                    (F.col("month") == month).cast("int").alias("selected"),
                    F.round(F.col("_mn") * 0.9, 6).alias("y_min"), F.round(F.col("_mx") * 1.1, 6).alias("y_max"))


def map_rows(preds: DataFrame, lo_q: float = 0.05, hi_q: float = 0.95) -> DataFrame:
    """Q18: predicted prices with log price and a percentile color range."""
    d = preds.withColumn("log_pred_price", F.log("pred_price"))
    qs = R.exact_quantiles(d, "log_pred_price", [lo_q, hi_q], "_q")
    t = d.crossJoin(F.broadcast(qs))
    return t.select("id", "latitude", "longitude", "neighbourhood", "room_type",
                    F.round("pred_price", 6).alias("pred_price"), F.round("log_pred_price", 9).alias("log_pred_price"),
                    F.round(F.col("_q0"), 9).alias("color_min"), F.round(F.col("_q1"), 9).alias("color_max"))


def bounding_box(df: DataFrame) -> DataFrame:
    """Q19."""
    return df.agg(F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
                  F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max")).withColumns({
        "lat_center": F.round((F.col("lat_min") + F.col("lat_max")) / 2, 9),
        "lon_center": F.round((F.col("lon_min") + F.col("lon_max")) / 2, 9)})


def score_radar(df: DataFrame, ids: list[int], scores: list[str]) -> DataFrame:
    """Q20: scores of selected listings, long form with a short id label."""
    d = df.filter(F.col("id").isin(ids))
    return d.select("id", S.short_id("id").alias("label"), *scores).unpivot(
        ["id", "label"], scores, "score", "value")


def explorer_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q22: the filtered rows sorted by price, descending, ties by id."""
    return df.select(*cols).orderBy(F.desc_nulls_last("price_numeric"), "id")
