"""Exact tree contributions (M11) for spark.ml tree ensembles.

Path-dependent Shapley values of tree ensembles (Lundberg, Erion & Lee 2018):
for every row the contributions of all features over all trees, weighted by
the ensemble's tree weights, plus a base value, so that
``base + sum(contributions) == prediction`` (checked in the tests).

A tree is taken as its leaves.  A leaf sees of a row only which of its path's
features lie inside its intervals, so its contributions are looked up in a
table of at most 2 ** depth patterns; a batch of rows goes through a tree in a
few array operations.

The leaves come from the saved model's ``data`` Parquet (node id, children,
split feature and threshold, prediction, training count as cover).  They are
model metadata - trees x nodes, independent of the data size - and are
broadcast once; rows are explained in Arrow batches by ``mapInPandas``, so the
scoring work is partitioned like any other scan.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.sources.io import scratch_path


def tree_tables(model, spark) -> tuple[list[dict], list[float]]:
    """Per tree: arrays of left, right, feature, threshold, value, cover."""
    path = scratch_path(spark, "tree-model")
    model.save(path)
    nodes = spark.read.parquet(path + "/data").select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"),
        F.col("nodeData.prediction").alias("value"), F.col("nodeData.rawCount").alias("cover"))
    pdf = nodes.toPandas()
    trees = []
    for _, g in pdf.groupby("treeID", sort=True):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        t = {k: np.zeros(n) for k in ("threshold", "value", "cover")}
        t.update({k: np.full(n, -1, dtype=np.int64) for k in ("left", "right", "feature")})
        idx = g["id"].to_numpy()
        for k in ("left", "right", "feature"):
            t[k][idx] = g[k].to_numpy()
        for k in ("threshold", "value", "cover"):
            t[k][idx] = g[k].fillna(0.0).to_numpy()
        trees.append(t)
    return trees, list(model.treeWeights)


def leaf_paths(t: dict) -> tuple[np.ndarray, ...]:
    """A tree as its leaves: value [leaf], and per leaf and distinct feature
    on its path (slot) the feature, the interval (lo, hi] that leads there and
    the share z of training rows that go on.  Slots that a leaf lacks hold a
    feature without effect (always inside, z = 1)."""
    leaves, todo = [], [(0, {})]
    while todo:
        j, path = todo.pop()
        if t["left"][j] < 0:
            leaves.append((t["value"][j], path))
            continue
        f = int(t["feature"][j])
        lo, hi, z = path.get(f, (-np.inf, np.inf, 1.0))
        for child, inside in ((t["left"][j], (lo, min(hi, t["threshold"][j]))), (t["right"][j], (max(lo, t["threshold"][j]), hi))):
            todo.append((child, path | {f: (*inside, z * t["cover"][child] / t["cover"][j])}))
    slots = max(1, max(len(p) for _, p in leaves))
    padded = [[(f, *v) for f, v in p.items()] + [(0, -np.inf, np.inf, 1.0)] * (slots - len(p)) for _, p in leaves]
    f, lo, hi, z = np.moveaxis(np.array(padded), 2, 0)
    return np.array([v for v, _ in leaves]), f.astype(np.int64), lo, hi, z


def pattern_table(value: np.ndarray, z: np.ndarray) -> np.ndarray:
    """[leaf, pattern, slot]: a leaf's Shapley contribution to each slot's
    feature when the row is inside the slots whose bits the pattern has.

    Whether a row is inside is all that a leaf knows of it, so 2 ** slots
    patterns cover every row.  For slot i the polynomial over the other slots
    collects, by the number k of features known, the product of "inside" for
    those known and z for the rest; k known of d weigh k! (d - 1 - k)! / d!."""
    d = z.shape[1]
    bits = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    out = np.zeros((len(z), 1 << d, d))
    for i in range(d):
        known = np.zeros((len(z), 1 << d, d))
        known[:, :, 0] = 1
        for j in range(d):
            if j != i:
                more = np.roll(known, 1, axis=2)
                more[:, :, 0] = 0
                known = known * z[:, None, j, None] + more * bits[None, :, j, None]
        out[:, :, i] = value[:, None] * (bits[None, :, i] - z[:, None, i]) * (known @ weight)
    return out


def tree_contributions(x: np.ndarray, paths: tuple[np.ndarray, ...]) -> np.ndarray:
    """[row, feature] contributions of one tree to a batch of rows."""
    value, f, lo, hi, z = paths
    at = x[:, f]  # row, leaf, slot
    inside = ~(at <= lo) & (np.isinf(hi) | (at <= hi))  # a missing value goes right
    pattern = (inside << np.arange(f.shape[1])).sum(axis=2)
    c = pattern_table(value, z)[np.arange(len(value)), pattern]
    onto = np.zeros((f.size, x.shape[1]))
    onto[np.arange(f.size), f.ravel()] = 1
    return c.reshape(len(x), -1) @ onto


def contributions(df: DataFrame, model, features: list[str], id_cols: list[str], rows: int = 512) -> DataFrame:
    """One row per input row: ids, base value, prediction and one
    contribution column per feature (``c_<feature>``).  Whole batches go
    through a tree at once; ``rows`` bounds what a tree's patterns take."""
    spark = df.sparkSession
    trees, weights = tree_tables(model, spark)
    paths = [leaf_paths(t) for t in trees]
    base = float(sum(w * (value * z.prod(axis=1)).sum() for w, (value, _, _, _, z) in zip(weights, paths)))
    held = spark.sparkContext.broadcast((paths, weights))  # as large as the model
    out_cols = [f"c_{f}" for f in features]

    def explain(batches):
        for whole in batches:
            for start in range(0, len(whole), rows):
                pdf = whole.iloc[start:start + rows]
                x = pdf[features].to_numpy(dtype=float)
                phi = sum((w * tree_contributions(x, p) for p, w in zip(*held.value)), np.zeros((len(x), len(features))))
                yield pd.concat([pdf[id_cols].reset_index(drop=True),
                                 pd.DataFrame({"base_value": base, "prediction": base + phi.sum(axis=1)}),
                                 pd.DataFrame(phi, columns=out_cols)], axis=1)

    schema = ", ".join([f"`{c}` {t}" for c, t in df.select(*id_cols).dtypes]
                       + ["base_value double", "prediction double"] + [f"`{c}` double" for c in out_cols])
    src = df.select(*id_cols, *[F.col(f).cast("double").alias(f) for f in features])
    return src.mapInPandas(explain, schema)


def mean_abs_contributions(contrib: DataFrame, features: list[str]) -> DataFrame:
    """M11 summary: mean |contribution| per feature (A29 over the output)."""
    from lodgelens.operators.relational import mean_abs_ranked
    m = mean_abs_ranked(contrib, [f"c_{f}" for f in features])
    return m.withColumn("feature", F.regexp_replace("feature", "^c_", ""))
