"""DBSCAN against a numpy reference; metric formulas against numpy."""

import numpy as np
from pyspark.sql import functions as F

from lodgelens.operators import model as M
from lodgelens.operators import topics as TP


def _dbscan(x, eps, min_samples, min_size):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= min_samples
    lab = np.where(core, np.arange(n), -1)
    changed = True
    while changed:
        changed = False
        for i in np.where(core)[0]:
            m = lab[nb[i] & core].min()
            if m < lab[i]:
                lab[i] = m
                changed = True
    for i in np.where(~core)[0]:
        c = lab[nb[i] & core]
        lab[i] = c.min() if len(c) else -1
    out = np.full(n, -1)
    ids = [l for l in sorted(set(lab) - {-1}, key=lambda l: np.where(lab == l)[0].min()) if (lab == l).sum() >= min_size]
    for k, l in enumerate(ids):
        out[lab == l] = k
    return out


def test_dbscan_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.05, (40, 3)), rng.normal(1, 0.05, (30, 3)), rng.uniform(-2, 3, (15, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in TP.density_clusters(df, "id", "v", 0.15, 4, 5).collect()}
    want = _dbscan(x, 0.15, 4, 5)
    assert [got[i] for i in range(len(x))] == list(want)


def test_dbscan_chains_copies_and_high_dimensions(spark):
    """Chains through many thin cells, a hot group of copies beside them, five dimensions."""
    rng = np.random.default_rng(8)
    t = np.linspace(0, 1, 120)
    chain = np.stack([np.cos(6 * t), np.sin(6 * t), t, t * 0.5, -t], axis=1) + rng.normal(0, 0.01, (120, 5))
    copies = np.repeat(np.array([[1.0, 0.0, 0.0, 0.0, 0.1]]), 1500, axis=0)
    loose = rng.normal(0.5, 0.25, (150, 5))
    x = np.vstack([chain, copies, loose, rng.uniform(-3, 3, (40, 5))])[rng.permutation(1810)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    for eps, least in ((0.18, 4), (0.3, 8)):
        got = {r["id"]: r["cluster"] for r in TP.density_clusters(df, "id", "v", eps, least, 5).collect()}
        assert [got[i] for i in range(len(x))] == list(_dbscan(x, eps, least, 5))
    assert TP.density_clusters(df.limit(0), "id", "v", 0.1, 3, 3).count() == 0


def test_components(spark):
    from lodgelens.operators.graph import components
    e = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {k: 200 for k in (200, 201, 202)}


def test_regression_metrics(spark):
    t = np.array([100.0, 200.0, 50.0, 80.0])
    p = np.array([110.0, 190.0, 60.0, 70.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, p)], "t double, p double")
    r = M.regression_metrics(df, "t", "p").first()
    yt, yp = np.log1p(t), np.log1p(p)
    assert abs(r["rmse_log"] - round(np.sqrt(((yt - yp) ** 2).mean()), 6)) < 1e-9
    r2 = 1 - ((yt - yp) ** 2).sum() / ((yt - yt.mean()) ** 2).sum()
    assert abs(r["r2"] - round(r2, 6)) < 1e-9
    assert abs(r["medae"] - np.median(np.abs(t - p))) < 1e-9


def test_fold_assignment_is_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "id")
    a = df.repartition(7).select("id", M.fold_of("id").alias("f")).collect()
    b = df.repartition(3).select("id", M.fold_of("id").alias("f")).collect()
    assert sorted(a) == sorted(b)
    assert {r["f"] for r in a} == {0, 1, 2, 3, 4}


def test_bag_vectors_and_lda_invariants(spark):
    from lodgelens.operators import lda as L
    rows = [("a", "x", 3), ("a", "y", 1), ("b", "x", 2), ("b", "z", 5), ("c", "y", 4), ("c", "z", 1)]
    kt = spark.createDataFrame(rows, "k string, term string, n long")
    bow, vocab = L.bag_vectors(kt, "k", min_df=1, max_df=1.0)
    words = {r["term_index"]: r["word"] for r in vocab.collect()}
    got = {r["k"]: {words[i]: v for i, v in zip(r["bow"].indices, r["bow"].values)} for r in bow.collect()}
    assert got == {"a": {"x": 3.0, "y": 1.0}, "b": {"x": 2.0, "z": 5.0}, "c": {"y": 4.0, "z": 1.0}}
    model = L.fit_lda_vectors(bow, 2, passes=1, seed=1)
    dist = L.topic_distribution(model, bow, ["k"]).groupBy("k").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in dist)
