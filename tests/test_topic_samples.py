"""The half that clusters are fitted on, and the candidates of diversified words."""

import numpy as np
from pyspark.ml.feature import Word2Vec

from lodgelens.operators import topics as TP
from lodgelens.plans import suite_extra, suite_topics
from lodgelens.sources.tables import table


def test_half_is_drawn_row_by_row(spark, sf):
    ids = table(spark, sf, "embeddings").select("vec_id")
    plan = ids.filter(suite_topics.in_half("vec_id", 42))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrdered" not in plan
    n = ids.count()
    assert 0.4 * n < ids.filter(suite_topics.in_half("vec_id", 42)).count() < 0.6 * n
    assert {r["vec_id"] for r in suite_topics.fit_sample_assign_all(spark, sf).collect()} == {r["vec_id"] for r in ids.collect()}


def test_assignment_uses_the_half(spark, sf, monkeypatch):
    seen = []
    clusters = TP.density_clusters
    monkeypatch.setattr(TP, "density_clusters", lambda df, *a, **k: seen.append(df) or clusters(df, *a, **k))
    suite_topics.fit_sample_assign_all(spark, sf)
    ids = table(spark, sf, "embeddings").filter(suite_topics.in_half("vec_id", 42))
    assert {r["vec_id"] for r in seen[0].collect()} == {r["vec_id"] for r in ids.collect()}


def test_words_without_a_vector_stay(spark):
    rows = [("a", "x", [1.0, 0.0], 3.0), ("a", "y", [0.9, 0.1], 2.0), ("a", "z", None, 1.0), ("b", "u", None, 1.0)]
    df = spark.createDataFrame(rows, "cls string, term string, wv array<double>, weight double")
    got = TP.mmr_words(df, "cls", "term", "wv", "weight").collect()
    assert {(r["cls"], r["term"]) for r in got} == {("a", "x"), ("a", "y"), ("a", "z"), ("b", "u")}


def test_word_vectors_of_all_terms(spark, sf, monkeypatch):
    fits, cands = [], []
    fit, pick = Word2Vec.fit, TP.mmr_words
    monkeypatch.setattr(Word2Vec, "fit", lambda self, df, *a: fits.append((self, df)) or fit(self, df, *a))
    monkeypatch.setattr(TP, "mmr_words", lambda c, *a: cands.append(c) or pick(c, *a))
    suite_extra.mmr_words(spark, sf)
    w2v, docs = fits[0]
    assert w2v.getMinCount() == 1 and w2v.getNumPartitions() == docs.rdd.getNumPartitions()
    assert cands[0].count() == 30 * cands[0].select("cls").distinct().count()
    assert all(np.isfinite(r["wv"]).all() for r in cands[0].collect())
