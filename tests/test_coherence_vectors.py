"""Window coherence, hashed vectors and topic correlations against direct computations."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from lodgelens.operators import text as T
from lodgelens.operators import topics as TP


def _texts():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(25)]
    texts = [list(rng.choice(words, int(n))) for n in (0, 1, 5, 9, 10, 11, 40, 300)]
    return texts + [["w1"] * 60, ["a", "b"] * 30 + ["w2"]]


@pytest.mark.parametrize("window,block", [(10, 4), (10, 1024), (1, 3)])
def test_cv_equals_windows_one_by_one(spark, window, block, monkeypatch):
    texts = _texts()
    topics = {"x": ["w1", "w2", "w3"], "y": ["w3", "w9", "a"], "z": ["a", "b"]}
    seen, total = [], 0
    for t in texts:
        if t:
            starts = range(max(1, len(t) - window + 1))
            total += len(starts)
            seen += [set(t[s:s + window]) for s in starts]
    p = lambda *w: sum(all(x in s for x in w) for s in seen) / total

    def npmi(a, b):
        pij = p(a, b) + 1e-12
        return math.log(pij / (p(a) * p(b))) / -math.log(pij)
    want = {}
    for t, ws in topics.items():
        v = np.array([[npmi(a, b) for b in ws] for a in ws])
        whole = v.sum(axis=0)
        want[t] = np.mean([row @ whole / np.linalg.norm(row) / np.linalg.norm(whole) for row in v])
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, toks array<string>").repartition(3)
    words = spark.createDataFrame([(t, w) for t, ws in topics.items() for w in ws], "t string, term string")
    islands = T.window_islands
    monkeypatch.setattr(T, "window_islands", lambda *a: islands(*a, block=block))
    got = {r["t"]: r["coherence"] for r in T.cv_coherence(docs, "id", "toks", words, "t", window).collect()}
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_hashed_vectors_are_signed_sums(spark):
    rows = [(1, "red", 2), (1, "blue", 1), (2, "red", 1), (3, "green", 4)]
    dt = spark.createDataFrame(rows, "id long, term string, n long")
    got = {r["id"]: r["vector"] for r in T.dense_vectors(T.hashed_vectors(dt, "id", 8), "id", 8).collect()}
    df = {"red": 2, "blue": 1, "green": 1}
    for doc in (1, 2, 3):
        want = np.zeros(8)
        for d, t, n in rows:
            if d == doc:
                h = hashlib.md5(t.encode()).hexdigest()
                want[int(h[:8], 16) % 8] += n * math.log(4 / (df[t] + 1)) * (1 if int(h[8], 16) < 8 else -1)
        assert np.allclose(got[doc], want)


def test_topic_correlations(spark):
    rng = np.random.default_rng(2)
    m = rng.random((50, 4)) * (rng.random((50, 4)) < 0.6)
    m[:, 3] = 0.25  # constant
    rows = [(k, t, float(m[k, t])) for k in range(50) for t in range(4) if m[k, t] or t == 0]
    got = {(r["topic_a"], r["topic_b"]): r["r"] for r in
           TP.topic_correlations(spark.createDataFrame(rows, "k long, t int, v double"), "k", "t", "v").collect()}
    for a, b in itertools.combinations(range(4), 2):
        if b == 3:
            assert got[a, b] is None or abs(got[a, b]) < 1e-3
        else:
            assert got[a, b] == pytest.approx(np.corrcoef(m[:, a], m[:, b])[0, 1], abs=1e-9)


def test_merging_classes_without_a_common_word_raises(spark):
    dt = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("c", "z", 1)], "cls string, term string, n long")
    with pytest.raises(ValueError):
        TP.merge_topics(dt, "cls", 1)
    close = spark.createDataFrame([("a", "x", 5), ("b", "x", 4), ("b", "y", 1), ("c", "z", 3), ("c", "y", 1)], "cls string, term string, n long")
    merged = {r["orig"]: r["topic"] for r in TP.merge_topics(close, "cls", 2).collect()}
    assert merged == {"a": "a", "b": "a", "c": "c"}
