"""Kept ids of the pipeline's stages that have an exact rule, against brute force; number of bands."""

import itertools
import re

import corpus_pipeline
import numpy as np
from lodgelens.llm import minhash


def _docs(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def _shingles(t):
    w = re.findall(r"\S+", t.lower())
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_bands_follow_the_limit():
    assert minhash.bands_for(85, 5) == 25 and minhash.bands_for(100, 5) == 1
    for percent in (60, 80, 85, 90):
        assert (1 - (percent / 100) ** 5) ** minhash.bands_for(percent, 5) <= 4.4e-7


def test_near_dedup_keeps_what_brute_force_keeps(spark, sf, monkeypatch):
    used = []
    grouped = minhash.grouped_rows
    monkeypatch.setattr(minhash, "grouped_rows", lambda own, percent, words, bands, rows: used.append((percent, bands)) or grouped(own, percent, words, bands, rows))
    rng = np.random.default_rng(5)
    base = [rng.choice(["red", "green", "blue", "one", "two", "three", "sun", "moon"], 120).tolist() for _ in range(4)]
    texts = ["", "alone here"]
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, 120))] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, _docs(spark, texts), sf).collect()}
    assert got == set(root)
    (percent, bands), = used
    assert (1 - (percent / 100) ** 5) ** bands <= 4.4e-7


def test_line_dedup_keeps_what_brute_force_keeps(spark, sf):
    line = " ".join(f"w{k}" for k in range(20))
    block = [f"{line} {k}" for k in range(3)]  # 63 words
    texts = ["\n".join(x) for x in (["a b", *block, "end"], block, [*block, "more"], block[:2], ["a b"], [block[0], "gap", block[1], block[2]])]
    seen, want = set(), {}
    for d, t in enumerate(texts):
        seq, gone = t.split("\n"), set()
        for s, e in itertools.combinations(range(len(seq) + 1), 2):
            run = tuple(seq[s:e])
            if sum(len(x.split()) for x in run) >= 50:
                gone |= set(range(s, e)) if run in seen else set()
                seen.add(run)
        left = "\n".join(x for j, x in enumerate(seq) if j not in gone)
        if not gone or left.strip():
            want[d] = left
    out = corpus_pipeline.dedup_lines(spark, _docs(spark, texts), sf).collect()
    assert {r["doc_id"]: r["text"] for r in out} == want and set(want) == {0, 2, 3, 4, 5}
    assert all(r["n_chars"] == len(r["text"]) for r in out)
