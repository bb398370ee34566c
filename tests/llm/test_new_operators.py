"""Lexical search, hard negatives and mixing against brute force, on odd inputs too."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgelens.llm import hardneg, lexical, mixing, queries

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


# ---- ranked lexical search

def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(TERM, low)


def brute_search(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    N, L = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for doc, c, n in counted:
            m = 100 - 50 + (50 * n * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        for rank, (s, _, _, doc) in enumerate(sorted(found)[:k], 1):
            out[item, rank, doc, -s] += 1
    return out


def searched(spark, docs, items, k=50, **sizes):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS m", "'x' AS o", "2 AS rank", "3 AS item_id")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS row", "0.5 AS score", "7 AS doc_id")
    index, n = lexical.build_index(d.repartition(3), **sizes)
    return Counter(tuple(r) for r in lexical.search(index, n, i, k=k).collect())


ODD = [(1, "Alpha beta ALPHA"), (2, None), (3, ""), (4, "... ---"), (None, "alpha gamma"), (5, "Ünï ünï ünï Ü"), (6, "beta " * 3000), (7, "alpha beta"),
       (8, "alpha beta"), (7, "alpha beta"), (9, "日本語 テスト x1 2y"), (10, "K alpha beta")]


def test_search_odd(spark):
    items = [(1, "ALPHA, beta!"), (2, None), (3, ""), (4, "nowhere"), (1, "gamma"), (None, "ünï テスト"), (5, "beta\x00alpha  beta")]
    assert searched(spark, ODD, items) == brute_search(ODD, items, 50)
    assert searched(spark, ODD, items, k=2) == brute_search(ODD, items, 2)
    assert not searched(spark, [], items) and not searched(spark, ODD, []) and not searched(spark, [(1, None)], items)


def test_search_equals_brute_force_in_small_blocks(spark):
    """Many strata and copies, so that rounds, bounds and thresholds all matter."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    weight = 1 / np.arange(1, 61)
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 90)), p=weight / weight.sum()))) for i in range(700)]
    docs += [(1000 + i, "w3 w50 w59 w3") for i in range(120)]
    items = [(i, " ".join(rng.choice(words, 12, p=weight / weight.sum()))) for i in range(12)] + [(99, "w59 w50")]
    assert searched(spark, docs, items, k=20, block_docs=5, part_postings=500) == brute_search(docs, items, 20)


def test_search_by_item_blocks(spark):
    index, n = lexical.build_index(spark.createDataFrame(ODD, "doc_id long, text string"))
    items = spark.createDataFrame([(i, "alpha beta") for i in range(9)], "item_id long, text string")
    whole = sorted(map(tuple, lexical.search(index, n, items).collect()))
    assert whole == sorted(map(tuple, lexical.search(index, n, items, block_entries=20).collect())) and len({r[0] for r in whole}) == 9


# ---- hard negatives

def brute_negatives(rows, anchors, npos=5, nneg=3):
    ok = [(k, i, lab, [math.floor(256 * x) for x in v]) for k, (i, lab, v) in enumerate(rows)
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    last = 1 << 62
    for ka, ia, la, va in ok:
        if not anchors(ia):
            continue
        scored = [(-sum(a * b for a, b in zip(va, v)), last if i is None else i, k, i, lab) for k, i, lab, v in ok if k != ka]
        positives = sorted(s for s in scored if s[4] == la)[:npos]
        for p in positives:
            band = sorted(s for s in scored if s[4] != la and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0])[:nneg]
            for rank, s in enumerate(band, 1):
                out[ia, p[3], rank, s[3], -p[0], -s[0]] += 1
    return out


def mined(spark, rows, anchors, **settings):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").coalesce(1).selectExpr("*", "'x' AS row", "1 AS o", "2 AS ints")
    found = hardneg.hard_negatives(df, anchors, F.col("label"), **settings)
    return Counter(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(0.2, 0.3, (260, 11))
    base[100:140] = base[7]  # copies under several labels
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(300, None, [0.5] * 11), (301, 1, None), (302, 1, [float("nan")] + [0.1] * 10), (303, 1, [None] * 11), (304, 2, [float("inf")] * 11),
             (305, 1, [0.0] * 11), (306, 0, []), (307, 2, [0.4, -0.3]), (None, 1, [0.3] * 11), (10, 1, [0.31] * 11), (310, 5, [9.5, -7.25] + [3.0] * 9)]
    want = brute_negatives(rows, lambda i: i is not None and i % 10 == 0)
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == want and len(want) > 100
    assert mined(spark, rows, F.col("vec_id") % 10 == 0, block=4) == want  # several blocks of anchors
    assert not mined(spark, rows[:0], F.lit(True)) and not mined(spark, rows, F.lit(False)) and not mined(spark, rows[260:262], F.lit(True))


def test_negatives_wide_values_use_64_bits(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, [float(x) for x in rng.normal(3000, 40, 9)]) for i in range(40)]
    assert mined(spark, rows, F.col("vec_id") < 5) == brute_negatives(rows, lambda i: i < 5)
    with pytest.raises(ValueError):
        mined(spark, [(1, 1, [1e12]), (2, 1, [1e12])], F.lit(True))


def test_subset_sums_and_planes_give_inner_products():
    rng = np.random.default_rng(0)
    a, c = rng.integers(-700, 700, (5, 19)), rng.integers(-700, 700, (33, 19))
    got = hardneg.scores(hardneg.subset_sums(a, np.int64), hardneg.bit_planes(c, 11))
    assert (got == c @ a.T).all()


# ---- mixing

def sizes_of(rows):
    return [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in rows]


def targets_of(sized, weights=(3, 1, 2), share=1.5, cap=2):
    own = defaultdict(int)
    for _, s, n in sized:
        own[s] += n
    order = sorted(own, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, fixed, open_ = share * sum(own.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > cap * own[s] + 1e-9}
        if not over:
            return fixed | {s: w[s] * level for s in open_}, own
        for s in over:
            fixed[s] = float(cap * own[s])
            left -= fixed[s]
        open_ -= over
    return fixed, own


def check_mix(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr(
        "*", "1 AS size", "'a' AS key", "2 AS target", "3 AS place", "4 AS row", "5 AS taken", "6 AS copy")
    sized = sizes_of(rows)
    target, own = targets_of(sized)
    got = mixing.taken_words(df.repartition(3)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(sized)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == own[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) == sum(own.values()) * 3 // 2
    for s, t in target.items():
        assert abs(taken[s] - t) <= len(target)  # words that the rounded targets leave over
    again = Counter(map(tuple, mixing.taken_words(df.repartition(7)).collect()))
    assert again == Counter(map(tuple, got))
    order = sorted(mixing.mix(df).collect(), key=lambda r: r["position"])
    at = 0
    for r in order:  # gapless, and at any time each source has had about its share
        assert r["position"] == at and 0 < r["taken"] <= r["words"]
        at += r["taken"]
    return order, target


def test_mix_reaches_targets_in_proportion(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else f"s{int(rng.integers(0, 9))}"
        rows.append((i, source, "word " * int(rng.integers(0, 120)) if i != 5 else "long " * 4000))
    order, target = check_mix(spark, rows)
    seen, total = Counter(), 0
    for r in order:
        seen[r["source"]] += r["taken"]
        total += r["taken"]
        share = total / sum(target.values())
        assert all(abs(seen[s] - share * t) <= 4000 + share for s, t in target.items())


def test_mix_odd(spark):
    rows = [(1, "b", "x y z"), (1, "b", "x y z"), (2, None, "one two"), (None, "é", "a\tb\nc\x0bd"), (3, "é", None), (4, "a", ""), (5, "a", "  "),
            (6, "Z", "w " * 500), (7, "Z", "v " * 3), (8, "c", "   ")]
    check_mix(spark, rows)
    kind = "doc_id long, source string, text string"
    assert mixing.taken_words(spark.createDataFrame([], kind)).count() == 0
    wordless = mixing.taken_words(spark.createDataFrame([(1, "a", None), (2, "b", " ")], kind)).collect()
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in wordless) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_queries_return_the_contract_columns(spark, sf):
    want = {"op11_lexical": "item_id bigint, rank int, doc_id bigint, score bigint",
            "op12_hardneg": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
            "op13_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"}
    for name, kind in want.items():
        df = queries.QUERIES[name](spark, sf)
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == kind


# ---- earlier operators: nothing is lost or wrapped without a word

def test_all_gzip_members_are_read():
    import gzip
    import zlib

    from lodgelens.llm import warc
    parts = [b"first", b"", b"x" * 100_000]
    whole = b"".join(map(gzip.compress, parts))
    assert warc.inflated(whole) == b"".join(parts) and warc.inflated(b"") == b""
    for broken in (whole[:-5], whole + b"rest"):
        with pytest.raises(zlib.error):
            warc.inflated(broken)


def test_ids_beyond_the_width_raise(spark, tmp_path, monkeypatch):
    import public_tokenizers

    from lodgelens.llm import tokencount
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    with pytest.raises(ValueError):
        tokencount.write_files(docs, f"file://{tmp_path}/a", path, 70000)
    with pytest.raises(Exception, match="doesn't fit"):
        tokencount.write_files(docs, f"file://{tmp_path}/b", path, 7, width="<u1").collect()
