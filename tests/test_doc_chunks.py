"""Documents of listings in chunks of bounded size, against plain Python."""

import hashlib

from lodgelens.operators import relational as R
from lodgelens.plans import suite_text
from lodgelens.sources import catalog


def _whole(rows, key):
    docs = {}
    for r in sorted(rows, key=lambda r: r["chunk"]):
        docs.setdefault(r[key], []).extend([] if r["doc"] is None else [r["doc"]])
    return {k: " ".join(v) for k, v in docs.items()}


def test_hot_key_is_chunked(spark):
    rows = [("hot", i, f"text {i} é") for i in range(3000)] + [("a", 2, "y"), ("a", 1, "x"), ("a", 3, None), ("n", 1, None), ("e", 1, ""), ("e", 2, "")]
    rows.append(("long", 1, "z" * 5000))
    df = spark.createDataFrame(rows, "k string, o int, t string").repartition(7)
    chunks = R.concat_chunks(df, "k", "o", "t", max_chars=1000)
    got = chunks.collect()
    want = {k: " ".join(t for kk, _, t in sorted(rows, key=lambda r: r[1]) if kk == k and t is not None) for k in {r[0] for r in rows}}
    assert _whole(got, "k") == want
    assert max(len(r["doc"] or "") for r in got if r["k"] != "long") < 1000 + 20
    assert sum(r["k"] == "hot" for r in got) > 30 and sum(r["n_docs"] for r in got) == len(rows)
    digests = {r["k"]: r["digest"] for r in R.chunks_digest(chunks, "k").collect()}
    assert digests == {k: hashlib.md5(v.encode()).hexdigest() for k, v in want.items()}


def test_chunks_hold_whole_documents(spark, sf):
    rows = catalog.fx_comments(spark, sf).select("listing_id", "review_id", "comments").collect()
    want = {}
    for r in sorted(rows, key=lambda r: r["review_id"]):
        want.setdefault(r["listing_id"], []).extend([] if r["comments"] is None else [r["comments"]])
    assert _whole(suite_text.concat_doc_chunks(spark, sf).collect(), "listing_id") == {k: " ".join(v) for k, v in want.items()}
