"""Words are counted without a shuffled row per word, and cleaning keeps its rules."""

import re

from pyspark.sql import functions as F

from lodgelens.operators import text as T


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_text_rules(spark):
    texts = [None, "", "  A\tB\n\n c9d ", "see HTTP://x.y/z and www.a.b now", "wwwx http", "<b>bold</b> <a\nb> 1<2", "it's é—ok!!", "a<b http://q<i>r"]
    want = []
    for t in texts:
        s = re.sub(r"http[^ \t\n\x0b\f\r]+|www\.[^ \t\n\x0b\f\r]+", "", (t or "").lower())
        s = re.sub(r"[^a-z \t\n\x0b\f\r']", " ", re.sub(r"<.*?>", "", s))
        want.append(re.sub(r"[ \t\n\x0b\f\r]+", " ", s).strip(" "))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r["c"] for r in df.select("id", T.clean_text("t").alias("c")).orderBy("id").collect()] == want


def test_doc_terms_shuffle_documents_not_words(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a"]), (None, ["c"]), (2, [])], "id int, toks array<string>")
    dt = T.doc_terms(df, "id", "toks")
    assert "REPARTITION_BY_NUM" in _plan(dt) and _plan(dt).count("Exchange ") == 1
    assert {(r["id"], r["term"]): r["n"] for r in dt.collect()} == {(1, "a"): 3, (1, "b"): 1, (None, "c"): 1}
    docs = df.where(F.size("toks") > 0)
    assert T.vocabulary_from(dt, "id", 1, 1.0, docs).count() == T.vocabulary_from(dt, "id", 1, 1.0).count() == 3


def test_lexicon_is_sent_to_the_words(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(1, "very nice and not nice"), (2, "bad"), (3, "")], "id int, t string")
        lexicon = spark.createDataFrame([("nice", 0.5), ("bad", -0.5)], "word string, polarity double")
        s = T.sentiment_scores(df, "id", "t", lexicon)
        assert "BroadcastHashJoin" in _plan(s)
        assert {r["id"]: round(r["sentiment_score"], 6) for r in s.collect()} == {1: 0.2, 2: -0.5, 3: 0.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ngrams_are_shuffled_only_as_counts(spark):
    """Tokens are made once and their n-grams meet as counts of terms: repeated, null and empty documents count as before."""
    rows = [(1, "aaa bbb aaa bbb"), (1, "ccc bbb"), (2, "aaa bbb"), (3, ""), (None, "ddd eee"), (4, "bbb stop aaa"), (5, None)]
    df = spark.createDataFrame(rows, "review_id long, clean string")
    stops = spark.createDataFrame([("stop",)], "word string")
    t = T.normalise_tokens(df, "review_id", "clean", stops)
    kept = t.checkpoint()
    old = T.vocabulary_from(T.doc_terms(kept.select("review_id", T.ngrams_1_2(F.col("toks")).alias("g")), "review_id", "g"), "review_id", 1, 0.7,
                            kept.where(F.size("toks") > 0))
    new = T.ngram_vocabulary(t, "review_id", "toks", 1, 0.7)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect())) != []
    plan = new._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "ReusedExchange" not in x]
    assert sum("hashpartitioning(term" in x for x in dealt) == 1 and "ReusedExchange" in plan
    assert not any("REPARTITION" in x for x in dealt[:1])  # what is nearest to the result are the counts of terms
