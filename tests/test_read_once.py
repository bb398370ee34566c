"""Jobs that need a corpus' counts several times compute them once."""

from pyspark.sql import functions as F

from lodgelens.operators import text as T
from lodgelens.operators import topics as TP

ROWS = [(d, c, t, 1 + d % 3) for d in range(40) for c in [f"c{d % 4}"] for t in (f"w{d % 4}", f"w{d % 3}", f"v{d % 5}")]


def _counted(spark, seen):
    def see(i):
        seen.add(1)
        return i
    dt = spark.createDataFrame(ROWS, "review_id int, cls string, term string, n long")
    return dt.withColumn("review_id", F.udf(see, "int")("review_id")).where("review_id >= 0")


def test_merging_reads_the_documents_once(spark):
    seen = spark.sparkContext.accumulator(0)
    got = {r["orig"]: r["topic"] for r in TP.merge_topics(_counted(spark, seen), "cls", 2).collect()}
    assert set(got) == {"c0", "c1", "c2", "c3"} and len(set(got.values())) == 2
    assert seen.value <= len(ROWS)


def test_tokens_look_stop_words_up_in_a_set(spark):
    df = spark.createDataFrame([("The ab host's x9yz, Great abc-abcd é9fgh",), ("",), (None,)], "t string")
    got = df.select(T.tokens("t").alias("a"), T.tokens("t", ["the"], 1).alias("b"), T.tokens("t", [], 2).alias("c"))
    assert [r["a"] for r in got.collect()] == [["the", "abc", "abcd", "fgh"], [], None]
    assert [r["b"] for r in got.collect()][0] == ["ab", "host", "s", "x", "yz", "great", "abc", "abcd", "fgh"]
    assert [r["c"] for r in got.collect()][0] == ["the", "ab", "host", "yz", "great", "abc", "abcd", "fgh"]
    plan = got.select("a")._jdf.queryExecution().executedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan
