"""A streaming job's result equals its batch twin."""

from pyspark.sql import functions as F

from lodgelens.operators import text as T
from lodgelens.sources.tables import table
from lodgelens.streaming import jobs as J


def test_stream_vocabulary_equals_batch(spark, sf):
    s = J.stream_vocabulary(spark, f"{sf}/documents*.parquet",
                            "doc_id long, text string, lang string, source string, n_chars long")
    d = table(spark, sf, "documents").filter(F.col("lang") == "en")
    b = d.select("doc_id", F.explode(F.array_distinct(T.tokens(T.clean_text("text")))).alias("term")) \
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_stream_vocabulary_two_batches(spark, sf, tmp_path):
    """Two files arrive as two micro-batches; the update log collapses to
    the same document frequencies as one batch over both."""
    docs = table(spark, sf, "documents")
    for part in (0, 1):
        docs.filter(F.col("doc_id") % 2 == part).coalesce(1).write.parquet(str(tmp_path / f"part{part}"))
    s = J.stream_vocabulary(spark, str(tmp_path / "part*" / "*.parquet"),
                            "doc_id long, text string, lang string, source string, n_chars long",
                            max_files_per_trigger=1)
    d = docs.filter(F.col("lang") == "en")
    b = d.select("doc_id", F.explode(F.array_distinct(T.tokens(T.clean_text("text")))).alias("term")) \
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _frequencies(docs):
    d = docs.filter(F.col("lang") == "en")
    return sorted(map(tuple, d.select("doc_id", F.explode(F.array_distinct(T.tokens(T.clean_text("text")))).alias("term"))
                      .groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()))


def _part(docs, k, n, folder):
    docs.filter(F.col("doc_id") % n == k).coalesce(1).write.parquet(str(folder / f"part{k}"))


def test_restart_reads_only_new_files(spark, sf, tmp_path):
    """A second call with the same folders goes on where the first stopped."""
    docs = table(spark, sf, "documents")
    src, out, ckpt = str(tmp_path / "part*" / "*.parquet"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    _part(docs, 0, 3, tmp_path)
    first = J.stream_vocabulary(spark, src, SCHEMA, out=out, checkpoint=ckpt)
    assert sorted(map(tuple, first.collect())) == _frequencies(docs.filter("doc_id % 3 = 0"))
    _part(docs, 1, 3, tmp_path)
    second = J.stream_vocabulary(spark, src, SCHEMA, out=out, checkpoint=ckpt)
    assert sorted(map(tuple, second.collect())) == _frequencies(docs.filter("doc_id % 3 < 2"))
    epochs = {r["epoch"] for r in spark.read.parquet(out).select("epoch").distinct().collect()}
    assert epochs == {0, 1}  # one micro-batch a call: the first file wasn't read again
    ingest = [J.stream_ingest(spark, src, SCHEMA, out=str(tmp_path / "clean"), checkpoint=str(tmp_path / "clean-ckpt")).count() for _ in range(2)]
    assert ingest[0] == ingest[1] == docs.filter("doc_id % 3 < 2 AND lang = 'en'").count()


def test_compaction_and_replay(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    for k in range(6):
        _part(docs, k, 6, tmp_path)
    out = str(tmp_path / "out")
    s = J.stream_vocabulary(spark, str(tmp_path / "part*" / "*.parquet"), SCHEMA, max_files_per_trigger=1, out=out,
                            checkpoint=str(tmp_path / "ckpt"), compact_every=2)
    want = _frequencies(docs)
    assert sorted(map(tuple, s.collect())) == want
    log = spark.read.parquet(out)
    assert {r["epoch"] for r in log.select("epoch").distinct().collect()} == {4, 5}  # 4 is full, older folders are empty
    # a replay of the last micro-batch replaces its own folder
    last, rows = log.where("epoch = 5").select("term", "df").collect(), log.count()
    J.epoch_sink(out, "term string, df long", ["term"], 2)(spark.createDataFrame(last, "term string, df long"), 5)
    assert spark.read.parquet(out).count() == rows
    assert sorted(map(tuple, J.current(spark, out, "term string, df long", ["term"]).collect())) == want


def test_late_rows_are_dropped(spark, tmp_path):
    """The stated rule: older than the newest event seen before, less the watermark."""
    kind = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    day = lambda d: f"1, 1, 'O', 1.0D, timestamp_ntz'{d} 00:00:00', 'x'"
    put = lambda name, *days: spark.sql(" UNION ALL ".join(f"SELECT {day(d)}" for d in days)).toDF(
        *[c.split()[0] for c in kind.split(", ")]).coalesce(1).write.parquet(str(tmp_path / name))
    args = dict(out=str(tmp_path / "out"), checkpoint=str(tmp_path / "ckpt"))
    src = str(tmp_path / "f*" / "*.parquet")
    put("f1", "2020-06-01", "2020-06-02")
    J.stream_review_volume(spark, src, kind, **args)
    put("f2", "2020-06-02", "2020-05-20", "2020-01-01")  # the last is later than 30 days before June 2
    got = {str(r["window_start"].date()): r["n"] for r in J.stream_review_volume(spark, src, kind, **args).collect()}
    assert sum(got.values()) == 4 and min(got) >= "2020-05-14"


def test_folders_belong_together(spark, sf):
    import pytest
    with pytest.raises(ValueError):
        J.stream_vocabulary(spark, f"{sf}/documents*.parquet", SCHEMA, out="/tmp/x")
