"""Inputs that the fixtures lack: long ids, quoted words, tiny tables, no shared folder."""

import pytest
from pyspark.sql import functions as F

from lodgelens.operators import model, relational
from lodgelens.session import ensure_checkpoint_dir
from lodgelens.sources import io


def test_ids_of_19_digits(spark):
    ids = spark.range(50).select((F.lit(1089012345678901234) + F.col("id")).alias("id"))
    assert relational.seeded_sample(ids, 20).count() == 20
    folds = {r["f"] for r in ids.select(model.fold_of("id").alias("f")).collect()}
    assert folds == set(range(5))


def test_list_text_with_both_quotes(spark):
    df = spark.createDataFrame([("""["don't", 'walk', 'a\\'b']""",), ("[]",), (None,), ("plain",)], "w string")
    assert [r[0] for r in df.select(io.decode_list_text("w")).collect()] == [["don't", "walk", "a'b"], [], [], []]


def test_correlation_of_two_rows(spark):
    r = relational.pearson_spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double"), "a", "b").first()
    assert tuple(r) == (2, None, None)


def test_top_n_returns_n(spark):
    assert relational.top_n(spark.range(200).withColumn("m", F.col("id") * 2), "m", 50).count() == 50


def test_cluster_without_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"
        def getConf(self):  # noqa: E301
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_sources_present(spark, sf):
    from lodgelens.sources import io
    got = {r["source"]: r["present"] for r in io.sources_present(spark, {"a": f"{sf}/orders.parquet", "b": f"{sf}/none.parquet"}).collect()}
    assert got == {"a": True, "b": False}
