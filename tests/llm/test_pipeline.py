"""The pipeline's stages on odd inputs and on the small tables."""

import corpus_pipeline
from lodgelens.llm import queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        kept = {r["doc_id"] for r in out.collect()}
        assert kept <= ids and len(kept) >= 0.8 * len(ids)
    piece = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in piece.collect()} == ids


def test_stages_odd(spark, sf, odd_docs):
    docs = odd_docs.selectExpr("doc_id", "text", "lang", "cast(null AS string) AS source", "cast(length(text) AS long) AS n_chars", "score", "rank")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf).schema.names == docs.columns
    kept = [r["doc_id"] for r in corpus_pipeline.dedup_lines(spark, docs, sf).collect()]
    assert kept.count(6) == 1 and kept.count(7) == 1 and kept.count(8) == 0  # 8 is a copy of 7, a run of its own


def test_run(spark, sf):
    out = queries.QUERIES["pipeline"](spark, sf)
    assert "sequence_id" in out.columns and out.count() > 0


def test_stage_tables_are_emptied_when_the_next_one_starts(spark, sf):
    from lodgelens.llm.shared import recorded, written
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    with recorded() as outer:
        first = written(corpus_pipeline.dedup_lines(spark, docs, sf), "stage-out")
    own = [t for t in outer if "stage-out" not in t[0]]
    rows = lambda t: spark.read.schema(t[1]).parquet(t[0]).count()
    assert sum(map(rows, own)) > 0
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, first, sf).collect())
    assert sum(map(rows, own)) == 0 and first.count() > 0  # the stage's result itself stays
    # documents that still read a stage's tables keep them
    lazy = corpus_pipeline.dedup_lines(spark, docs, sf)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, lazy, sf).collect()) == kept


def test_stages_keep_clashing_columns(spark, sf, odd_docs):
    docs = odd_docs.selectExpr("doc_id", "text", "lang", "'s' AS source", "cast(length(text) AS long) AS n_chars", "1 AS __toxicity", "2 AS __language")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_foreign):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {(r["__toxicity"], r["__language"]) for r in out.collect()} <= {(1, 2)}
