"""Corpus pipeline: toxicity, language, repeated lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.

A stage's own intermediate tables are emptied when the next stage starts (on
documents that don't read them any more), so the shared folder holds those of
one stage at a time.

Defined cases, all stages: a null or empty text has no toxic term and stays in
``drop_toxic``, has no letter and goes in ``drop_foreign``, has no line in
``dedup_lines`` and no shingle in ``drop_near_duplicates`` and stays there, and
is packed as its end id alone; a null id stays an id of its own; of ties and
repeated rows the one that comes first by id (then by row) stays; an empty
table gives an empty table; other columns are carried along (those named
__row, __id, __lines, __deleted, __cut or __ranges are reserved).
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.llm import langid, linededup, minhash, packing, toxicity
from lodgelens.llm.shared import emptied, recorded, text_batches, text_mod, written
from lodgelens.sources.tables import table

_LEFT: list = []  # tables of the stage before


TEXTS = 250  # whole texts sent to Python at once, where the session has no setting of its own


def tidy(stage):
    """A stage that first empties what the stage before it left. Stages are
    lazy, so the batch size stays set for the session until they have run."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT[:] = emptied(spark, _LEFT, docs)
        text_batches(spark, TEXTS)
        with recorded() as tables:
            out = stage(spark, docs, sf_dir)
        _LEFT.extend(tables)
        return out
    return run_stage


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


MIN_LANGUAGE_SHARE = 0.25  # of a text's n-grams that its language must know


@tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Labels are learnt from
    labelled documents outside the held-out fifth."""
    train = toxicity.training_rows(docs, table(spark, sf_dir, "labels"), lambda i: text_mod(i, 5) != 0)
    score = unused(docs, "__toxicity")
    scored = toxicity.with_score(docs, toxicity.fit(train), out_col=score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


@tidy
def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learnt ones: not those without a
    letter, nor those few of whose n-grams belong to the language found."""
    model = langid.fit(docs.where(text_mod(F.col("doc_id"), 4) != 2))
    tag = unused(docs, "__language")
    tagged = langid.with_language(docs, model, out_col=tag)
    return tagged.where((F.col(tag)["lang"] != "und") & (F.col(tag)["share"] >= MIN_LANGUAGE_SHARE)).select(*docs.columns)


@tidy
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines of 50 words or more; a
    document of which nothing is left goes. n_chars follows the text."""
    kept = linededup.dedup(docs, min_words=50)
    blank = (F.col("__deleted") > 0) & (F.trim(F.translate("text", "\n\r\t\f\x0b", "     ")) == "")
    out = [F.when(F.col("__deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
           if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.where(~F.coalesce(blank, F.lit(False))).select(*out)


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 on five-word shingles."""
    return minhash.keep_first(docs, percent=80, words=5)


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), seq_len=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_foreign),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # trained models and BPE ids are beyond SQL; tests compare line_dedup and near_dedup with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    _LEFT[:] = emptied(spark, _LEFT, docs)
    return docs
