"""Token counts of documents in flat token files.

A token file is a bare row of little-endian ids; documents follow each other,
each closed by an end-of-document id, with no index. Files are cut into
blocks at fixed places, whatever lies there. A task searches its block for
the end id in one vectorised pass and gives the lengths between the ends it
found. A prefix scan over the few numbers of each block then stitches: the
ends before a block number its documents, and the ids since the last end
before it are added to its first one.

Defined cases: an empty file has no document; ids behind the last end are one
more document with ``closed`` false; two ends in a row are a document of no
ids. ``write_files``: null and empty texts are such documents; repeated rows
and ids are documents of their own; an empty table writes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodgelens.llm.bpe import WordEncoder
from lodgelens.llm.files import filesystem, new_file
from lodgelens.llm.packing import by_chars


def _written(uri: str, tokenizer_path: str, end_id: int, width: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    enc, file, ordinal = WordEncoder(tokenizer_path), f"tokens-{TaskContext.get().partitionId():06d}.bin", 0
    end = np.array([end_id], dtype=width).tobytes()
    with new_file(uri, file) as out:
        for pdf in batches:
            for lo, hi in by_chars(pdf["text"].tolist()):
                part = pdf.iloc[lo:hi]
                ids, ends = enc.encode_all([t or "" for t in part["text"]])
                if len(ids) and int(ids.max()) > np.iinfo(width).max:
                    raise ValueError(f"id {int(ids.max())} doesn't fit into {width}; choose a wider one")
                raw, at = ids.astype(width), 0
                for stop in ends.tolist():
                    out.write(raw[at:stop].tobytes() + end)
                    at = stop
                yield pd.DataFrame({"doc_id": part["doc_id"], "file": file, "ordinal": np.arange(ordinal, ordinal + len(part))})
                ordinal += len(part)


def write_files(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int, width: str = "<u2",
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one token file per task; (doc_id, file, ordinal) says which document is where.
    Ids beyond ``width`` raise ValueError, the end id's at once.

    Lazy: the files are written as the returned rows are computed."""
    if not 0 <= end_id <= np.iinfo(width).max:
        raise ValueError(f"end id {end_id} doesn't fit into {width}")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        lambda it: _written(uri, tokenizer_path, end_id, width, it), f"doc_id {kind}, file string, ordinal long")


def _scanned(uri: str, end_id: int, width: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    system, folder = filesystem(uri)
    size = np.dtype(width).itemsize
    for pdf in batches:
        for file, block, at, length in zip(pdf["file"], pdf["block"], pdf["at"], pdf["length"]):
            with system.open_input_file(f"{folder}/{file}") as f:
                f.seek(int(at))
                ids = np.frombuffer(f.read(int(length)), dtype=width)
            ends = np.flatnonzero(ids == end_id)
            lengths = np.diff(ends, prepend=-1) - 1
            tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
            yield pd.DataFrame({"file": [file], "block": [block], "first": [at // size], "ids": [len(ids)],
                                "ends": [len(ends)], "tail": [tail], "lengths": [lengths], "starts": [at // size + ends - lengths]})


def count_tokens(spark: SparkSession, uri: str, end_id: int, width: str = "<u2", block_ids: int = 2_000_000) -> DataFrame:
    """file, ordinal, start, n_tokens, closed of every document in the token files under ``uri``."""
    size = np.dtype(width).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(uri).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes")).where("bytes > 0")
    step = block_ids * size
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {step}")))).select(
        "file", "block", (F.col("block") * step).alias("at"), F.least(F.lit(step), F.col("bytes") - F.col("block") * step).alias("length"))
    dealt = blocks.repartition(4 * max(1, spark.sparkContext.defaultParallelism))  # the names of blocks, not their ids
    scanned = dealt.mapInPandas(lambda it: _scanned(uri, end_id, width, it),
                                "file string, block long, first long, ids long, ends long, tail long, lengths array<long>, starts array<long>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    given = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("ids"))  # ids a block leaves open
    scan = (scanned.withColumn("docs", F.coalesce(F.sum("ends").over(before), F.lit(0)))
            .withColumn("open", F.coalesce(F.sum(given).over(before), F.lit(0)))
            .withColumn("closed_at", F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("open"))).over(before), F.lit(0)))
            .withColumn("carry", F.col("open") - F.col("closed_at"))
            .withColumn("last", F.lead("block").over(order).isNull()))
    # a block's first document has the ids left open before it and begins with them
    lead = lambda k: F.when(k == 0, F.col("carry")).otherwise(F.lit(0))
    whole = F.transform("lengths", lambda n, k: F.struct((F.col("docs") + k).alias("ordinal"), (F.element_at("starts", k + 1) - lead(k)).alias("start"),
                                                         (n + lead(k)).alias("n_tokens"), F.lit(True).alias("closed")))
    rest = F.col("tail") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(F.lit(0))
    open_end = F.when(F.col("last") & (rest > 0), F.array(F.struct(
        (F.col("docs") + F.col("ends")).alias("ordinal"), (F.col("first") + F.col("ids") - rest).alias("start"),
        rest.alias("n_tokens"), F.lit(False).alias("closed")))).otherwise(
        F.array().cast("array<struct<ordinal:bigint,start:bigint,n_tokens:bigint,closed:boolean>>"))
    return scan.select("file", F.explode(F.concat(whole, open_end)).alias("d")).select("file", "d.*")
