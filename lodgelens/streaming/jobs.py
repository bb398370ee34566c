"""Incremental (Structured Streaming) versions of the review jobs.

Each job reads new files with the file stream source (schema declared, no
inference) and applies the same column expressions as the batch job.  ``out``
and ``checkpoint`` name the caller's result and checkpoint folders: a later
call with the same two folders processes only files that came since and
returns the result over all of them; a call without them starts afresh in new
shared folders.  ``availableNow`` processes what is there and stops, so a
scheduler can call again.

State is bounded in every job: T1 is stateless; T2 keeps one running sum
per (listing, position); T3 one count per term (each document contributes
its distinct terms once, so no de-duplication state is needed); T4 one
count per event-time window.  T2-T4 run in update mode: a micro-batch writes
the keys it changed, with their running totals, to a folder of its own.

* Replays: a retried micro-batch overwrites its own folder, so nothing is
  written twice.  T1 uses the Parquet sink's commit log.
* Compaction: every ``compact_every``-th folder holds all keys, not only the
  changed ones; readers start from the last such folder.  The folders before it
  are emptied one micro-batch later, when it is known to be committed, so a
  replay always finds what it needs.
* Late rows (T4): a row older than the newest event time seen in earlier
  micro-batches less the watermark is dropped, and its window stays as last
  written.  T2 and T3 take rows in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.operators import text as T
from lodgelens.sources.io import scratch_path

COMPACT_EVERY = 50


def _source(spark: SparkSession, src_glob: str, schema: str, max_files_per_trigger: int | None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(src_glob)


def _folders(spark: SparkSession, name: str, out: str | None, checkpoint: str | None) -> tuple[str, str]:
    if (out is None) != (checkpoint is None):
        raise ValueError("out and checkpoint belong together: give both or neither")
    return out or scratch_path(spark, f"stream-{name}"), checkpoint or scratch_path(spark, f"stream-{name}-ckpt")


def latest_per_key(updates: DataFrame, keys: list[str], version: str = "epoch") -> DataFrame:
    """Collapse a versioned update log to each key's latest row (a partial
    aggregate: one ``max_by`` per key)."""
    others = [c for c in updates.columns if c not in keys and c != version]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("_r")).select(*keys, "_r.*")


def _log(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The update log: rows with their epoch and whether its folder is full."""
    return spark.read.schema(f"{schema}, full boolean, epoch long").parquet(out)


def current(spark: SparkSession, out: str, schema: str, keys: list[str], before: int | None = None) -> DataFrame:
    """Each key's latest row, read from the last full folder on."""
    log = _log(spark, out, schema)
    if before is not None:
        log = log.where(F.col("epoch") < before)
    start = log.where("full").agg(F.coalesce(F.max("epoch"), F.lit(-1)).alias("_start"))
    return latest_per_key(log.crossJoin(F.broadcast(start)).where("epoch >= _start").drop("_start", "full"), keys)


def epoch_sink(out: str, schema: str, keys: list[str], compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of update-mode results, safe under replays."""
    def folder(epoch: int) -> str:
        return f"{out.rstrip('/')}/epoch={epoch}"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows, full = batch, epoch > 0 and epoch % compact_every == 0
        if full:
            older = current(spark, out, schema, keys, before=epoch)
            rows = batch.unionByName(older.join(batch.select(*keys), keys, "left_anti"))
        rows.withColumn("full", F.lit(full)).write.mode("overwrite").parquet(folder(epoch))
        if epoch > 1 and (epoch - 1) % compact_every == 0:  # the full folder before this one is committed
            none = spark.createDataFrame([], f"{schema}, full boolean")
            for old in range(max(0, epoch - 1 - compact_every), epoch - 1):
                none.coalesce(1).write.mode("overwrite").parquet(folder(old))
    return write


def _updated(spark: SparkSession, agg: DataFrame, name: str, keys: list[str], out: str | None, checkpoint: str | None,
             compact_every: int) -> DataFrame:
    """Run an update-mode aggregate over the new files; the latest row of every key so far."""
    out, checkpoint = _folders(spark, name, out, checkpoint)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in agg.schema)
    # an empty first folder, so that a source without files has a result too
    spark.createDataFrame([], f"{schema}, full boolean").coalesce(1).write.mode("ignore").parquet(f"{out.rstrip('/')}/epoch=-1")
    (agg.writeStream.foreachBatch(epoch_sink(out, schema, keys, compact_every)).option("checkpointLocation", checkpoint)
     .outputMode("update").trigger(availableNow=True).start().awaitTermination())
    return current(spark, out, schema, keys)


def stream_ingest(spark: SparkSession, src_glob: str, schema: str, lang: str = "en", *, out: str | None = None,
                  checkpoint: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Files -> language filter -> clean text -> Parquet (append)."""
    s = _source(spark, src_glob, schema, max_files_per_trigger)
    rows = s.filter(F.col("lang") == lang).select("doc_id", "source", T.clean_text("text").alias("clean"))
    out, checkpoint = _folders(spark, "ingest", out, checkpoint)
    (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(rows.schema).parquet(out)


def stream_avg_embedding(spark: SparkSession, src_glob: str, schema: str, *, out: str | None = None, checkpoint: str | None = None,
                         max_files_per_trigger: int | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Running count and element-wise sum per listing -> mean vector."""
    s = _source(spark, src_glob, schema, max_files_per_trigger)
    agg = (s.select("label", F.posexplode("embedding").alias("pos", "v"))
           .groupBy("label", "pos").agg(F.sum(F.col("v").cast("double")).alias("total"),
                                        F.count(F.lit(1)).alias("n")))
    res = _updated(spark, agg, "avg-embedding", ["label", "pos"], out, checkpoint, compact_every)
    return res.select("label", (F.col("pos") + 1).alias("pos"), (F.col("total") / F.col("n")).alias("mean"),
                      F.col("n").alias("n_docs"))


def stream_vocabulary(spark: SparkSession, src_glob: str, schema: str, lang: str = "en",
                      max_files_per_trigger: int | None = None, *, out: str | None = None, checkpoint: str | None = None,
                      compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Running document frequency per term."""
    s = _source(spark, src_glob, schema, max_files_per_trigger).filter(F.col("lang") == lang)
    terms = s.select("doc_id", T.explode_terms(F.array_distinct(T.tokens(T.clean_text("text"))))).filter(
        F.col("term").isNotNull())
    agg = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _updated(spark, agg, "vocabulary", ["term"], out, checkpoint, compact_every)


def stream_review_volume(spark: SparkSession, src_glob: str, schema: str, watermark: str = "30 days",
                         window: str = "7 days", *, out: str | None = None, checkpoint: str | None = None,
                         max_files_per_trigger: int | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """T4: reviews per event-time window (TIMESTAMP_NTZ cast to TIMESTAMP
    for the watermark).  Update mode: rows later than the watermark are
    dropped and the state of closed windows is evicted; each window's
    latest emitted count is its result."""
    s = _source(spark, src_glob, schema, max_files_per_trigger)
    ev = s.select(F.col("o_orderdate").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    agg = ev.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    res = _updated(spark, agg.select(F.col("w.start").alias("window_start"), "n"), "review-volume", ["window_start"], out, checkpoint, compact_every)
    return res.select("window_start", "n")
