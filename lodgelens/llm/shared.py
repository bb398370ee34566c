"""Helpers shared by the operators: written intermediate tables, shared
folders, the contract's row splits, connected components."""

from __future__ import annotations

import contextlib
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.session import ensure_checkpoint_dir


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Send at most ``rows`` rows to Python at once from here on.

    Spark's default of 10,000 whole texts takes hundreds of MB a task in the
    executor's buffers alone. A session with a setting of its own keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Send at most ``rows`` rows to Python at once in the jobs run inside; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing) and
    fixes values such as monotonically_increasing_id."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    for tables in _RECORDERS:
        tables.append((path, df.schema))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_RECORDERS: list[list] = []


@contextlib.contextmanager
def recorded():
    """The list of tables (path, schema) that ``written`` makes inside."""
    tables: list = []
    _RECORDERS.append(tables)
    try:
        yield tables
    finally:
        _RECORDERS[:] = [t for t in _RECORDERS if t is not tables]


def emptied(spark: SparkSession, tables: list, kept: DataFrame | None = None) -> list:
    """Overwrite recorded tables with no rows, which frees their space; those
    that ``kept`` still reads stay and are returned. Call it only when nothing
    else needs the tables any more."""
    read = "\n".join(kept.inputFiles()) if kept is not None else ""
    stay = [t for t in tables if t[0].rsplit("/", 1)[-1] in read]

    def empty(table) -> None:
        spark.createDataFrame([], table[1]).coalesce(1).write.mode("overwrite").parquet(table[0])
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(inheritable_thread_target(spark)(empty), [t for t in tables if t not in stay]))
    return stay


def text_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m (null ids count as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % m


def ordered_positions(df: DataFrame, order: list[Column], name: str, pos: str) -> DataFrame:
    """Add ``pos``: the 0-based place of each row in the global order.

    Range sort, then partition offsets from one count per partition (a table
    of as many rows as there are partitions), so no task sees all rows."""
    tagged = written(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("__m", 33)
    sizes = tagged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    from pyspark.sql import Window
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__o"))
    return (tagged.withColumn("__p", part).join(F.broadcast(offsets), "__p")
            .withColumn(pos, F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__p", "__o", "__m"))


def running_totals(df: DataFrame, order: list[Column], values: dict[str, Column], name: str) -> DataFrame:
    """Add for each output name the sum of its (long) value over all rows before this one in the global order.

    Range sort, one sum per partition, then running sums inside each partition
    on top of the earlier partitions' sums, so no task sees all rows."""
    from pyspark.sql import Window
    tagged = written(df.withColumns({f"__v_{k}": v.cast("long") for k, v in values.items()})
                     .orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), name).withColumn("__p", F.shiftrightunsigned("__m", 33))
    sums = tagged.groupBy("__p").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in values])
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("__p", *[F.coalesce(F.sum(f"__s_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in values])
    inside = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(F.broadcast(offsets), "__p")
    out = out.withColumns({k: F.col(f"__o_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in values})
    return out.drop("__p", "__m", *[f"__v_{k}" for k in values], *[f"__o_{k}" for k in values])


def components(links: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Connected components of undirected ``links``: (node, root), root the
    smallest node of its component.

    Alternating large-star and small-star rounds; each round is two grouped
    minima and one distinct, written out, so a hub is never gathered into one
    task's memory. Ends when a round changes no edge (logarithmic rounds)."""
    e = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
                .select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), f"{name}-edges")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(lowest, "u")
        nxt = written(j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                      .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), f"{name}-round")
        same = nxt.exceptAll(e.select("u", "v")).isEmpty() and e.select("u", "v").exceptAll(nxt).isEmpty()
        e = nxt
        if same:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
