"""Scans of the input tables (Parquet).

Column pruning and filter pushdown are left to Catalyst: callers select what
they need and the Parquet scan reads only those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cluster's parallelism when the scan
    yields fewer splits than there are task slots (a few large row groups),
    before CPU-heavy per-row work such as regex tokenising.  At scale the
    number of input splits already exceeds the slots and nothing happens."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
