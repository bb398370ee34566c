"""Shared intermediate tables written once per application.

The feature matrix and the document-term table feed many queries.  Like a
Spark user would, they are written once to the shared folder named by
``spark.checkpoint.dir`` and read back by every later query of the same
application (the key includes the application id and the input folder, so a
new run never reads an old result).  Reading a written table also cuts the
lineage: a lost executor re-reads it instead of re-running the spatial joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodgelens.session import ensure_checkpoint_dir

_DONE: dict[str, str] = {}


def _path(spark: SparkSession, name: str, sf_dir: str) -> str:
    app = spark.sparkContext.applicationId
    key = hashlib.sha1(f"{name}|{sf_dir}|{app}".encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{key}"


def materialized(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    path = _path(spark, name, sf_dir)
    if path not in _DONE:
        build().write.mode("overwrite").parquet(path)
        _DONE[path] = name
    return spark.read.parquet(path)


def fitted(spark: SparkSession, name: str, sf_dir: str, fit: Callable, kind):
    """A ``spark.ml`` model of class ``kind``, fitted and saved once per
    application like the tables above, then loaded from the shared folder."""
    path = _path(spark, name, sf_dir)
    if path not in _DONE:
        fit().write().overwrite().save(path)
        _DONE[path] = name
    return kind.load(path)
