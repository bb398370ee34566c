"""Registry of named queries (``queries()``) and their DuckDB oracles.

A query is a callable ``(spark, sf_dir) -> DataFrame``.  Its oracle is an
SQL string over the driver's base tables; fixture and shared views it names
are prepended as CTEs by ``with_views``.
"""

from __future__ import annotations

from collections.abc import Callable

import functools

from lodgelens.plans.oracle_views import with_views
from lodgelens.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _with_checkpoint_dir(fn: Callable) -> Callable:
    """Iterative queries cut lineage with checkpoint(): make sure the session
    names a checkpoint folder (the cluster's setting is used when present)."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    return run


def query(key: str, oracle: str | None = None):
    def deco(fn: Callable) -> Callable:
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = _with_checkpoint_dir(fn)
        if oracle is not None:
            ORACLES[key] = with_views(oracle)
        return fn
    return deco


def load_all() -> None:
    from lodgelens.plans import suite_relational, suite_scalar, suite_spatial, suite_features, suite_questions, suite_quality, suite_model, suite_text, suite_topics, suite_streaming, suite_ml, suite_extra  # noqa: F401
