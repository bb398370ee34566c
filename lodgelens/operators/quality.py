"""Data-quality checks (G1-G6) that return result tables instead of raising.

Each check is one aggregate pass (or a partial aggregate per key) and yields
rows a caller can assert on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.operators import relational as R


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """G1: for each required column: present? and its non-null count."""
    have = set(df.columns)
    present = [c for c in required if c in have]
    counts = df.agg(*[F.count(c).alias(c) for c in present]) if present else None
    rows = []
    for c in required:
        if c in have:
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(True).alias("present"),
                                 F.col(f"`{c}`").alias("non_null")))
        else:
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(False).alias("present"),
                                 F.lit(0).cast("long").alias("non_null")))
    base = counts if counts is not None else df.sparkSession.range(1)
    return base.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def count_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Total number of nulls over the columns (0 means the check holds)."""
    total = reduce(lambda a, b: a + b, [F.count(F.lit(1)) - F.count(c) for c in cols])
    return df.agg(total.alias("n_null"), F.count(F.lit(1)).alias("n_rows")).withColumn(
        "ok", F.col("n_null") == 0)


def median_within(df: DataFrame, col: str, expected: float, tol: float) -> DataFrame:
    """Median of a column and whether it lies within tol of expected."""
    m = R.exact_quantiles(df, col, [0.5], "_m").withColumnRenamed("_m0", "median")
    return m.select(F.round("median", 6).alias("median"), (F.abs(F.col("median") - expected) < tol).alias("ok"))


def constant_within_key(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per column, number of keys whose value is not constant."""
    per = df.groupBy(key).agg(*[F.count_distinct(c).alias(c) for c in cols])
    wide = per.agg(*[F.count_if(F.col(c) > 1).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_varying")


def placeholder_audit(df: DataFrame, col: str, qs=(0.97, 0.98, 0.99)) -> DataFrame:
    """Rows at the exact maximum and the jumps between high percentiles."""
    t = R.attach_scalars(df, _mx=F.max(col))
    a = t.agg(F.first("_mx").alias("max_value"), F.count_if(F.col(col) == F.col("_mx")).alias("n_at_max"),
              F.count(col).alias("n"))
    q = R.exact_quantiles(df, col, list(qs), "_q")
    return a.crossJoin(F.broadcast(q)).select(
        "max_value", "n_at_max", "n", *[F.round(F.col(f"_q{i}"), 6).alias(f"p{int(x * 100)}") for i, x in enumerate(qs)])


def missing_attribution(df: DataFrame, price: str, nights: str, threshold: int = 28) -> DataFrame:
    """Share of long-stay rows among rows with and without a price."""
    long = (F.col(nights) >= threshold).cast("int")
    return df.agg(
        F.count_if(F.col(price).isNull()).alias("n_missing"),
        F.round(F.avg(F.when(F.col(price).isNull(), long)) * 100, 6).alias("pct_long_missing"),
        F.count_if(F.col(price).isNotNull()).alias("n_present"),
        F.round(F.avg(F.when(F.col(price).isNotNull(), long)) * 100, 6).alias("pct_long_present"))


def snapshot_coverage(df: DataFrame, snapshot: str, price: str) -> DataFrame:
    """Rows and price coverage per snapshot."""
    return df.groupBy(snapshot).agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.avg(F.col(price).isNotNull().cast("int")) * 100, 6).alias("pct_priced"))
