"""Exact quantiles and average ranks of many segments in one range sort.

A segment is a column of a table, a column within a group, or one side of a
pair of columns.  Values are counted per (segment, value) first (a partial
aggregate, so a hot value is one row), the counts are range-sorted once by
(segment, value), and running sums inside each partition plus the segment's
totals in earlier partitions (a row per segment and partition) give every
value's place.  No task ever holds a segment's values or a value -> count map
of it, which is what ``median``/``percentile`` aggregates build.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.session import ensure_checkpoint_dir


def places(counts: DataFrame, segment: list[str], value: str) -> DataFrame:
    """``counts`` (segment columns, value, _c; no nulls) with ``_before``, the
    number of the segment's rows with a smaller value, and ``_n``, its rows.
    The range-sorted counts are checkpointed to fix the partition ids."""
    spark = counts.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, *segment, value).withColumn("_pid", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy(*segment, "_pid").agg(F.sum("_c").alias("_t"))
    earlier = Window.partitionBy(*segment).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*segment, "_pid", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"),
                            F.sum("_t").over(Window.partitionBy(*segment)).alias("_n"))
    inside = Window.partitionBy("_pid", *segment).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    return local.join(offsets, [*segment, "_pid"]).withColumn("_before", F.col("_off") + F.col("_in")).drop("_off", "_in", "_pid")


def quantiles(df: DataFrame, cols: list[str] | dict[str, Column], qs: list[float], keys: str | list[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles of many columns, whole or per group: the
    keys and ``<column>_<i>`` for the i-th of ``qs``.  Nulls don't count; rows
    with a null key are left out (a group without any value gives no row);
    without keys there is one row, null where a column has no value."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = cols if isinstance(cols, dict) else {c: F.col(c) for c in cols}
    names = list(cols)
    cells = F.array(*[F.struct(F.lit(i).alias("_col"), c.cast("double").alias("_v")) for i, c in enumerate(cols.values())])
    long = df.select(*keys, F.explode(cells).alias("_x")).select(*keys, "_x.*").dropna()
    at = places(long.groupBy(*keys, "_col", "_v").agg(F.count("*").alias("_c")), [*keys, "_col"], "_v")
    upto = F.col("_before") + F.col("_c")
    found = []
    for i, q in enumerate(qs):
        h = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        found += [F.max(F.when((F.col("_before") <= lo) & (lo < upto), F.col("_v"))).alias(f"_lo{i}"),
                  F.max(F.when((F.col("_before") <= hi) & (hi < upto), F.col("_v"))).alias(f"_hi{i}"), F.max(h - lo).alias(f"_f{i}")]
    per = at.groupBy(*keys, "_col").agg(*found)
    value = lambda i: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")
    return per.groupBy(*keys).agg(*[F.max(F.when(F.col("_col") == k, value(i))).alias(f"{n}_{i}")
                                    for k, n in enumerate(names) for i in range(len(qs))])


def medians(df: DataFrame, cols: list[str] | dict[str, Column], keys: str | list[str] = ()) -> DataFrame:
    """Exact medians of many columns under their own names."""
    names = list(cols)
    found = quantiles(df, cols, [0.5], keys)
    return found.withColumnsRenamed({f"{n}_0": n for n in names})


def spearman(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, n, rho) for pairs of columns, numbered from 0: Pearson's
    coefficient of average ranks over the rows where both columns have a
    value.  Each pair ranks its own complete rows; all sides of all pairs are
    segments of one rank pass.  rho is null when a side is constant."""
    both = [F.struct(F.lit(i).alias("_pair"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")) for i, (a, b) in enumerate(pairs)]
    long = df.select(F.explode(F.array(*both)).alias("_x")).select("_x.*").dropna()
    cells = long.groupBy("_pair", "_a", "_b").agg(F.count("*").alias("_c"))
    sides = cells.select("_pair", "_c", F.explode(F.array(*[F.struct(F.lit(s).alias("_side"), F.col(c).alias("_v")) for s, c in ((0, "_a"), (1, "_b"))])).alias("_x"))
    counts = sides.groupBy("_pair", "_x._side", "_x._v").agg(F.sum("_c").alias("_c"))
    # ranks of n rows average (n + 1) / 2, so they are taken from their middle
    mid = F.col("_before") + (F.col("_c") + 1) / 2.0 - (F.col("_n") + 1) / 2.0
    ranks = places(counts, ["_pair", "_side"], "_v").select("_pair", "_side", "_v", mid.alias("_r"))
    side = lambda s, c: ranks.where(F.col("_side") == s).select("_pair", F.col("_v").alias(c), F.col("_r").alias(f"_r{c}"))
    met = cells.join(side(0, "_a"), ["_pair", "_a"]).join(side(1, "_b"), ["_pair", "_b"])
    x, y, c = F.col("_r_a"), F.col("_r_b"), F.col("_c")
    sums = met.groupBy("_pair").agg(F.sum("_c").alias("n"), F.sum(c * x * y).alias("_xy"), F.sum(c * x * x).alias("_xx"), F.sum(c * y * y).alias("_yy"))
    rho = F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")))
    return sums.select(F.col("_pair").alias("pair"), "n", rho.alias("rho"))
