"""Relational operators: filters, joins, aggregates, ranking, reshaping.

All operators are ``DataFrame -> DataFrame`` functions that build a lazy
plan.  Conventions that hold throughout (decided once, see SURVEY §1.5):

* group keys that are null are dropped before grouping (pandas semantics);
* medians and quantiles are exact with linear interpolation, from one range
  sort of (segment, value) counts (``operators/ranks.py``);
* order-dependent results always carry an explicit tie-break column;
* scalar statistics (medians, percentiles, min/max) are computed as a 1-row
  aggregate and attached with a broadcast cross join: the broadcast side has
  exactly one row, a proven size bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.operators import ranks
from lodgelens.session import ensure_checkpoint_dir


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attach_scalars(df: DataFrame, **aggs: Column) -> DataFrame:
    """Compute 1-row aggregates over ``df`` and attach them to every row.

    The aggregate side has exactly one row, so broadcasting it is safe at any
    data size; the aggregate itself is a partial/final ``HashAggregate``.
    """
    one = df.agg(*[v.alias(k) for k, v in aggs.items()])
    return df.crossJoin(F.broadcast(one))


# ---------------------------------------------------------------- filters (P)

def short_stay_filter(df: DataFrame, nights_col="minimum_nights", price_col="price_numeric",
                      max_nights: int = 28) -> DataFrame:
    """Minimum nights below 28 and a positive parsed price."""
    return df.filter((_c(nights_col) < max_nights) & _c(price_col).isNotNull() & (_c(price_col) > 0))


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """P2."""
    return df.dropna(subset=cols)


def isin_filter(df: DataFrame, col: str, values: list) -> DataFrame:
    """P3."""
    return df.filter(_c(col).isin(values))


def exclude_values(df: DataFrame, col, values: list) -> DataFrame:
    """Negated membership that keeps unknowns (pandas ``~isin``)."""
    return df.filter(~F.coalesce(_c(col).isin(values), F.lit(False)))


def between_filter(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """P5: inclusive range."""
    return df.filter(_c(col).between(lo, hi))


def price_cap(df: DataFrame, col="price_numeric", cap: float = 2000.0) -> DataFrame:
    """Positive and at most the cap."""
    return df.filter((_c(col) > 0) & (_c(col) <= cap))


def percentile_cap(df: DataFrame, col: str, q: float = 0.99, keep_below: bool = False) -> DataFrame:
    """P7 (``<=`` p99) and P16 (``<`` p25, ``keep_below=True``)."""
    t = df.crossJoin(F.broadcast(exact_quantiles(df, col, [q], "_cap").withColumnRenamed("_cap0", "_cap")))
    cond = (_c(col) < F.col("_cap")) if keep_below else (_c(col) <= F.col("_cap"))
    return t.filter(cond).drop("_cap")


def common_filters(df: DataFrame, *, borough=None, property_type=None, room_type=None,
                   price_max=None, price_min=None, min_rating=None,
                   price_col="price_numeric", rating_col="review_scores_rating") -> DataFrame:
    """Conjunction of whichever optional filters are given."""
    conds = []
    if borough:
        conds.append(F.col("borough") == borough)
    if property_type:
        conds.append(F.col("property_type") == property_type)
    if room_type:
        conds.append(F.col("room_type") == room_type)
    if price_max is not None:
        conds.append(_c(price_col) <= price_max)
    if price_min is not None:
        conds.append(_c(price_col) >= price_min)
    if min_rating is not None:
        conds.append(_c(rating_col) >= min_rating)
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def dashboard_filter(df: DataFrame, month: int, boroughs: list, rooms: list,
                     neighbourhoods: list | None = None) -> DataFrame:
    """P9."""
    cond = (F.col("month") == month) & F.col("borough").isin(boroughs) & F.col("room_type").isin(rooms)
    if neighbourhoods:
        cond = cond & F.col("neighbourhood").isin(neighbourhoods)
    return df.filter(cond)


def existing_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """P11."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def prefix_columns(df: DataFrame, prefix: str) -> list[str]:
    """P13."""
    return [c for c in df.columns if c.startswith(prefix)]


def drop_matching(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Drop rows whose trimmed text equals one of the patterns."""
    return df.filter(~F.coalesce(F.trim(_c(col)).isin(patterns), F.lit(False)))


# ------------------------------------------------------------------ joins (J)

def semi_join(df: DataFrame, keys: DataFrame, on: str, key_col: str | None = None) -> DataFrame:
    """Keep rows whose key occurs in ``keys``."""
    k = keys.select(F.col(key_col or on).alias(on)).distinct() if key_col else keys.select(on)
    return df.join(k, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """J5."""
    return df.join(keys.select(F.col(right_on).alias(left_on)), left_on, "left_anti")


# ----------------------------------------------------------- aggregates (A)

def _nonnull_keys(df: DataFrame, keys) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def group_agg(df: DataFrame, keys, *aggs: Column) -> DataFrame:
    """Group with pandas semantics (null keys dropped)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return _nonnull_keys(df, keys).groupBy(*keys).agg(*aggs)


AGGREGATIONS = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def aggregate_by(df: DataFrame, key: str, metric: str, aggregation: str, out: str = "value") -> DataFrame:
    """One of ``AGGREGATIONS`` or the median of a metric per key (null keys dropped)."""
    if aggregation == "median":
        groups = _nonnull_keys(df, key).select(key).distinct()
        return groups.join(ranks.medians(df, {out: F.col(metric)}, key), key, "left")
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"Unknown aggregation: {aggregation}")
    return group_agg(df, key, AGGREGATIONS[aggregation](metric).alias(out))


def group_aggregate(df: DataFrame, group_by: str, metric: str, aggregation: str = "mean",
                    out: str = "value") -> DataFrame:
    """A3: chosen aggregate of a chosen metric by a chosen dimension."""
    if group_by not in df.columns or metric not in df.columns:
        raise ValueError(f"Unknown column: {group_by} or {metric}")
    return aggregate_by(df, group_by, metric, aggregation, out)


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Counts per value, largest first (ties by value), optional top k."""
    out = group_agg(df, col, F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col))
    return out.limit(top) if top else out


def value_share(df: DataFrame, col: str) -> DataFrame:
    """Counts and percent share of total (the window runs over the
    already-aggregated, distinct-value-sized table)."""
    counts = group_agg(df, col, F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_tot"))
    return counts.crossJoin(F.broadcast(total)).select(
        col, "n", (F.col("n") / F.col("_tot") * 100).alias("pct"))


def describe(df: DataFrame, col: str, digits: int = 3) -> DataFrame:
    """A10: count, mean, std, min, quartiles, max of one numeric column
    (quartiles exact and bounded per task)."""
    base = df.agg(
        F.count(col).alias("count"), F.round(F.avg(col), digits).alias("mean"),
        F.round(F.stddev_samp(col), digits).alias("std"), F.round(F.min(col).cast("double"), digits).alias("min"),
        F.round(F.max(col).cast("double"), digits).alias("max"))
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], "_q")
    return base.crossJoin(F.broadcast(q)).select(
        "count", "mean", "std", "min", F.round("_q0", digits).alias("p25"), F.round("_q1", digits).alias("median"),
        F.round("_q2", digits).alias("p75"), "max")


def describe_table(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """A10 for many columns: one row per column; the quartiles of all columns
    come from one range sort."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
                 F.stddev_samp(c).alias(f"{c}__std"), F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max")]
    quarts = ranks.quantiles(df, cols, [0.25, 0.5, 0.75])
    wide = df.agg(*aggs).crossJoin(F.broadcast(quarts))
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                     *[F.round(F.col(f"{c}{k}"), digits).alias(n) for k, n in (
                         ("__mean", "mean"), ("__std", "std"), ("__min", "min"), ("_0", "p25"), ("_1", "median"), ("_2", "p75"), ("__max", "max"))])
            for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def describe_categorical(df: DataFrame, col: str, top: int = 20) -> DataFrame:
    """Number of distinct values attached to the top-k value counts."""
    uniq = _nonnull_keys(df, col).agg(F.count_distinct(col).alias("unique"))
    return value_counts(df, col, top).crossJoin(F.broadcast(uniq))


def null_audit(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Nulls per column, count and percent (one pass, then unpivot)."""
    cols = cols or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    long = wide.unpivot("_n", cols, "column", "non_null")
    return long.select("column", (F.col("_n") - F.col("non_null")).alias("n_null"),
                       F.round((F.col("_n") - F.col("non_null")) / F.col("_n") * 100, 6).alias("pct_null"))


def summary_stats(df: DataFrame, price="price_numeric", rating="review_scores_rating",
                  revenue="estimated_revenue") -> DataFrame:
    """N, median/mean price, mean rating, median revenue (2 dp); empty -> n = 0.
    Both medians come from one range sort."""
    base = df.agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(price), 2).alias("price_mean"),
                  F.round(F.avg(rating), 2).alias("rating_mean"))
    mid = ranks.medians(df, {"_mp": F.col(price), "_mr": F.col(revenue)})
    return base.crossJoin(F.broadcast(mid)).select(
        "count", F.round("_mp", 2).alias("price_median"), "price_mean", "rating_mean",
        F.round("_mr", 2).alias("revenue_median"))


def mean_matrix(df: DataFrame, key: str | None, cols: list[str], digits: int = 6) -> DataFrame:
    """Mean of many columns (per key), in long form."""
    aggs = [F.avg(c).alias(c) for c in cols]
    wide = group_agg(df, key, *aggs) if key else df.agg(*aggs)
    ids = [key] if key else []
    return wide.unpivot(ids, cols, "column", "mean").withColumn("mean", F.round("mean", digits))


def mean_abs_ranked(df: DataFrame, cols: list[str], top: int | None = None, digits: int = 9) -> DataFrame:
    """Mean absolute value per column, ranked (ties by name)."""
    wide = df.agg(*[F.avg(F.abs(c)).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "mean_abs").withColumn("mean_abs", F.round("mean_abs", digits))
    out = long.orderBy(F.desc("mean_abs"), "feature")
    return out.limit(top) if top else out


def vector_mean(df: DataFrame, key: str, vec: str, out: str = "mean_vec") -> DataFrame:
    """Element-wise mean of array vectors per key.

    Exploding to (key, pos) and averaging keeps the aggregation partial
    (map-side combine), so a hot key costs one sum per position per task;
    the per-key array is re-assembled from at most ``dim`` rows.
    """
    long = df.select(key, F.posexplode(vec).alias("pos", "v"))
    per_pos = long.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return per_pos.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias(out),
        F.max("n").alias("n_docs"))


def concat_in_order(df: DataFrame, key: str, order: str, text: str, sep: str = " ",
                    first_n: int | None = None, out: str = "doc") -> DataFrame:
    """Texts of a key joined in order (optionally the first n)."""
    src = df
    if first_n:
        src = top_per_group(df, key, [_c(order)], first_n, "_rn")
    agg = src.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), _c(text).alias("t")))).alias("_l"))
    return agg.select(key, F.array_join(F.transform("_l", lambda s: s["t"]), sep).alias(out))


def concat_chunks(df: DataFrame, key: str, order: str, text: str, sep: str = " ", max_chars: int = 1 << 16) -> DataFrame:
    """A20 for keys of any size: (key, chunk, n_docs, doc), the joined texts of
    a key cut between texts.  A chunk holds the texts that start within the
    same ``max_chars`` of the key's running length, so no row or group grows
    with the key; chunk numbers rise in order and may leave gaps.  ``doc`` is
    null where a chunk has no text; the other chunks joined by ``sep`` are the
    whole document.

    The running length comes from one range sort, sums per (partition, key)
    and their running sum per key (at most one row per partition and key).
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(_c(key).alias("_k"), _c(order).alias("_o"), _c(text).alias("_t")).orderBy("_k", "_o", "_t")
    rows = rows.withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumns({"_p": F.shiftrightunsigned("_m", 33), "_s": F.coalesce(F.length("_t"), F.lit(0)) + F.length(F.lit(sep)) + 1})
    earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_k", "_p").agg(F.sum("_s").alias("_n")).select(
        F.col("_k").alias("_k2"), F.col("_p").alias("_p2"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_p", "_k").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("_w", F.coalesce(F.sum("_s").over(within), F.lit(0))).join(
        sums, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_p") == F.col("_p2")))
    chunk = F.floor((F.col("_before") + F.col("_w")) / max_chars).alias("chunk")
    parts = at.groupBy("_k", chunk).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("_t").alias("_with"),
        F.array_sort(F.collect_list(F.struct(F.col("_m"), F.col("_t")))).alias("_l"))
    doc = F.when(F.col("_with") > 0, F.array_join(F.transform("_l", lambda s: s["_t"]), sep))
    return parts.select(F.col("_k").alias(key), "chunk", "n_docs", doc.alias("doc"))


def chunks_digest(chunks: DataFrame, key: str, sep: str = " ", out: str = "digest") -> DataFrame:
    """MD5 of each key's whole document from its ordered chunks.  The chunks of
    a key stream through one hash state (MD5 has no other way), a few at a
    time, so a document is never held in memory."""
    import hashlib

    def digest(rows):
        at, state, first = None, None, True
        for k, doc in rows:
            if state is None or k != at:
                if state is not None:
                    yield at, state.hexdigest()
                at, state, first = k, hashlib.md5(), True
            if doc is not None:
                state.update((doc if first else sep + doc).encode())
                first = False
        if state is not None:
            yield at, state.hexdigest()

    # rows, not Arrow batches: those are bounded by a count of rows, these by bytes
    rdd = chunks.repartition(key).sortWithinPartitions(key, "chunk").select(key, "doc").rdd.mapPartitions(digest)
    return chunks.sparkSession.createDataFrame(rdd, f"{key} {chunks.schema[key].dataType.simpleString()}, {out} string")


def mode_per_key(df: DataFrame, key: str, value: str, out: str = "mode") -> DataFrame:
    """Most frequent value per key; ties -> the smallest value.

    Counting (key, value) first is a partial aggregate; the second step sees
    one row per distinct pair, so a hot key is reduced before it shuffles.
    """
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(
        F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias(out) if _is_numeric(df, value)
        else F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def _is_numeric(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")


# --------------------------------------------------------- ranks and windows

def average_rank(df: DataFrame, value: str, out: str = "rank", n_parts: int | None = None) -> DataFrame:
    """1-based average rank of ``value`` over the whole table (ties share
    the mean of their positions); null values get a null rank.

    Distributed without a global window: distinct values are counted
    (partial aggregation), range-partitioned, and ranked with per-partition
    running sums plus the offsets of earlier partitions.  The partition totals
    table has one row per partition (a proven bound), so it is broadcast.  The
    range-partitioned table is checkpointed to freeze partition ids.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    ranged = counts.repartitionByRange(n_parts, value).withColumn("_pid", F.spark_partition_id()).checkpoint()
    tot = ranged.groupBy("_pid").agg(F.sum("_c").alias("_t"))
    offs = tot.select("_pid", (F.sum("_t").over(Window.orderBy("_pid")) - F.col("_t")).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    ranks = local.join(F.broadcast(offs), "_pid").select(
        value, (F.col("_off") + F.col("_before") + (F.col("_c") + 1) / 2.0).alias(out))
    return df.join(ranks, value, "left")


def exact_quantiles(df: DataFrame, value: str, qs: list[float], out_prefix: str = "q") -> DataFrame:
    """Exact linear-interpolated quantiles of a whole column as one row."""
    found = ranks.quantiles(df, {"_q": F.col(value)}, qs)
    return found.select(*[F.col(f"_q_{i}").alias(f"{out_prefix}{i}") for i in range(len(qs))])


def group_quantiles(df: DataFrame, keys, value: str, qs: list[float], out_prefix: str = "q") -> DataFrame:
    """Exact linear-interpolated quantiles per group (null keys dropped), one row per group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    found = ranks.quantiles(df, {"_q": F.col(value)}, qs, keys)
    return found.select(*keys, *[F.col(f"_q_{i}").alias(f"{out_prefix}{i}") for i in range(len(qs))])


def median_and_count(df: DataFrame, key: str, value: str, median_col: str = "median",
                     count_col: str = "n") -> DataFrame:
    """A1/A2: exact median (bounded per task) and row count per group."""
    med = group_quantiles(df, key, value, [0.5], "_m").withColumnRenamed("_m0", median_col)
    cnt = group_agg(df, key, F.count(F.lit(1)).alias(count_col))
    return cnt.join(med, key, "left")


def pearson_spearman(df: DataFrame, a: str, b: str, digits: int | None = 4) -> DataFrame:
    """N, Pearson and Spearman (Pearson of average ranks) of a pair, rows
    with a null in either column dropped; null coefficients below 3 rows.
    ``digits`` None leaves the coefficients unrounded."""
    sub = df.select(a, b).dropna()
    shown = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    rho = ranks.spearman(sub, [(a, b)]).agg(F.max("rho").alias("_rho"))
    base = sub.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, F.corr(a, b)).alias("_r"))
    return base.crossJoin(F.broadcast(rho)).select(
        "n", shown(F.col("_r")).alias("pearson"), shown(F.when(F.col("n") >= 3, F.col("_rho"))).alias("spearman"))


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, r), Spearman of each pair over its complete
    rows, all pairs in one rank pass; null without such rows."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, col_a string, col_b string")
    found = ranks.spearman(df, pairs)
    return names.join(found, "pair", "left").select("col_a", "col_b", F.col("rho").alias("r"))


def top_per_group(df: DataFrame, key, order: list[Column], n: int, rank_col: str = "rank",
                  salt: int = 16) -> DataFrame:
    """First n rows per key by an explicit, total order (tie-break included).

    Two stages so that a hot key never sits whole in one task: rows are
    spread over ``salt`` sub-groups by a hash of their content (stable under
    recomputation), each sub-group keeps its own first n, and the final
    window ranks at most n x salt rows per key.  Exact for a total order.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if salt and salt > 1:
        h = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt))
        w1 = Window.partitionBy(*keys, h).orderBy(*order)
        df = df.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n).drop("_r1")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row per key by an explicit order (no window: ``min_by`` of a
    struct keeps it a partial aggregate even for a hot key)."""
    others = [c for c in df.columns if c != key]
    order_struct = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(F.struct(*others), order_struct).alias("_r")).select(key, "_r.*")


def share_of_group(df: DataFrame, key: str, n_col: str, out: str = "share") -> DataFrame:
    """Value / sum(value) over its key (sum computed by groupBy + join, so a
    hot key is pre-aggregated)."""
    tot = df.groupBy(key).agg(F.sum(n_col).alias("_tot"))
    return df.join(tot, key).withColumn(out, F.col(n_col) / F.col("_tot")).drop("_tot")


def last_turns(df: DataFrame, conv: str, turn: str, role: str, n: int) -> DataFrame:
    """The last n turns of each conversation, starting at a user turn."""
    last = top_per_group(df, conv, [F.desc(turn), F.asc(role)], n, "_rn").drop("_rn")
    first_user = last.filter(F.col(role) == "user").groupBy(conv).agg(F.min(turn).alias("_fu"))
    return last.join(first_user, conv).filter(F.col(turn) >= F.col("_fu")).drop("_fu")


# ------------------------------------------------------------- sorts/limits

def top_n(df: DataFrame, metric: str, n: int = 5, ascending: bool = False, id_col: str = "id") -> DataFrame:
    """L1: top (or bottom) n by a metric, nulls last, ties by id."""
    if metric not in df.columns:
        raise ValueError(f"Column '{metric}' not found")
    o = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    return df.orderBy(o, F.asc(id_col)).limit(n)


def seeded_order(id_col: str, seed: int) -> Column:
    """L4: a portable pseudo-random order, independent of partitioning."""
    # reduced first: ids of 18 or 19 digits would overflow
    return F.pmod(F.pmod(F.col(id_col), F.lit(1000003)) * 7919 + F.lit(seed) * 104729, F.lit(1000003))


def seeded_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """L4: n rows without replacement, reproducible for a seed."""
    return df.orderBy(seeded_order(id_col, seed), F.col(id_col)).limit(n)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """L5."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


# ---------------------------------------------------------------- reshape (R)

def pivot_counts(df: DataFrame, key: str, col: str, values: list, prefix: str = "") -> DataFrame:
    """Counts per (key, value) as columns, missing -> 0 (values passed
    explicitly so no distinct job runs)."""
    p = df.groupBy(key).pivot(col, values).count().fillna(0)
    return p.select(key, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def crosstab_share(df: DataFrame, row: str, col: str, values: list, prefix: str = "") -> DataFrame:
    """R2: row-normalised crosstab."""
    p = pivot_counts(_nonnull_keys(df, [row]), row, col, values, prefix)
    names = [f"{prefix}{v}" for v in values]
    tot = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return p.select(row, *[(F.col(n) / tot).alias(n) for n in names])


def one_hot(df: DataFrame, col: str, values: list, prefix: str) -> DataFrame:
    """One int column per value (null -> all zeros)."""
    return df.withColumns({f"{prefix}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0))
                           for v in values})
