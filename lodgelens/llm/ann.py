"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are built on a bounded sample of about ``fit_rows`` vectors: a node
splits at the median of a random projection, until about ``leaf`` sample
vectors are left. Every row is indexed: it gets its leaf in each tree. A
query opens leaves of all trees in the order of one shared priority queue,
keyed by the largest margin by which the query lies on the other side on the
path, until ``probes`` leaves are open. All rows in open leaves are reranked
by their exact cosine. As the trees have a bounded number of leaves, the
share of rows looked at stays the same as the table grows.

Queries are handled in blocks of ``block`` (what a block sends to all tasks
is bounded); each task keeps only the best k of its rows per query.

Measured recall of the best 5 against brute force is in the README and tests.

Defined cases: vectors that are null, zero, of another length than most or
hold null or non-finite components take no part, neither as query nor as
candidate; rows that repeat an id are rows of their own (a query's own row is
left out, others with its id are not); ties go to the smaller id; with fewer
candidates than k all found are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.llm.shared import written

OUT = "query_row long, query_id {kind}, row long, vec_id {kind}, score double"


def usable(vec: Column, size: int | None = None) -> Column:
    """Whether a vector can take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = vec.isNotNull() & F.forall(vec, fine) & F.exists(vec, lambda x: x != 0)
    return ok if size is None else ok & (F.size(vec) == size)


@dataclass
class Forest:
    """Per tree and inner node (breadth first) a direction and a threshold."""
    depth: int
    directions: np.ndarray  # trees x nodes x dimensions
    thresholds: np.ndarray  # trees x nodes

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def places(self, x: np.ndarray) -> np.ndarray:
        """Leaf number (over all trees) of each vector in each tree."""
        out = np.zeros((len(x), len(self.thresholds)), dtype=np.int32)
        for t in range(len(self.thresholds)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                side = (x * self.directions[t][node]).sum(axis=1) > self.thresholds[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - (self.leaves - 1) + t * self.leaves
        return out

    def opened(self, q: np.ndarray, probes: int) -> list[int]:
        """Leaves of all trees in the order of the shared queue."""
        margin = (self.directions @ q - self.thresholds).tolist()
        queue, out, inner = [(0.0, t, 0) for t in range(len(margin))], [], self.leaves - 1
        while queue and len(out) < probes:
            bound, t, node = heapq.heappop(queue)
            row = margin[t]
            while node < inner:
                m = row[node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(bound, abs(m)), t, far))
                node = near
            out.append(node - inner + t * self.leaves)
        return out


def grow(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One tree: directions and thresholds of its inner nodes."""
    rng = np.random.default_rng(seed)
    nodes, dims = (1 << depth) - 1, sample.shape[1]
    directions = rng.normal(size=(nodes, dims)).astype(np.float32)
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    thresholds = np.zeros(nodes, dtype=np.float32)
    groups = {0: np.arange(len(sample))}
    for node in range(nodes):
        rows = groups.pop(node, np.zeros(0, dtype=np.int64))
        p = sample[rows] @ directions[node]
        if len(rows):
            thresholds[node] = np.median(p)
        side = p > thresholds[node]
        if 2 * node + 1 < nodes:
            groups[2 * node + 1], groups[2 * node + 2] = rows[~side], rows[side]
    return directions, thresholds


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def build(rows: DataFrame, n: int, size: int, trees: int, leaf: int, fit_rows: int) -> Forest:
    """Trees grown in parallel tasks on one sample sent to all."""
    spark = rows.sparkSession
    draw = F.pmod(F.xxhash64("row", F.lit("forest")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < min(1.0, fit_rows / max(1, n))).select("embedding").toPandas()["embedding"].tolist()
    depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf))))
    held = spark.sparkContext.broadcast(_unit(sample).astype(np.float32) if sample else np.zeros((0, size), dtype=np.float32))

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf["id"].tolist():
                directions, thresholds = grow(held.value, depth, t)
                yield pd.DataFrame({"t": [t], "directions": [directions.tobytes()], "thresholds": [thresholds.tobytes()]})

    made = sorted(spark.range(0, trees, 1, trees).mapInPandas(grown, "t long, directions binary, thresholds binary").collect())
    read = lambda b: np.frombuffer(b, dtype=np.float32)
    return Forest(depth, np.array([read(r["directions"]).reshape(-1, size) for r in made]), np.array([read(r["thresholds"]) for r in made]))


def search(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = 24, leaf: int = 48, fit_rows: int = 20_000,
           probes: int = 300, block: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    out_kind = OUT.format(kind=kind)
    fine = vectors.withColumn("__q", F.coalesce(is_query, F.lit(False))).select(
        F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"), F.col("__q").alias("is_query")).where(usable(F.col("embedding")))
    sizes = fine.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    numbered = fine.where(F.size("embedding") == sizes["d"]).withColumn("row", F.monotonically_increasing_id())
    rows = written(numbered, "ann-rows")
    forest = spark.sparkContext.broadcast(build(rows, sizes["n"], sizes["d"], trees, leaf, fit_rows))

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo:lo + 2000]
                yield part[["row", "vec_id", "embedding"]].assign(leaves=list(forest.value.places(_unit(part["embedding"].tolist()).astype(np.float32))))

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            unit = _unit(pdf["embedding"].tolist()).astype(np.float32) if len(pdf) else []
            yield pdf[["row", "vec_id", "embedding"]].assign(leaves=[forest.value.opened(q, probes) for q in unit])

    index = written(rows.select("row", "vec_id", "embedding").mapInPandas(
        indexed, f"row long, vec_id {kind}, embedding array<double>, leaves array<int>"), "ann-index")
    wanted = rows.where("is_query").select("row", "vec_id", "embedding")
    slots = max(1, spark.sparkContext.defaultParallelism)
    queries = written(wanted.repartition(4 * slots).mapInPandas(
        opened, f"row long, vec_id {kind}, embedding array<double>, leaves array<int>"), "ann-queries")
    blocks = -(-max(1, queries.count()) // block)
    part = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks))
    found = None
    for b in range(blocks):
        held = spark.sparkContext.broadcast(queries.where(part == b).toPandas())
        one = index.mapInPandas(lambda it, held=held: _reranked(held.value, k, forest.value.leaves * trees, it), out_kind)
        found = one if found is None else found.unionByName(one)
    best = written(found, "ann-found")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _reranked(queries: pd.DataFrame, k: int, leaves: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best k of a task's rows for each query, by exact cosine."""
    if not len(queries):
        return
    q = _unit(queries["embedding"].tolist())
    best: list[list] = [[] for _ in range(len(q))]
    ids, rows = queries["vec_id"].tolist(), queries["row"].tolist()
    for pdf in batches:
        if not len(pdf):
            continue
        x = _unit(pdf["embedding"].tolist())
        at = np.array([np.asarray(v) for v in pdf["leaves"]])
        flat, who = at.ravel(), np.repeat(np.arange(len(x)), at.shape[1])
        order = np.argsort(flat, kind="stable")
        who, ends = who[order], np.searchsorted(flat[order], np.arange(leaves + 1))
        vec, row = pdf["vec_id"].to_numpy(), pdf["row"].to_numpy()
        for n, probe in enumerate(queries["leaves"]):
            mark = np.zeros(len(x), dtype=bool)
            for p in probe:
                mark[who[ends[p]:ends[p + 1]]] = True
            cand = np.flatnonzero(mark & (row != rows[n]))
            if not len(cand):
                continue
            score = np.clip((x[cand] * q[n]).sum(axis=1), -1.0, 1.0)
            if len(cand) > k:
                cut = np.partition(score, len(cand) - k)[len(cand) - k]
                keep = score >= cut
                cand, score = cand[keep], score[keep]
            top = sorted(zip((-score).tolist(), vec[cand].tolist(), row[cand].tolist()))[:k]
            best[n] = sorted(best[n] + top)[:k]
    out = [(rows[n], ids[n], r, v, -s) for n, top in enumerate(best) for s, v, r in top]
    yield pd.DataFrame(out, columns=["query_row", "query_id", "row", "vec_id", "score"])
