"""Hard negatives by exact integer scores from subset-sum tables (Four Russians).

Components become integers floor(256 x). An anchor's integers are cut into
groups of eight dimensions; for each group a table holds the sums of all 256
subsets of its eight integers. A candidate is kept as two's complement bit
planes: for plane p and group g one byte holds bit p of eight integers. The
byte picks the subset sum directly, so a plane's part of the inner product is
one lookup a group, and planes add up by shifts, the sign plane negatively.
Scores are the full exact integer inner products; nothing is estimated.

The tables of ``lanes`` anchors lie side by side, so that one byte fetches the
sums of all of them at once.

Anchors are the stated query set. They are taken in blocks of ``block``: what
a block sends to all tasks is bounded, it is dropped before the next one, and
each block's result is written. All rows are scored against a block twice:
first rows of the anchors' own labels for the positives, then rows of other
labels inside each positive's band. A task keeps the best few rows per anchor
(and positive) only, and those meet in a window of as many rows per key as
there are tasks, so neither a hot label nor a group of copies gathers anywhere.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; shorter vectors count as filled up with zeros (an
empty one scores 0 everywhere); rows that repeat an id are rows of their own,
and an anchor's positives are other rows, not other ids; ties go to the
smaller id, then to the earlier row; a null id takes part as candidate, behind
all others in ties; without positives or negatives an anchor gives no rows; an
empty table gives no rows. Components so large that a score could pass 64 bits
raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.llm.shared import shared_dir, written

LANES = 64  # anchors whose tables lie side by side
ROWS = 1024  # candidates scored at once


def integer_rows(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str, vec_col: str) -> DataFrame:
    """row, vec_id, label, ints, is_anchor of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v * 256).cast("double"))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), scaled.alias("ints"),
                         F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), x.isNotNull().alias("there"), fine.alias("fine"))
    rows = own.where("label IS NOT NULL AND there AND fine").drop("there", "fine")
    return rows.withColumn("row", F.monotonically_increasing_id())


def bit_planes(ints: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes: bit p of eight neighbouring integers."""
    wrapped = ints & ((1 << planes) - 1)  # two's complement in so many bits
    bits = (wrapped[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """(groups, 256, anchors): sums of all subsets of each group of eight integers."""
    n, dims = anchors.shape
    filled = np.zeros((n, -(-dims // 8) * 8), dtype=dtype)
    filled[:, :dims] = anchors
    grouped = filled.reshape(n, -1, 8)
    out = np.zeros((grouped.shape[1], 256, n), dtype=dtype)
    for bit in range(8):  # subsets with this highest member are those below it, plus the member
        out[:, 1 << bit:2 << bit] = out[:, :1 << bit] + grouped[:, :, bit].T[:, None, :]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) exact inner products, from the sign plane down."""
    total = None
    for p in range(planes.shape[1] - 1, -1, -1):
        part = np.take(tables[0], planes[:, p, 0], axis=0)
        for g in range(1, len(tables)):
            part += np.take(tables[g], planes[:, p, g], axis=0)
        if total is None:
            total = np.negative(part, out=part)  # the sign plane weighs -2 ** (planes - 1)
        else:
            total <<= 1
            total += part
    return total


@dataclass
class Block:
    """Anchors of one block, sent to all tasks."""
    row: np.ndarray
    label: np.ndarray
    tables: list[np.ndarray]  # of LANES anchors each
    low: np.ndarray | None = None  # bands: anchors x positives, 100 * score bounds
    high: np.ndarray | None = None


def _matrix(values: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(values), dims), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, :len(v)] = v
    return out


def _first(score: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k times the best row of each column, earlier rows first; spent rows become the lowest value."""
    none, at = np.iinfo(score.dtype).min, np.arange(score.shape[1])
    for _ in range(min(k, len(score))):
        best = score.argmax(axis=0)
        found = score[best, at] > none
        if not found.any():
            return
        yield np.flatnonzero(found), best[found]
        score[best, at] = none


def _kept(best: dict, k: int) -> dict:
    return {key: sorted(rows)[:k] for key, rows in best.items()}


def _scan(block: Block, planes: int, groups: int, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's best k rows for each (anchor, positive): same label where the block has no bands, else other labels inside the band."""
    best: dict[tuple[int, int], list] = {}
    for pdf in batches:
        pdf = pdf.sort_values(["o", "row"], kind="stable")
        for lo in range(0, len(pdf), ROWS):
            part = pdf.iloc[lo:lo + ROWS]
            ids, rows = part["o"].to_numpy(), part["row"].to_numpy()
            code = np.frombuffer(b"".join(part["planes"]), dtype=np.uint8).reshape(len(part), planes, groups)
            label = part["label"].to_numpy()
            for t, tables in enumerate(block.tables):
                first = t * LANES
                lanes = slice(first, first + tables.shape[2])
                same = label[:, None] == block.label[lanes][None, :]
                if block.low is None:
                    mine = np.flatnonzero(same.any(axis=1))  # rows whose label one of these anchors has
                    if not len(mine):
                        continue
                    s = scores(tables, code[mine])
                    s[~(same[mine] & (rows[mine][:, None] != block.row[lanes][None, :]))] = np.iinfo(s.dtype).min
                    found = [(0, mine, s)]
                else:
                    s = scores(tables, code)
                    s100 = s.astype(np.int64) * 100
                    found = []
                    for j in range(block.low.shape[1]):
                        band = ~same & (s100 >= block.low[lanes, j][None, :]) & (s100 <= block.high[lanes, j][None, :])
                        if band.any():
                            found.append((j, np.arange(len(part)), np.where(band, s, np.iinfo(s.dtype).min)))
                for j, at, s in found:
                    for cols, who in _first(s, k):
                        for c, w in zip(cols.tolist(), who.tolist()):
                            best.setdefault((first + c, j), []).append((-int(s[w, c]), int(ids[at[w]]), int(rows[at[w]])))
            best = _kept(best, k)
    out = [(int(block.row[a]), j, i, r, -s) for (a, j), rows in best.items() for s, i, r in rows]
    yield pd.DataFrame(out, columns=["anchor_row", "j", "o", "row", "score"])


FOUND = "anchor_row long, j int, o long, row long, score long"


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    Of each anchor's best ``positives`` other rows of its label, the best
    ``negatives`` rows of other labels scoring ``low`` to ``high`` percent of
    the positive's score."""
    spark = vectors.sparkSession
    rows = written(integer_rows(vectors, is_anchor, label, id_col, vec_col), "hardneg-rows")
    size = rows.agg(F.max(F.size("ints")).alias("dims"), F.min(F.array_min("ints")).alias("low"), F.max(F.array_max("ints")).alias("high")).first()
    empty = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"
    if size["dims"] is None:
        return spark.createDataFrame([], empty)
    dims, top = max(1, size["dims"]), max(abs(size["low"] or 0.0), abs(size["high"] or 0.0), 1.0)
    if 200.0 * dims * top * top >= 2.0 ** 63:
        raise ValueError("components too large for exact 64-bit scores")
    planes, groups = int(top).bit_length() + 1, -(-dims // 8)
    dtype = np.int32 if 4.0 * dims * top * top < 2.0 ** 31 else np.int64

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), ROWS):
                part = pdf.iloc[lo:lo + ROWS]
                code = bit_planes(_matrix(part["ints"], dims), planes)
                yield part[["row", "o", "label"]].assign(planes=[c.tobytes() for c in code])

    kind = rows.schema["label"].dataType.simpleString()
    o = F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("o")  # null ids come last in ties
    codes = written(rows.select("row", o, "label", "ints").mapInPandas(packed, f"row long, o long, label {kind}, planes binary"), "hardneg-planes")
    anchors = rows.where("is_anchor")
    blocks = -(-anchors.count() // block)
    if not blocks:
        return spark.createDataFrame([], empty)
    dealt = anchors.select("row", "label", "ints", F.pmod(F.xxhash64("row", F.lit("anchor")), F.lit(blocks)).alias("b"))

    def scanned(held: Block, k: int) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(held)
        found = codes.mapInPandas(lambda it: _scan(sent.value, planes, groups, k, it), FOUND)
        order = Window.partitionBy("anchor_row", "j").orderBy(F.desc("score"), "o", "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), sent

    folder = shared_dir(spark, "hardneg-found")
    for b in range(blocks):
        own = dealt.where(F.col("b") == b).toPandas()
        if not len(own):
            continue
        ints = _matrix(own["ints"], dims)
        held = Block(own["row"].to_numpy(), own["label"].to_numpy(), [subset_sums(ints[i:i + LANES], dtype) for i in range(0, len(own), LANES)])
        found, sent = scanned(held, positives)
        best = written(found, "hardneg-positives").toPandas()  # at most positives x block rows
        sent.destroy()
        place = {r: i for i, r in enumerate(held.row.tolist())}
        held.low = np.full((len(own), positives), np.iinfo(np.int64).max)
        held.high = np.full((len(own), positives), np.iinfo(np.int64).min)
        at, nth = best["anchor_row"].map(place).to_numpy(dtype=np.int64), best["rank"].to_numpy(dtype=np.int64) - 1
        held.low[at, nth], held.high[at, nth] = best["score"].to_numpy() * low, best["score"].to_numpy() * high
        found, sent = scanned(held, negatives)
        found.write.parquet(f"{folder}/negatives/b={b}")
        spark.createDataFrame(best[["anchor_row", "rank", "row", "score"]].astype("int64"), "anchor_row long, rank long, row long, score long").write.parquet(f"{folder}/positives/b={b}")
        sent.destroy()
    wrong = spark.read.schema(FOUND + ", rank int").parquet(f"{folder}/negatives")
    right = spark.read.schema("anchor_row long, rank long, row long, score long").parquet(f"{folder}/positives")
    named = rows.select("row", "vec_id")
    chosen = (wrong.select("anchor_row", (F.col("j") + 1).alias("positive_rank"), "rank", F.col("row").alias("n_row"), F.col("score").alias("negative_score"))
              .join(right.select("anchor_row", F.col("rank").cast("int").alias("positive_rank"), F.col("row").alias("p_row"), F.col("score").alias("positive_score")),
                    ["anchor_row", "positive_rank"]))
    for key, name in (("anchor_row", "anchor_id"), ("p_row", "positive_id"), ("n_row", "negative_id")):
        chosen = chosen.join(named.select(F.col("row").alias(key), F.col("vec_id").alias(name)), key)
    return chosen.select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
