"""Packing by cutting-stock column generation.

Documents are tokenised, closed by an end id and cut at multiples of the
sequence length; what remains of each is one piece of 1..L-1 ids. The counts
of pieces by length class (at most L / unit rows, whatever the corpus size)
are the demands of a cutting-stock linear program. Columns are patterns (how
many pieces of each class share a sequence); a knapsack dynamic program
prices new ones from the duals until none improves the bound by ``gap``.
Patterns are used floor(x) times; pieces get ranks within their class and
rank ranges map to pattern uses. The few pieces that rounding leaves (bounded
by the number of patterns times their pieces) are laid end to end and cut at
the sequence length; the tail is cut into powers of two, which need no
padding.

Defined cases: a null or empty text is just the end id; repeated rows and
repeated or null ids are packed row by row; an empty table gives no rows;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.llm.bpe import WordEncoder
from lodgelens.llm.shared import text_batches, written


def by_chars(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters."""
    lo, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield lo, k + 1
            lo, n = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _tokenised(path: str, seq_len: int, end_id: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    enc, end = WordEncoder(path), np.asarray([end_id], dtype="<u4").tobytes()
    for pdf in batches:
        for lo, hi in by_chars(pdf["text"].tolist()):
            part = pdf.iloc[lo:hi]
            ids, ends = enc.encode_all([t or "" for t in part["text"]])
            out, at = [], 0
            for doc, stop in zip(part["doc_id"], ends.tolist()):
                raw = ids[at:stop].tobytes() + end
                at, n = stop, len(raw) // 4
                for s in range(0, n, seq_len):
                    piece = raw[4 * s:4 * (s + seq_len)]
                    short = len(piece) < 4 * seq_len
                    out.append((doc, n, s, len(piece) // 4, zlib.crc32(piece), piece if short else None))
            yield pd.DataFrame(out, columns=["doc_id", "doc_tokens", "start", "length", "crc", "ids"])


# ---- the linear program over length classes (bounded: classes = seq_len / unit)

def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: class c (1-based) has size c and values[c-1]."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    v = np.maximum(values, 0.0)
    for room in range(1, capacity + 1):
        gains = v[:room] + best[room - 1::-1]
        k = int(np.argmax(gains))
        best[room], pick[room] = gains[k], k + 1
    pattern, room = np.zeros(capacity, dtype=np.int64), capacity
    while room > 0 and pick[room]:
        if v[pick[room] - 1] > 0:
            pattern[pick[room] - 1] += 1
        room -= int(pick[room])
    return float(best[capacity]), pattern


def first_patterns(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible start: patterns filled largest class first, each used until
    a class runs out. A pattern ends one class and later ones lack it, so the
    patterns form a basis (some at use 0 when classes run out together)."""
    left, open_, cols, uses = demand.astype(float).copy(), demand > 0, [], []
    while open_.any():
        pattern, room = np.zeros(capacity, dtype=np.int64), capacity
        for c in np.flatnonzero(open_)[::-1]:
            pattern[c], room = room // (c + 1), room % (c + 1)
        ratio = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        ended = int(np.argmin(ratio))
        left = np.maximum(left - ratio[ended] * pattern, 0)
        open_[ended] = False
        cols.append(pattern)
        uses.append(ratio[ended])
    return np.array(cols).T, np.array(uses)


def solve_patterns(demand: np.ndarray, capacity: int, gap: float = 1e-5, max_rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: (patterns as columns over the classes, uses x).

    Revised simplex on sum(x) minimal, patterns @ x = demand, from
    ``first_patterns``. It ends when the objective z is within ``gap`` of a
    lower bound: z / best knapsack value, or all sizes over the capacity.
    ``max_rounds`` bounds the driver's time; any round's solution is feasible."""
    have = np.flatnonzero(demand)
    cols, x = first_patterns(demand, capacity)
    m, bound = len(have), float(demand @ np.arange(1, capacity + 1)) / capacity
    inv = np.linalg.inv(cols[have].astype(float))
    for step in range(max_rounds):
        if x.sum() <= (1 + gap) * bound:
            break
        y = inv.sum(axis=0)
        values = np.zeros(capacity)
        values[have] = y
        worth, a = best_pattern(values, capacity)
        if worth <= 1 + gap:
            break
        d = inv @ a[have]
        ok = d > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = np.maximum(x[ok], 0) / d[ok]
        r = int(np.argmin(ratio))
        t = ratio[r]
        x = x - t * d
        x[r] = t
        row = inv[r] / d[r]
        inv = inv - np.outer(d, row)
        inv[r] = row
        cols[:, r] = a
        if step % 200 == 199:
            inv = np.linalg.inv(cols[have].astype(float))
            x = np.maximum(inv @ demand[have], 0)
    return cols, np.maximum(x, 0)


def rounded_uses(cols: np.ndarray, x: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """floor(x), then patterns by falling fraction as often as what is left allows."""
    uses = np.floor(x + 1e-9).astype(np.int64)
    while ((left := demand - cols @ uses) < 0).any():  # rounding noise of the floats
        uses[np.argmax(uses * (cols[left < 0].sum(axis=0) > 0))] -= 1
    for p in np.argsort(-(x - np.floor(x)), kind="stable"):
        need = cols[:, p] > 0
        more = int((left[need] // cols[need, p]).min()) if need.any() else 0
        if more > 0:
            uses[p] += more
            left = left - more * cols[:, p]
    return uses


def plan_segments(demand: np.ndarray, capacity: int, gap: float) -> tuple[np.ndarray, int]:
    """Rows (class, first rank, last rank + 1, pieces a use, first sequence,
    first slot), sorted by class and rank; the number of sequences."""
    if not demand.any():
        return np.zeros((0, 6), dtype=np.int64), 0
    cols, x = solve_patterns(demand.astype(float), capacity, gap)
    uses = rounded_uses(cols, x, demand)
    next_rank, rows, base = np.zeros(capacity, dtype=np.int64), [], 0
    for p in np.flatnonzero(uses):
        slot = 0
        for c in np.flatnonzero(cols[:, p])[::-1]:
            a, k = int(cols[c, p]), int(uses[p])
            rows.append((c + 1, next_rank[c], next_rank[c] + a * k, a, base, slot))
            next_rank[c] += a * k
            slot += a
        base += int(uses[p])
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6), base


def _assigned(segments: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first = segments[:, 0] * (1 << 44) + segments[:, 1]
    for pdf in batches:
        cls, rank = pdf["cls"].to_numpy(), pdf["rank"].to_numpy()
        at = np.searchsorted(first, cls * (1 << 44) + rank, side="right") - 1
        hit = np.zeros(len(pdf), dtype=bool)
        seq, slot = np.full(len(pdf), -1), np.zeros(len(pdf), dtype=np.int64)
        if len(segments) and len(pdf):
            s = segments[np.maximum(at, 0)]
            hit = (at >= 0) & (s[:, 0] == cls) & (rank < s[:, 2])
            j = rank - s[:, 1]
            seq = np.where(hit, s[:, 4] + j // s[:, 3], -1)
            slot = np.where(hit, s[:, 5] + j % s[:, 3], 0)
        yield pdf.drop(columns=["cls", "rank"]).assign(sequence_id=seq, slot=slot)


def _cut(seq_len: int, total: int, base: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut pieces lying at ``at`` of one long line: at multiples of seq_len, the tail at powers of two."""
    edges, tail = [total - total % seq_len], total % seq_len
    for bit in reversed(range(seq_len.bit_length())):
        if tail >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    edges, full = np.array(edges), total // seq_len
    for pdf in batches:
        out = []
        for doc, n, start, length, at, ids in zip(*(pdf[c] for c in ("doc_id", "doc_tokens", "start", "length", "at", "ids"))):
            done = 0
            while done < length:
                here = at + done
                if here < edges[0]:
                    seq, begin = here // seq_len, here - here % seq_len
                    stop = begin + seq_len
                else:
                    k = int(np.searchsorted(edges, here, side="right"))
                    seq, begin, stop = full + k - 1, edges[k - 1], edges[k]
                take = int(min(length - done, stop - here))
                part = ids[4 * done:4 * (done + take)]
                out.append((doc, start + done, take, zlib.crc32(part), n, base + int(seq), int(here - begin)))
                done += take
        yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, unit: int = 4,
         gap: float = 1e-5, bucket_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.

    ``unit`` is the width of a length class in ids; ``bucket_rows`` bounds how
    many pieces of one class a task ranks, so copies of one document (all of
    one length) are split over tasks."""
    id_type = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    text_batches(spark)
    tokens = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        lambda it: _tokenised(tokenizer_path, seq_len, end_id, it),
        f"doc_id {id_type}, doc_tokens long, start long, length long, crc long, ids binary")
        .withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    capacity = seq_len // unit
    pieces = tokens.drop("ids").withColumn("cls", F.when(F.col("length") == seq_len, capacity + 1).otherwise(
        F.ceil(F.col("length") / unit)).cast("long"))
    counts = {r["cls"]: r["n"] for r in pieces.groupBy("cls").agg(F.count("*").alias("n")).collect()}  # <= capacity + 1 rows
    if not counts:
        return spark.createDataFrame([], f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    demand = np.array([counts.get(c, 0) for c in range(1, capacity + 1)], dtype=np.int64)
    segments, n_seq = plan_segments(demand, capacity, gap)
    whole = counts.get(capacity + 1, 0)  # full-length pieces: one a sequence
    segments = np.vstack([segments, [[capacity + 1, 0, max(whole, 1), 1, n_seq, 0]]]).astype(np.int64)
    base = n_seq + whole

    per_class = F.create_map(*[F.lit(int(v)) for c, n in counts.items() for v in (c, -(-n // bucket_rows))])
    dealt = pieces.withColumn("b", F.pmod(F.xxhash64("row"), F.coalesce(per_class[F.col("cls").cast("int")], F.lit(1))).cast("long"))
    sizes = dealt.groupBy("cls", "b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cls").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("cls", "b", F.coalesce(before, F.lit(0)).alias("o"))
    ranked = (dealt.withColumn("r", F.row_number().over(Window.partitionBy("cls", "b").orderBy("doc_id", "start", "row")))
              .join(offsets, ["cls", "b"]).withColumn("rank", F.col("o") + F.col("r") - 1).drop("o", "r", "b"))
    placed = written(ranked.mapInPandas(
        lambda it: _assigned(segments, it),
        f"doc_id {id_type}, doc_tokens long, start long, length long, crc long, row long, sequence_id long, slot long"), "pack-placed")

    in_order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    fitted = placed.where("sequence_id >= 0").select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(in_order), F.lit(0)).cast("long").alias("offset"))

    # what rounding left: bounded by patterns x their pieces, so one ordered pass over lengths is enough and their places are sent to all tasks
    rest = placed.where("sequence_id < 0")
    total = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    line = rest.select("row", F.coalesce(F.sum("length").over(Window.orderBy(F.desc("length"), "row").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    cut = tokens.join(F.broadcast(line), "row").select("doc_id", "doc_tokens", "start", "length", "at", "ids").mapInPandas(
        lambda it: _cut(seq_len, total, base, it),
        f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return fitted.unionByName(cut)
