"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through the integer normaliser
``m``, so documents are grouped by equal m: a stratum. Inside a stratum a
term's impact depends on its frequency tf alone; postings are therefore kept
by tf, and an impact is computed once for each (stratum, tf), not per posting.

Index: documents are counted once (terms, frequencies), then dealt in ranges
of (m, a hash) of about ``part_postings`` postings, and each range is cut into
blocks of one stratum with at most ``block_docs`` documents or about
``block_postings`` postings. A hot stratum thus becomes many blocks in many
tasks. A block is one row: its
document ids, its terms, and per (term, tf) the documents, packed as bytes.

Search, for blocks of items (the stated query set): blocks of the index are
projected to the items' terms, which also gives the document frequencies. A
(block, item) pair has the bound sum of w * impact of the block's largest tf.
Bounds order the visits: each item's ``first`` blocks of highest bound are
scored first, then 16 times as many, at last all that are left; after each
round the item's k-th score is its threshold, and blocks whose bound doesn't
reach it are never scored. Scores are exact and no pair at or above the
threshold is left out.

Scores are integers below 2^53 and are added in 64 bits.

Defined cases: null and termless texts (documents or items) give no rows and
count in no statistic; rows that repeat an item id are ranked apart, rows that
repeat a document id are documents of their own; a null document id comes last
in ties; equal scores come by ascending id; items with fewer than k matching
documents get them all; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelens.llm.shared import batches_of, running_totals, shared_dir, written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1
TEXTS, BLOCKS = 200, 8  # rows sent to Python at once
LAST_ROUND = 4096  # visits an item: from here on a round takes all that is left


def terms_of(text: str) -> list[str]:
    """Maximal runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return TERM.findall(text.translate(LOWER))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per document with a term: its length, terms (one string, blank-separated) and frequencies."""
    for pdf in batches:
        ids, lengths, names, counts = [], [], [], []
        for doc, text in zip(pdf["o"].tolist(), pdf["text"].tolist()):
            found = Counter(terms_of(text))
            if found:
                ids.append(doc)
                lengths.append(sum(found.values()))
                names.append(" ".join(found))  # a term has no blank
                counts.append(np.fromiter(found.values(), dtype=np.int32, count=len(found)).tobytes())
        yield pd.DataFrame({"o": ids, "n": lengths, "terms": names, "tfs": counts})


class _Block:
    """Documents of one stratum while a block is put together."""

    def __init__(self, m: int):
        self.m, self.docs, self.names, self.tfs, self.size = m, [], [], [], 0

    def add(self, doc: int, names: str, tfs: bytes) -> None:
        self.docs.append(doc)
        self.names.append(names)
        self.tfs.append(np.frombuffer(tfs, dtype=np.int32))
        self.size += len(tfs) // 4

    def row(self, key: str) -> tuple:
        """Terms in order; per term the sizes of its (tf, documents) groups, tf ascending."""
        number: dict[str, int] = {}
        code = np.array([number.setdefault(t, len(number)) for t in " ".join(self.names).split(" ")], dtype=np.int64)
        terms = sorted(number)
        rank = np.empty(len(terms), dtype=np.int64)
        rank[[number[t] for t in terms]] = np.arange(len(terms))
        term, tf = rank[code], np.concatenate(self.tfs)
        doc = np.repeat(np.arange(len(self.docs), dtype=np.int32), [len(t) for t in self.tfs])
        order = np.lexsort((doc, tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
        sizes = np.diff(np.append(starts, len(term))).astype(np.int32)
        groups = np.bincount(term[starts], minlength=len(terms)).astype(np.int32)
        return (key, self.m, np.array(self.docs, dtype=np.int64).tobytes(), " ".join(terms), groups.tobytes(), tf[starts].tobytes(), sizes.tobytes(), doc.tobytes())


INDEX = "block string, m long, ids binary, terms string, groups binary, tfs binary, sizes binary, docs binary"
COLUMNS = [c.split()[0] for c in INDEX.split(", ")]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 512, block_postings: int = 200_000, part_postings: int = 500_000) -> tuple[DataFrame, int]:
    """The written index of all documents (a row per block) and N, the number of documents with a term."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("o"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    with batches_of(spark, TEXTS):
        counted = written(own.mapInPandas(_counted, "o long, n long, terms string, tfs binary"), "lexical-counts")
    whole = counted.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    if not whole["N"]:
        return spark.createDataFrame([], INDEX), 0
    m = F.expr(f"50 + (50L * n * {whole['N']}L) div {whole['L']}L")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, n, last = None, 0, None
        for pdf in batches:
            out = []
            for m, doc, names, tfs, part in zip(pdf["m"].tolist(), pdf["o"].tolist(), pdf["terms"].tolist(), pdf["tfs"].tolist(), pdf["part"].tolist()):
                if open_ is None or open_.m != m or last != part or len(open_.docs) >= block_docs or open_.size >= block_postings:
                    if open_ is not None:
                        out.append(open_.row(f"{last}-{n}"))
                    open_, n = _Block(m), n + 1
                open_.add(doc, names, tfs)
                last = part
            yield pd.DataFrame(out, columns=COLUMNS)
        if open_ is not None:
            yield pd.DataFrame([open_.row(f"{last}-{n}")], columns=COLUMNS)

    dealt = _dealt(counted.withColumn("m", m), part_postings)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(slots, "part").sortWithinPartitions("part", "m", "h")
    with batches_of(spark, TEXTS):
        return written(sorted_.select("m", "o", "terms", "tfs", "part").mapInPandas(blocks, INDEX), "lexical-index"), whole["N"]


def _dealt(counted: DataFrame, part_postings: int) -> DataFrame:
    """Add ``h`` and ``part``: ranges of (m, h) with about ``part_postings``
    postings each, so that long documents, which have strata of their own,
    don't gather in one task. A stratum's place is the running sum of postings
    over the (small) table of strata, met by its rows under 8 salts."""
    keyed = counted.withColumn("postings", F.length("tfs") / 4).withColumn("h", F.pmod(F.xxhash64("o", "terms"), F.lit(1 << 30)))
    strata = keyed.groupBy("m").agg(F.sum("postings").cast("long").alias("own"))
    placed = running_totals(strata, [F.col("m")], {"before": F.col("own")}, "lexical-strata")
    salted = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    share = F.col("h") / F.lit(float(1 << 30))
    return (keyed.withColumn("salt", (F.col("h") % 8).cast("int")).join(salted, ["m", "salt"])
            .withColumn("part", F.floor((F.col("before") + share * F.col("own")) / part_postings)).drop("salt", "own", "before", "postings"))


@dataclass
class Queries:
    """One block of items: entries sorted by item, terms numbered."""
    items: int
    numbers: dict[str, int]
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray | None = None

    def of(self, item: int) -> slice:
        return slice(*np.searchsorted(self.item, [item, item + 1]))


def _ints(data: bytes, dtype=np.int32) -> np.ndarray:
    return np.frombuffer(data, dtype=dtype)


def _projected(numbers: dict[str, int], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index blocks with the postings of the numbered terms only."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            hits = [(i, numbers[t]) for i, t in enumerate(r.terms.split(" ")) if t in numbers]
            if not hits:
                continue
            at, term = (np.array(v, dtype=np.int64) for v in zip(*hits))
            groups, sizes, docs = _ints(r.groups), _ints(r.sizes), _ints(r.docs)
            g_end, d_end = np.cumsum(groups), np.cumsum(sizes)
            g = np.concatenate([np.arange(e - n, e) for e, n in zip(g_end[at], groups[at])])
            d = np.concatenate([np.arange(e - n, e) for e, n in zip(d_end[g], sizes[g])])
            ends = np.cumsum(groups[at])
            df = np.add.reduceat(sizes[g], ends - groups[at])
            out.append((r.block, r.m, r.ids, term.tolist(), df.tolist(), groups[at].tobytes(), _ints(r.tfs)[g].tobytes(), sizes[g].tobytes(), docs[d].tobytes()))
        yield pd.DataFrame(out, columns=PROJECTED_COLUMNS)


PROJECTED = "block string, m long, ids binary, term array<long>, df array<long>, groups binary, tfs binary, sizes binary, docs binary"
PROJECTED_COLUMNS = [c.split()[0] for c in PROJECTED.split(", ")]


def _bounds(q: Queries, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per (block, item) with a common term: the highest score a document can have there."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            ends, tfs = np.cumsum(_ints(r.groups)), _ints(r.tfs).astype(np.int64)
            top = np.zeros(len(q.numbers), dtype=np.int64)
            top[np.asarray(r.term)] = impact(tfs[ends - 1], r.m)  # tfs of a term ascend
            part = q.weight * top[q.term]
            total = np.zeros(q.items, dtype=np.int64)
            np.add.at(total, q.item, part)
            hit = np.flatnonzero(total)
            out.append(pd.DataFrame({"block": r.block, "item": hit, "bound": total[hit]}))
        yield pd.concat(out) if out else pd.DataFrame({"block": [], "item": [], "bound": []}).astype({"block": str, "item": "int64", "bound": "int64"})


def _scored(q: Queries, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's best k documents at or above its threshold for each item visiting its blocks."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for pdf in batches:
        for r in pdf.itertuples():
            ids = _ints(r.ids, np.int64)
            groups, sizes = _ints(r.groups), _ints(r.sizes)
            score_of = np.repeat(impact(_ints(r.tfs).astype(np.int64), r.m), sizes)  # one impact a (term, tf)
            docs, d_end = _ints(r.docs), np.cumsum(sizes)[np.cumsum(groups) - 1]
            d_start = np.concatenate([[0], d_end[:-1]])
            place = np.full(len(q.numbers), -1)
            place[np.asarray(r.term)] = np.arange(len(r.term))
            for item, floor in zip(r.items, r.floors):
                own = q.of(item)
                total = np.zeros(len(ids), dtype=np.int64)
                for w, p in zip(q.weight[own].tolist(), place[q.term[own]].tolist()):
                    if p >= 0 and w:
                        s = slice(d_start[p], d_end[p])
                        total[docs[s]] += w * score_of[s]  # a document stands once in a term's postings
                so_far = best.get(item)
                if so_far is not None and len(so_far[0]) == k:
                    floor = max(floor, int(so_far[0][-1]))
                hit = np.flatnonzero(total >= max(floor, 1))
                if not len(hit):
                    continue
                score, doc = total[hit], ids[hit]
                if so_far is not None:
                    score, doc = np.concatenate([so_far[0], score]), np.concatenate([so_far[1], doc])
                order = np.lexsort((doc, -score))[:k]
                best[item] = score[order], doc[order]
    out = [np.array([np.full(len(score), item), doc, score]) for item, (score, doc) in best.items()]
    yield pd.DataFrame(np.concatenate([np.zeros((3, 0), dtype=np.int64), *out], axis=1).T, columns=["item", "o", "score"])


SCORED = "item long, o long, score long"


def _best(df: DataFrame, key: str, order: list, k: int, salts: int = 32) -> DataFrame:
    """The first k rows of each key, through salted groups, so that no group grows with the index."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = Window.partitionBy(key, "salt").orderBy(*order)
    kept = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("salt", "rank")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 50, first: int = 16, block_entries: int = 500_000,
           id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0.

    Items go in blocks of about ``block_entries`` characters of text, whose
    terms are sent to all tasks; each block's answer is written."""
    spark = index.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    own = written(items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
                  .withColumn("row", F.monotonically_increasing_id()), "lexical-items")
    size = own.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    out_kind = f"item_id {kind}, rank int, doc_id long, score long"
    if not size["n"] or not n_docs:
        return spark.createDataFrame([], out_kind)
    parts = max(1, -(-int(size["chars"]) // block_entries))
    folder, answers = shared_dir(spark, "lexical-answers"), 0
    for b in range(parts):
        block = own.where(F.pmod(F.xxhash64("row", F.lit("items")), F.lit(parts)) == b).toPandas()
        names = [sorted(set(terms_of(t))) for t in block["text"]]
        if not any(names):
            continue
        numbers = {t: i for i, t in enumerate(sorted({t for n in names for t in n}))}
        q = Queries(len(block), numbers, np.repeat(np.arange(len(block)), [len(n) for n in names]),
                    np.array([numbers[t] for n in names for t in n], dtype=np.int64))
        answer = _answered(index, n_docs, q, k, first)
        if answer is None:
            continue
        rows = block["row"].tolist()
        numbered = spark.createDataFrame([(i, rows[i]) for i in range(len(rows))], "item long, row long")
        (answer.join(F.broadcast(numbered), "item").join(own.select("row", "item_id"), "row")
         .select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("o") != LAST, F.col("o")).alias("doc_id"), "score")
         .write.parquet(f"{folder}/b={b}"))
        answers += 1
    if not answers:
        return spark.createDataFrame([], out_kind)
    return spark.read.schema(out_kind).parquet(folder).select("item_id", "rank", "doc_id", "score")


def _answered(index: DataFrame, n_docs: int, q: Queries, k: int, first: int) -> DataFrame | None:
    """item (its number in the block), o, score, rank of one block of items."""
    spark = index.sparkSession
    numbers = spark.sparkContext.broadcast(q.numbers)
    with batches_of(spark, BLOCKS):
        projected = written(index.mapInPandas(lambda it: _projected(numbers.value, it), PROJECTED), "lexical-projected")
    counts = projected.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1)))
    weights = counts.select("term", weight.alias("w")).toPandas()  # at most the block's terms
    if not len(weights):
        return None
    per_term = np.zeros(len(q.numbers), dtype=np.int64)
    per_term[weights["term"].to_numpy()] = weights["w"].to_numpy()
    q.weight = per_term[q.term]
    sent = spark.sparkContext.broadcast(q)
    score_rows = lambda visits: projected.join(visits, "block").select(*PROJECTED_COLUMNS, "items", "floors").mapInPandas(
        lambda it: _scored(sent.value, k, it), SCORED)
    with batches_of(spark, BLOCKS):
        bounds = written(projected.select("block", "m", "term", "groups", "tfs").mapInPandas(lambda it: _bounds(sent.value, it), "block string, item long, bound long"), "lexical-bounds")
        left, found, size = bounds, None, first
        while not left.isEmpty():
            now = written(_best(left, "item", [F.desc("bound"), F.col("block")], size).drop("rank"), "lexical-visits") if size < LAST_ROUND else left
            floors = F.lit(1).cast("long") if found is None else F.coalesce("floor", F.lit(1).cast("long"))
            visits = now.withColumn("f", floors).groupBy("block").agg(F.collect_list(F.struct("item", "f")).alias("v"))
            scored = score_rows(visits.select("block", F.col("v.item").alias("items"), F.col("v.f").alias("floors")))
            scored = written(scored, "lexical-scored")
            found = scored if found is None else written(_best(found.unionByName(scored), "item", [F.desc("score"), F.col("o")], k).drop("rank"), "lexical-best")
            if size >= LAST_ROUND:
                break
            kth = _best(found, "item", [F.desc("score"), F.col("o")], k).where(F.col("rank") == k).select("item", F.col("score").alias("floor"))
            left = (left.drop("floor").join(now.select("block", "item"), ["block", "item"], "left_anti").join(F.broadcast(kth), "item", "left")  # a row per item of the block
                    .where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))))
            left, size = written(left, "lexical-left"), size * 16
    return _best(found, "item", [F.desc("score"), F.col("o")], k)
