"""Line dedup by a suffix array over line-ID sequences.

The corpus is the sequence of its documents' non-blank lines, in the order of
the document id and the line. Lines that occur once can't be in a repeated
run and end runs, as documents' ends do. The others get order-preserving line
ids, and prefix doubling ranks all suffixes by their first 1, 2, 4, ... lines:
a round pairs the rank of a place with the rank 2^k further on and ranks the
distinct pairs by a distributed range sort. Suffixes of equal rank lie
together in the suffix array: they are its interval with a longest common
prefix of at least that many lines.

A repeated run counts when it has at least ``min_words`` words. Every such
run is a union of shortest windows of that many words (the shortest from a
line on and the shortest up to a line), so the intervals to look at are those
whose prefix is a window of w lines: two ranks of 2^k <= w lines, at its start
and up to its end, identify it. As a non-blank line has a word, w is at most
``min_words`` and log2(min_words) rounds suffice whatever the texts' length.
In each interval the first occurrence stays; lines of later ones are deleted.
Together these windows are exactly the maximal repeated runs, and some copy
of each deleted line stays.

Words are separated by ASCII white space. A blank line goes with the line
before it. Defined cases: null and empty texts stay as they are; repeated
rows and ids are documents of their own, in file order; null ids come first;
a document all of whose lines are deleted keeps an empty text (``dedup``); an
empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.shared import ordered_positions, text_batches, written


def windows(words: list[int], least: int) -> list[tuple[int, int]]:
    """(start, length) of the shortest windows of ``least`` words, from each line on and up to each line."""
    out, hi, total = set(), 0, 0
    for lo in range(len(words)):
        while hi < len(words) and total < least:
            total += words[hi]
            hi += 1
        if total < least:
            break
        out.add((lo, hi - lo))
        total -= words[lo]
    lo, total = 0, 0
    for hi in range(len(words)):
        total += words[hi]
        while total - words[lo] >= least:
            total -= words[lo]
            lo += 1
        if total >= least:
            out.add((lo, hi + 1 - lo))
    return sorted(out)


def _lines(least: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row, text in zip(pdf["__row"], pdf["__text"]):
            raw = [line for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if line.strip()]
            found = windows([len(line.split()) for line in raw], least)
            depth, starts = [-1] * len(raw), [[] for _ in raw]
            for start, n in found:
                starts[start].append(n)
                for k in range(start, start + n):
                    depth[k] = max(depth[k], n.bit_length() - 1)
            out += [(row, k, xxhash.xxh3_128_digest(line), depth[k], starts[k]) for k, line in enumerate(raw) if depth[k] >= 0]
        yield pd.DataFrame(out, columns=["row", "i", "line", "depth", "starts"])


def _cut(ranges: list, text: str) -> tuple[str, int, int]:
    """Text without the ranges of non-blank lines; lines in it, lines deleted."""
    gone = {i for a, n in ranges for i in range(a, a + n)}
    kept, at, drop, deleted = [], -1, False, 0
    lines = text.split("\n")
    for line in lines:
        if line.encode("utf-8", "surrogatepass").strip():
            at += 1
            drop = at in gone
        deleted += drop
        if not drop:
            kept.append(line)
    return "\n".join(kept), len(lines), deleted


def suffix_ranks(lines: DataFrame, rounds: int) -> list[DataFrame]:
    """Per round k the ranks (row, i, rank) of places by their first 2^k lines,
    for places whose 2^k lines occur elsewhere too and are part of a window
    that asks for them."""
    first = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    named = ordered_positions(first, [F.col("line")], "suffix-lines", "rank")
    level = written(lines.select("row", "i", "line", "depth").join(named, "line").drop("line"), "suffix-level")
    out = [level.select("row", "i", "rank")]
    for k in range(1, rounds):
        here = level.where(F.col("depth") >= k)
        there = here.select("row", (F.col("i") - (1 << (k - 1))).alias("i"), F.col("rank").alias("next"))
        pairs = written(here.join(there, ["row", "i"]), "suffix-pairs")
        shared = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select("rank", "next")
        named = ordered_positions(shared, [F.col("rank"), F.col("next")], "suffix-names", "higher")
        level = written(pairs.join(named, ["rank", "next"]).select("row", "i", "depth", F.col("higher").alias("rank")), "suffix-level")
        if level.isEmpty():
            break
        out.append(level.select("row", "i", "rank"))
    return out


def later_copies(numbered: DataFrame, least: int) -> DataFrame:
    """(row, start, n): windows with an equal one earlier in the corpus, from
    ``numbered`` rows (__row, __id, __text)."""
    lines = written(numbered.select("__row", "__text").mapInPandas(
        lambda it: _lines(least, it), "row long, i long, line binary, depth int, starts array<int>"), "lines")
    ranks = suffix_ranks(lines, max(1, least).bit_length())
    wanted = lines.where("size(starts) > 0").select("row", "i", F.explode("starts").alias("n"))
    ids = numbered.select(F.col("__row").alias("row"), F.col("__id").alias("id"))
    found = None
    for k, rank in enumerate(ranks):
        here = wanted.where((F.col("n") >= 1 << k) & (F.col("n") < 2 << k)).join(rank.withColumnRenamed("rank", "head"), ["row", "i"])
        if k:
            tail = rank.select("row", F.col("i").alias("j"), F.col("rank").alias("tail"))
            here = here.withColumn("j", F.col("i") + F.col("n") - (1 << k)).join(tail, ["row", "j"]).drop("j")
        else:
            here = here.withColumn("tail", F.lit(0).cast("long"))
        found = here.withColumn("k", F.lit(k)) if found is None else found.unionByName(here.withColumn("k", F.lit(k)))
    found = written(found.join(ids, "row"), "windows")
    place = F.struct("id", "row", "i")
    first = found.groupBy("k", "n", "head", "tail").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return (found.join(first, ["k", "n", "head", "tail"]).where(place != F.col("first"))
            .select("row", F.col("i").alias("start"), "n"))


def dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines of later copies of repeated runs, with two
    more columns: __lines (lines of the text) and __deleted (of them deleted)."""
    text_batches(docs.sparkSession)
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "linededup-docs")
    keyed = numbered.select("__row", F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    later = later_copies(keyed, min_words)
    per_row = later.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "n")).alias("__ranges"))  # one text's windows
    joined = numbered.join(per_row, "__row", "left")

    @F.pandas_udf("text string, lines int, deleted int")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, ranges):
            if text is None:
                rows.append((None, 0, 0))
            elif found is None or len(found) == 0:
                rows.append((text, text.count("\n") + 1, 0))
            else:
                rows.append(_cut([(r["start"], r["n"]) for r in found], text))
        return pd.DataFrame(rows, columns=["text", "lines", "deleted"])

    cut = cut.asNondeterministic()  # so that a caller's filter on the result isn't pushed below it and cuts every text again
    done = joined.withColumn("__cut", cut(F.col(text_col).cast("string"), "__ranges"))
    out = [F.when(F.col("__cut.deleted") > 0, F.col("__cut.text")).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c)
           for c in docs.columns]
    return done.select(*out, F.col("__cut.lines").alias("__lines"), F.col("__cut.deleted").alias("__deleted"))
