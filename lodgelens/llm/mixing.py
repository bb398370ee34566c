"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled, repeatable order (by a
hash of seed, id and size), walked through up to ``repeats`` times. A document
that ends ``c`` words into its source's queue finishes at virtual time
``c / target`` of its source. All documents of all queues are range-sorted by
finish time, which interleaves the sources in their target proportions at
every point of the mix, and the order is truncated at the total budget.

At virtual time 1 each queue has given its whole target. The one document
that a queue is in the middle of then is cut there into two packets, as a
network cuts long messages, so a source misses its target by less than a
word, plus the words by which the rounded targets fall short of the budget.

Targets: sources in code point order (null last) weigh ``weights`` in turn and
share ``percent`` percent of all words. A target stops at ``repeats`` times
its source's words; the excess is shared again by weight until no target is
above. That is the level at which min(cap, level * weight) adds up to the
budget, found by running sums in the order of cap / weight.

Nothing passes one task: both orders are range sorts with partition offsets,
and a hot source's rows are spread by its shuffle keys. The table of sources
meets the rows under 16 salts; it is broadcast only if Spark finds it small.

Only DataFrame functions run, no Python.

Defined cases: null and wordless texts have size 0 and take no words; a null
source is a source of its own; rows that repeat an id are documents of their
own; without any words all targets are 0; an empty table gives no rows; other
columns are ignored. Reruns agree, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.shared import running_totals, written

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 16


def source_targets(sized: DataFrame, weights: tuple[int, ...], percent: int, repeats: int) -> tuple[DataFrame, int]:
    """Per source: source, place, source_size, before (words of earlier sources), target; and the budget in words."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1), "before": F.col("source_size")}, "mix-sources")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    filled = written(running_totals(ranked, [F.col("source_size") / F.col("weight"), F.col("place")],
                                    {"caps": F.col("source_size"), "heavier": F.col("weight")}, "mix-levels"), "mix-levels")
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight = int(whole["words"] or 0), int(whole["weight"] or 0)
    wide = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("decimal(38,0)")
    # capped: the level with all lower sources at their caps is at or above this source's cap / weight
    filled = filled.withColumn("capped", (wide(percent * words) - wide("caps") * (100 * repeats)).cast("double") * F.col("weight")
                               >= (wide("source_size") * (100 * repeats)).cast("double") * (F.lit(weight) - F.col("heavier")))
    used = filled.agg(F.sum(F.when(F.col("capped"), F.col("source_size"))).alias("words"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("weight")).first()
    level = (percent * words - 100 * repeats * int(used["words"] or 0)) / (100 * int(used["weight"])) if used["weight"] else 0.0
    target = F.when(F.col("capped"), (repeats * F.col("source_size")).cast("double")).otherwise(F.lit(float(level)) * F.col("weight"))
    return filled.select("source", "place", "source_size", "before", target.alias("target")), min(percent * words // 100, repeats * words)


def packets(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, repeats: int = 2, seed: int = 13,
            id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All packets in the order of the mix, those behind the budget with no words taken.

    Columns: row (the document's), doc_id, source, size, source_size, target,
    copy (which walk through the source), first_word (of the document, from 0),
    words, finish (virtual time), position (words of the mix before it),
    taken (words of it that the mix takes, its first ones)."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "mix-sizes")
    sources, budget = source_targets(sized, weights, percent, repeats)
    salted = written(sources, "mix-targets").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "s")
    text = F.concat_ws("-", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"))
    keyed = sized.withColumn("key", F.substring(F.md5(text), 1, 16)).withColumn("k", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    joined = keyed.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("k") == F.col("salt"))).drop("s", "k", "salt")
    order = [F.col("place"), F.col("key"), F.col("doc_id"), F.col("size")]
    queued = running_totals(joined, order, {"row": F.lit(1), "c": F.col("size")}, "mix-queues").withColumn("c", F.col("c") - F.col("before"))
    cut = "cast(floor(target) as bigint)"
    piece = "named_struct('copy', r, 'first_word', {first}, 'words', {words}, 'ends', {ends})"
    whole = piece.format(first="0L", words="size", ends="r * source_size + c + size")
    halves = (piece.format(first="0L", words=f"{cut} - r * source_size - c", ends=cut) + ", "
              + piece.format(first=f"{cut} - r * source_size - c", words=f"r * source_size + c + size - {cut}", ends="r * source_size + c + size"))
    inside = f"r * source_size + c < {cut} and {cut} < r * source_size + c + size"
    made = queued.withColumn("p", F.expr(f"explode(flatten(transform(sequence(0L, {repeats - 1}L), r -> if({inside}, array({halves}), array({whole})))))"))
    made = made.select("row", "doc_id", "source", "place", "size", "source_size", "target", "p.*").withColumn(
        "finish", F.when(F.col("target") > 0, F.col("ends") / F.col("target")).otherwise(F.lit(0.0)))
    mixed = running_totals(made, [F.col("finish"), F.col("place"), F.col("ends"), F.col("row")], {"position": F.col("words")}, "mix-order")
    taken = F.least(F.col("words"), F.greatest(F.lit(budget) - F.col("position"), F.lit(0)))
    return mixed.withColumn("taken", taken.cast("long")).drop("place", "ends")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the packets it takes, each with its place in it."""
    return packets(docs, **settings).where("taken > 0")


def taken_words(docs: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and taken, the words the mix takes of it with repeats."""
    return (packets(docs, **settings).groupBy("row", "doc_id", "source", "size", "source_size", "target")
            .agg(F.sum("taken").alias("taken")).drop("row"))
