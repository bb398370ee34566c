"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelens.session import ensure_checkpoint_dir


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the undirected ``edges``; root is the
    smallest node of its component.

    Alternates two rounds on edges (u, v) with v < u until nothing changes:
    every node hands its larger neighbours to its smallest one (large star),
    then its smaller neighbours (small star).  Rounds grow with the logarithm
    of the component size; each is a grouped minimum and a join, checkpointed
    to the shared folder."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = (edges.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint())
    while True:
        sides = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v")))
        nxt = small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
        done = nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty()
        e = nxt
        if done:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
