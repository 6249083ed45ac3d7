"""Connected components of an edge table by alternating large and small stars.

The work of a round is in proportion to the edges, whatever the degree of a node: each step is a minimum by node, combined
before the shuffle, and one join. Nothing of it is collected; rounds end when the edges stay the same. Each
round is a checkpoint, and so are the minima: a join of plain shuffles is one that Spark can split at a node of many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import checkpoint_folder


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, label for each node with an edge; label is the smallest node of its component."""
    checkpoint_folder(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()
    before = None
    while (found := _print_of(now)) != before and found[0]:
        before = found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = large.checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    # at the end every edge leads to its component's smallest node
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
