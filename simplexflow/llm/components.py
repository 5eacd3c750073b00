"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexflow.plans.lineage import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges ``u > v``: hang nodes on the least node next to them.  Every edge gives one at most; some may be equal.

    Minima come from a partial aggregate, so a node with very many links costs one row per
    task; the join back can be split where a node is hot.
    """
    if large:
        both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        least = edges.select(F.inline(both)).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # the edge to the least node stays, the others' ends hang on that node
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (least node of its component) for every node of ``edges(u, v)``.

    Loops and repeated edges are harmless; an empty table gives an empty table.  The number of
    rounds grows with the logarithm of a component's size, and each round ends in a checkpoint.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = cut(edges.distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = cut(_stars(_stars(edges, True), False).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
