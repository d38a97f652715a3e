"""Connected components of a graph given as a table of edges, by hash-to-minimum rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import look_up, materialise, small


def connected(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (columns a, b, long); the label is the component's smallest node.

    Each round links every node to the smallest node near it (large star, then small star), which at least halves the
    depth of the trees.  Smallest neighbours are found by a grouping with a partial aggregate and looked up without
    gathering a node's edges, and rounds are written to the shared folder, so neither a node with very many neighbours
    nor a lost executor puts work in one place.
    """
    now = materialise(_both(edges).where("a > b").distinct(), "edges")
    while n := now.count():
        large = materialise(_star(_both(now), 2 * n, keep_larger=True), "edges")
        now = materialise(_star(large, large.count(), keep_larger=False), "edges")
        # Done when every node has one edge, to a node that has none: such stars are the components.
        chained = now.join(small(now.select(F.col("a").alias("b")).distinct()), "b", "left_semi")
        if chained.isEmpty() and now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    heads = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return heads.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, total: int, keep_larger: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or the smaller ones and itself) are linked to its smallest neighbour or itself."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("edges")).withColumn("m", F.least("a", "m")), "least")
    linked = look_up(edges, "a", least, "edges", total, "b")
    if keep_larger:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()
