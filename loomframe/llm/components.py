"""Connected components of an edge table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node that it can reach.

    Each round a node takes the least label among its own and its neighbours', then
    the label of its label, which halves the depth of what is left; a round is
    written to the shared folder. Edges are dealt out once, by the end whose label is
    read, and labels by node, so that a round exchanges only what it finds. Minima are taken in part before
    each exchange, so a node with very many edges receives few rows; but its edges lie in one partition, that of the node.
    """
    n = parts(edges.sparkSession)
    pairs = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = cut(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition(n, "a"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")).repartition(n, "node"))
    while True:
        near = both.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label")
        spread = near.unionAll(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = spread.join(labels.select(F.col("node").alias("_n"), F.col("label").alias("_l")), F.col("label") == F.col("_n"))
        jump = jump.select("node", F.least("label", "_l").alias("label")).repartition(n, "node")
        told = cut(jump.join(labels.withColumnRenamed("label", "was"), "node").select("node", "label", (F.col("label") != F.col("was")).alias("changed")))
        labels = told.select("node", "label")
        if not told.where("changed").limit(1).count():
            return labels
