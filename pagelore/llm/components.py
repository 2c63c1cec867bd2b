"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """Rows ``node, component`` for every node of an edge ``a, b`` (longs); the component is its smallest node.

    Contraction: each node is merged into its smallest neighbour, if that is smaller, two
    steps at once; edges are rewritten to the merged nodes and those within one dropped,
    until none is left. A node with neighbours is either merged or has one that is, so
    the nodes at least halve. No group of edges is ever gathered: minima are aggregated,
    and a node with very many edges is an ordinary skewed join, which adaptive execution
    splits. Each round is written, so lineage stays short.
    """
    edges = stored(_distinct(edges.select("a", "b")), "edges")
    placed = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    placed = stored(placed.withColumn("component", F.col("node")), "placed")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = stored(
            both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")), "least"
        )
        twice = least.select(F.col("a").alias("to"), F.col("to").alias("next"))
        step = stored(least.join(twice, "to").select(F.col("a").alias("old"), F.col("next").alias("new")), "step")
        moved = edges
        for end in ("a", "b"):
            moved = moved.withColumnRenamed(end, "old").join(step, "old").drop("old").withColumnRenamed("new", end)
        edges = stored(_distinct(moved), "edges")
        placed = stored(
            placed.join(step.withColumnRenamed("old", "component"), "component", "left").select(
                "node", F.coalesce("new", "component").alias("component")
            ),
            "placed",
        )
    return placed


def _distinct(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
