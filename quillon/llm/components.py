"""Connected components by contraction, kept in tables from first to last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between labels (node, label); a node without one keeps its own."""
    for side in ("a", "b"):
        to = labels.select(F.col("node").alias(side), F.col("label").alias("to"))
        edges = edges.join(to, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    return edges.filter("a <> b").select("a", "b").distinct()


def merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, label) after joining what ``edges`` (a, b) link; a label is the least node of its component.

    Each round points every label to its least neighbour, follows pointers three times, and goes on with the
    edges between different roots. Roots at least halve in number, so rounds grow with the logarithm of the
    longest path; a star takes one round. Nothing but "any edges left?" reaches the driver.
    """
    edges = cut(_relabel(edges, labels))
    total = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
        for _ in range(3):
            up = to.select(F.col("node").alias("label"), F.col("label").alias("up"))
            to = to.join(up, "label").select("node", F.col("up").alias("label"))
        to = cut(to)
        if total is None:
            total = to
        else:
            up = to.select(F.col("node").alias("label"), F.col("label").alias("up"))
            total = total.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        edges = cut(_relabel(edges, to))
    if total is None:
        return labels
    up = total.select(F.col("node").alias("label"), F.col("label").alias("up"))
    old = labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return cut(old.union(total.join(labels.select("node"), "node", "left_anti")))
