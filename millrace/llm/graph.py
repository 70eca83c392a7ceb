"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of links (a, b) reaches.

    Each round every node takes the smallest node of its neighbourhood, and links between different
    takers remain. Only minima are gathered for a node, so a node with any number of links is a
    plain aggregation; rounds grow with the logarithm of a component's diameter. Links with a null
    end are ignored; no links give no rows.
    """
    edges = cut(links.where("a is not null and b is not null and a != b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "least")
        moved = edges.join(least.select("a", F.col("to").alias("x")), "a").join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = cut(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if labels is None:
            labels = least.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            step = least.select(F.col("a").alias("label"), "to")
            labels = cut(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
