"""Connected components by contraction, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b): nodes have one root if, and only if, edges connect them.

    In a round every node points to the smallest of itself and its neighbours, then to where that one points,
    and the edges are drawn anew between the roots. Each node that has an edge and is not the smallest
    around it goes away, so a component's nodes at least halve: log2(nodes) rounds at most.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    found = None
    while edges.head(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        near = stored(near, f"{name}-near")
        above = near.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        step = stored(near.join(above, "up").select("node", F.col("upper").alias("root")), f"{name}-step")
        if found is None:
            found = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = stored(found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{name}-found")
        one = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(one, "a").join(two, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = stored(edges, f"{name}-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
