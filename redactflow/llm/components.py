"""Connected components of an edge table by alternating large and small stars.

Each round joins every node to the smallest node around it and keeps the edges
as a table; the number of rounds grows with the logarithm of the number of
nodes.  A node with very many edges is met by a partial aggregation (its
smallest neighbour) and by a join of two shuffled tables, which adaptive
execution splits; nothing of the graph reaches the driver but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b).  Large: each larger neighbour goes to the least node around; small: each smaller one and the node itself."""
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = stage(around.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")), "least")
    moved = around.join(least, "a")
    if large:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.select(F.explode(F.array(F.struct(F.col("b").alias("x")), F.struct(F.col("a").alias("x")))).alias("x"), "least").select(F.col("x.x").alias("a"), F.col("least").alias("b"))
    return stage(moved.where(F.col("a") > F.col("b")).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node that has an edge (a, b), a != b."""
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
    before = None
    while (now := print_of(edges)) != before:
        before = now
        edges = _star(_star(edges, large=True), large=False)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
