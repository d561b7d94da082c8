"""Connected components by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.store import staged


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One pass over edges (u > v). Each node's minimum is a map-side combined aggregate and its
    neighbours are joined back to it, so a node with very many neighbours is never one list."""
    if larger_only:
        near = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
        near = near.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        near = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    least = near.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("n", "least"))
    joined = near.join(least, "n")
    if larger_only:
        out = joined.filter("m > n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.filter("m <> least").select(F.col("m").alias("u"), F.col("least").alias("v"))
        out = moved.unionByName(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns (node, root) for every node of ``edges`` (columns a, b): root is the smallest node reachable.

    Every pass writes its edges to the shared folder; the number of passes grows with the logarithm of
    the longest chain. Edges of a node to itself and repeated edges change nothing; no edges give no rows.
    """
    now = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    while True:
        star = staged(_stars(_stars(now, True), False), "stars")
        # finished once every node hangs on one root and no root hangs on another
        parents = star.groupBy("u").agg(F.count("*").alias("k"))
        several = parents.filter("k > 1").limit(1).count()
        chained = 0 if several else star.join(star.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not several and not chained:
            break
        now = star
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
