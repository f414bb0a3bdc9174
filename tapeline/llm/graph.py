"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.storage import staged


def _stars(pairs: DataFrame, keep_up: bool) -> DataFrame:
    """Each node's neighbours move to its smallest neighbour; ``pairs`` has u, v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    if keep_up:
        # written before it is joined: a join of two plain inputs can be split where a node has very many neighbours
        moved = pairs.join(staged(least, "least"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every component is a star: no node has two smaller neighbours, or both a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down + up > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node.

    ``links`` has long columns ``a`` and ``b`` in any order, repeats and loops allowed. Returns
    ``node, component`` for every node of a link between two different nodes, the smallest
    itself included. Every round is written to the shared folder; the driver gets nothing but
    whether another one is needed.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = staged(edges, "links")
    while not _done(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, keep_up=True)
        edges = staged(_stars(large, keep_up=False), "stars")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
