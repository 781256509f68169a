"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _least(edges: DataFrame) -> DataFrame:
    """(src, dst, least): each edge with the smallest of src and all its neighbours; hot nodes combine before the shuffle."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("least"))
    return edges.join(least, "src")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of `edges` (src long, dst long); root is the smallest node it reaches.

    Each round links every node to the smallest neighbour (large star over greater neighbours, small star over lesser
    ones), which at least halves the depth of chains; it ends when all edges are stars. Self-loops and nulls are dropped.
    """
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src is not null and dst is not null and src != dst").distinct()
    edges = stored(edges, "edges")
    was = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = _least(both).filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).filter("src != dst").distinct()
        small = _least(large)
        small = small.select(F.col("dst").alias("src"), F.col("least").alias("dst")).union(small.select("src", F.col("least").alias("dst")))
        edges = stored(small.filter("src != dst").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.count_distinct("src"), F.sum(F.hash("src", "dst").cast("long"))).first()
        if now[0] == now[1] and now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
