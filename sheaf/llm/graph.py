"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b, both long): one root per component.

    Every node moves to its smallest neighbour, edges are drawn between the places
    moved to, and what is left is done again; at the end the moves are followed
    back. Nodes should be hashes: their order is then random and the edges shrink
    by a factor each round. Each round writes its tables; the driver sees counts.
    """
    moves: list[DataFrame] = []
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        smallest = both.groupBy("node").agg(F.min("other").alias("_other"))
        moved = stored(smallest.select("node", F.least("node", "_other").alias("root")))
        moves.append(moved)
        left = moved.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
        right = moved.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
        drawn = edges.join(left, "a").join(right, "b").where("_ra <> _rb")
        edges = stored(drawn.select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1]
    for moved in reversed(moves[:-1]):
        onward = roots.select(F.col("node").alias("_place"), F.col("root").alias("_end"))
        roots = moved.join(onward, moved["root"] == onward["_place"], "left").select(
            "node", F.coalesce("_end", "root").alias("root")
        )
    return stored(roots)
