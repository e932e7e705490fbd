"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of a link with the least node that it reaches.

    Each round hangs the neighbours of a node on the least of them, first the larger ones, then the smaller.
    Links are never gathered: a node's least neighbour is an aggregate, joined back. Rounds grow with the
    logarithm of the longest path; each round's links are written to the shared folder, so a lost executor
    costs one round. The end is seen from the links themselves (``_is_settled``), not from a further round that changes
    nothing. Links with a null end are ignored.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # a link gives one row at most here, so repeats wait for the smaller star
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = materialise(small, "small-star")
        if _is_settled(edges):
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _is_settled(edges: DataFrame) -> bool:
    """Whether the distinct ``edges`` (u, v), u the greater, are stars: every node hangs on one node at most, and none on a node that hangs.

    Rounds keep what is connected, so each star is a component then, and its centre the least node.
    """
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()
