"""Connected components by alternating large-star and small-star steps.

Each step keeps the components and makes every tree flatter, so a few rounds
suffice.  The edges (larger, smaller) stay distributed, each round ends in a
reliable checkpoint, and a node's neighbours are only ever reduced to their
minimum, with partial aggregation.  A hub's edges meet its minimum in a
broadcast join, or beyond the bound in a join whose parts Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.runtime import discard, restarted, small

#: Nodes whose least neighbours may be broadcast; with more they meet the edges in a shuffle.
MOST_BROADCAST_NODES = 1 << 18


def _least(edges: DataFrame) -> tuple[DataFrame, str]:
    """(a, m): the least neighbour of every node ``a`` that has a smaller one; and where it stands.

    It is written out, so that beyond the broadcast bound the join with the
    edges stands on two plain shuffles, of which Spark can split a hub's part.
    """
    return restarted(edges.groupBy("a").agg(F.min("b").alias("m")))


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Every larger neighbour of a node is tied to the node's least neighbour.

    In an edge (a, b) with a > b only a is a larger neighbour (of b); b without
    a smaller neighbour is its own least.
    """
    least, at = _least(edges)
    known = small(least, MOST_BROADCAST_NODES).select(F.col("a").alias("b"), "m")
    out = restarted(edges.join(known, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
    discard(edges.sparkSession, at)
    return out


def _small_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """A node and its smaller neighbours are tied to the least of them."""
    least, at = _least(edges)
    tied = edges.join(small(least, MOST_BROADCAST_NODES), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    out = restarted(tied.union(least.select("a", F.col("m").alias("b"))).distinct())
    discard(edges.sparkSession, at)
    return out


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node.

    Loops and edges with a null end say nothing and are left out; repeated edges
    count once; no edges give no rows.  ``most_rounds`` only guards against
    a defect: the steps converge in a number of rounds that grows as log squared.
    """
    spark = edges.sparkSession
    now, at = restarted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    said = None
    for _ in range(most_rounds):
        wide, between = _large_star(now)
        discard(spark, at)
        now, at = _small_star(wide)
        discard(spark, between)
        sums = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(sums) == said:
            break
        said = tuple(sums)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
