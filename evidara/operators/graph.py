"""Connected components of rows that share a value, for grouping that must stay whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.operators.checks import kept


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the least node that edges (a, b) reach; self-loops keep lone nodes.

    Labels spread to neighbours and then jump to the label's own label, so the
    rounds grow with the logarithm of a path.  Each round is a reliable
    checkpoint; a neighbourhood is only ever reduced to its minimum.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = kept(spread.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
        changed = not new.join(labels.withColumnRenamed("component", "old"), "node").filter("component <> old").isEmpty()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def shared_value_components(rows: DataFrame, identifier: str, *values: str) -> DataFrame:
    """Components of rows where any of ``values`` is shared: each row is tied to the least row with its value."""
    ties = rows.select(F.col(identifier).alias("a"), F.col(identifier).alias("b"))
    for value in values:
        least = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(identifier).alias("b"))
        ties = ties.union(rows.join(least, value).select(F.col(identifier).alias("a"), "b"))
    return components(ties)
