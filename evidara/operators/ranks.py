"""Positions, running sums and medians over groups of any size, without a window over a whole group.

Rows are dealt by ranges of (group, order), so a group may lie in any number of
tasks; each task counts its own rows, and what the parts before hold of a group
is added.  The sorted rows are kept, so that both steps see the same parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.operators.checks import broadcast_if_small, kept


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Equality of keys on both sides of a join, nulls included."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return same


def placed(df: DataFrame, order: list[str], *by: str, weight: str | None = None) -> DataFrame:
    """Adds ``place``, how many rows of the group come before, and ``placed_of``, how many it has.

    With ``weight`` both are sums of that column instead of counts.  Rows equal
    in ``order`` come in any order.
    """
    groups, columns = list(by), df.columns
    key = [*groups, *order]
    marks = df.repartitionByRange(*key).sortWithinPartitions(*key)
    held = kept(marks.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    parts = held.groupBy(*groups, "__part").agg(F.min("__at").alias("first"), size.alias("n"))
    # As many entries as the group has parts.
    listed = parts.groupBy(*groups).agg(F.sum("n").alias("placed_of"), F.sort_array(F.collect_list(F.struct("__part", "first", "n"))).alias("p"))
    spread = listed.select(*groups, "placed_of", "p", F.posexplode("p").alias("i", "own"))
    before = F.aggregate(F.slice("p", 1, F.col("i")), F.lit(0).cast(dict(parts.dtypes)["n"]), lambda a, x: a + x["n"])
    offsets = spread.select(*groups, F.col("own.__part").alias("__part"), F.col("own.first").alias("first"), before.alias("before"), "placed_of")
    offsets = broadcast_if_small(kept(offsets))
    joined = held.alias("a").join(offsets.alias("b"), _same("a", "b", [*groups, "__part"]))
    if weight is None:
        inside = F.col("a.__at") - F.col("b.first")
    else:
        own = W.partitionBy(*[f"a.{g}" for g in groups], "a.__part").orderBy("a.__at").rowsBetween(W.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(f"a.{weight}").over(own), F.lit(0))
    return joined.select(*[f"a.`{c}`" for c in columns], (inside + F.col("b.before")).alias("place"), F.col("b.placed_of").alias("placed_of"))


def medians(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """``by`` and the exact median of each column, null where a group has no value.

    Equal values are counted first; then the one or two counts that hold the
    middle are found by running sums, however few groups there are.
    """
    groups = list(by)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns]))
    long = df.select(*groups, each.alias("e")).select(*groups, "e.name", "e.x")
    counts = long.filter("x IS NOT NULL").groupBy(*groups, "name", "x").agg(F.count(F.lit(1)).alias("n"))
    run = placed(counts, ["x"], *groups, "name", weight="n")
    holds = lambda at: (F.col("place") <= at) & (at < F.col("place") + F.col("n"))
    low, high = F.floor((F.col("placed_of") - 1) / 2), F.floor(F.col("placed_of") / 2)
    middle = run.filter(holds(low) | holds(high)).groupBy(*groups, "name").agg((F.max(F.when(holds(low), F.col("x"))) + F.max(F.when(holds(high), F.col("x")))).alias("twice"))
    wide = [F.max(F.when(F.col("name") == c, F.col("twice") / 2)).alias(c) for c in columns]
    return middle.groupBy(*groups).agg(*wide)


def with_medians(sums: DataFrame, df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Group rows with the medians of columns of ``df`` as columns of the same names."""
    if not by:
        return sums.crossJoin(medians(df, columns))  # a row each
    found = medians(df, columns, *by)
    return sums.alias("s").join(found.alias("m"), _same("s", "m", list(by)), "left").select("s.*", *[f"m.`{c}`" for c in columns])
