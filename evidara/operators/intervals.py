"""Half-open intervals: union, coverage, gaps, and best pairs of windows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.functions.numeric import round_to

#: Rows of windows that a task of ``best_pair`` sorts, about: with more rows there are more tasks, not larger ones.
ROWS_A_TASK = 400_000


def union_intervals(df: DataFrame, *by: str) -> DataFrame:
    """Merged intervals (start, end) of each group; touching ones merge, empty ones say nothing."""
    own = W.partitionBy(*by).orderBy("start", "end")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    reach = df.filter("start < end").withColumn("reach", F.max("end").over(before))
    island = F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(own.rowsBetween(W.unboundedPreceding, 0))
    return reach.withColumn("island", island).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def span_coverage(selected: DataFrame, reference: DataFrame, *by: str) -> DataFrame:
    """Characters of both sides and shared, precision and recall, per group of either side.

    Both sides are merged first, so no character counts twice; the overlap join
    has the group as its equi key.
    """
    a = union_intervals(selected, *by)
    b = union_intervals(reference, *by).withColumnsRenamed({"start": "s2", "end": "e2"})
    met = a.join(b, list(by)).filter("start < e2 AND s2 < end")
    shared = met.groupBy(*by).agg(F.sum(F.least("end", "e2") - F.greatest("start", "s2")).alias("shared"))
    size = lambda df, x, y, name: df.groupBy(*by).agg(F.sum(F.col(y) - F.col(x)).alias(name))
    full = size(a, "start", "end", "selected").join(size(b, "s2", "e2", "reference"), list(by), "full_outer").join(shared, list(by), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda c: round_to(F.coalesce(F.try_divide(zero("shared").cast("double"), zero(c)), F.lit(0.0)))
    return full.select(*by, zero("selected").alias("selected"), zero("reference").alias("reference"), zero("shared").alias("shared"), ratio("selected").alias("precision"), ratio("reference").alias("recall"))


def contiguous_ranges(df: DataFrame, ordinal: str, *by: str) -> DataFrame:
    """Runs of consecutive ordinals as (first, last), inclusive."""
    own = W.partitionBy(*by).orderBy(ordinal)
    runs = df.select(*by, ordinal).distinct().withColumn("run", F.col(ordinal) - F.row_number().over(own))
    return runs.groupBy(*by, "run").agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last")).drop("run")


def omitted_ranges(every: DataFrame, admitted: DataFrame, *by: str) -> DataFrame:
    """Ranges of ordinals that were not admitted."""
    return contiguous_ranges(every.join(admitted, [*by, "ordinal"], "left_anti"), "ordinal", *by)


def invalid_windows(windows: DataFrame, *by: str) -> DataFrame:
    """Windows out of bounds (0 <= start < end <= length) or overlapping the one before."""
    own = W.partitionBy(*by).orderBy("start", "end")
    seen = windows.withColumn("reach", F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1)))
    return seen.filter("start < 0 OR end <= start OR end > length OR start < reach").drop("reach")


def best_pair(windows: DataFrame, reference: DataFrame, *by: str) -> DataFrame:
    """The two windows (one, if there is one) that cover most of the reference, per group.

    Windows do not overlap each other, so a pair covers the sum of both; a window given twice is one.
    Ties go to the smaller starts.  The pair that covers most consists of the two best windows, so no
    pairs are formed.  Both sides are dealt by group once, to as many tasks as their rows ask for.
    """
    parts = max(1, ceil(max(windows.count(), reference.count()) / ROWS_A_TASK))
    dealt = lambda df: df.select(*by, "start", "end").repartition(parts, *by).distinct()
    merged = union_intervals(dealt(reference), *by).withColumnsRenamed({"start": "s2", "end": "e2"})
    met = dealt(windows).join(merged, list(by), "left")
    part = F.greatest(F.lit(0), F.least("end", "e2") - F.greatest("start", "s2"))
    covered = met.groupBy(*by, "start", "end").agg(F.sum(F.coalesce(part, F.lit(0))).alias("covered"))
    own = W.partitionBy(*by).orderBy(F.desc("covered"), "start", "end")
    two = covered.withColumn("at", F.row_number().over(own)).filter("at <= 2")
    return two.groupBy(*by).agg(F.sort_array(F.collect_list("start")).alias("starts"), F.sum("covered").alias("covered"))
