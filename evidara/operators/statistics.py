"""Classification, correlation, agreement and distribution statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.functions.numeric import round_to
from evidara.operators.ranks import placed, with_medians

LABELS = ("entailment", "neutral", "contradiction")


def _one_row(spark, values: tuple[str, ...], name: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"{name}_order", name))


def confusion(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(gold, predicted, n) over the whole label grid; pairs outside it are left out."""
    spark = df.sparkSession
    grid = _one_row(spark, labels, "gold").crossJoin(_one_row(spark, labels, "predicted"))  # labels squared
    counts = df.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Per label: support, precision, recall, f1 (0 where undefined), and on every row accuracy and macro_f1.

    ``df`` is (gold, predicted).  A prediction outside the labels (an abstention)
    counts against recall only.
    """
    counts = df.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    gold = counts.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    told = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("told"))
    base = _one_row(df.sparkSession, labels, "label").join(gold, "label", "left").join(told, "label", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    tp = zero(F.col("tp"))
    precision = zero(F.try_divide(tp, zero(F.col("told")))).cast("double")
    recall = zero(F.try_divide(tp, zero(F.col("support")))).cast("double")
    scored = base.select("label", zero(F.col("support")).alias("support"), tp.alias("tp"), precision.alias("precision"), recall.alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    every = W.partitionBy()
    return scored.withColumn("f1", f1).select(
        "label", "support", round_to(F.col("precision")).alias("precision"), round_to(F.col("recall")).alias("recall"), round_to(F.col("f1")).alias("f1"),
        round_to(F.coalesce(F.try_divide(F.sum("tp").over(every), F.sum("support").over(every)), F.lit(0.0)).cast("double")).alias("accuracy"), round_to(F.avg("f1").over(every)).alias("macro_f1"),
    )


def label_prior(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row: the majority gold label (ties by label order) as a constant predictor, with its accuracy and macro F1."""
    order = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("gold"))
    counts = df.groupBy("gold").agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max_by("gold", F.struct("n", (-order).alias("o"))).alias("majority"), F.max("n").alias("correct"), F.sum("n").alias("total"))
    accuracy = F.col("correct") / F.col("total")
    return row.select("majority", "correct", "total", round_to(accuracy).alias("accuracy"), round_to(2 * accuracy / (1 + accuracy) / len(labels)).alias("macro_f1"))


def distribution(df: DataFrame, column: str, *by: str) -> DataFrame:
    """count, min, median, mean and max of a column; nulls do not count, an empty group has null statistics."""
    x = F.col(column).cast("double")
    sums = df.groupBy(*by).agg(F.count(x).alias("n"), round_to(F.min(x)).alias("minimum"), round_to(F.avg(x)).alias("mean"), round_to(F.max(x)).alias("maximum"))
    found = with_medians(sums, df.select(*by, x.alias("median")), ["median"], *by)
    return found.select(*by, "n", "minimum", round_to(F.col("median")).alias("median"), "mean", "maximum")


def grouped_distributions(df: DataFrame, dimensions: list[str], features: list[str]) -> DataFrame:
    """Distributions of every feature for every value of every dimension, in one shuffle."""
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("d")
    feats = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f")
    long = df.select("*", dims).select("d", feats).select("d.dimension", "d.value", "f.feature", "f.x").filter("value IS NOT NULL")
    return distribution(long, "x", "dimension", "value", "feature")


def mid_rank(column: str, *by: str) -> Column:
    """1-based average rank among ties."""
    group = W.partitionBy(*by)
    ties = W.partitionBy(*by, column)
    return F.rank().over(group.orderBy(column)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def pearson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Correlation of two columns; null with fewer than two pairs or without variance."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.filter(a.isNotNull() & b.isNotNull())
    moments = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("sx"), F.stddev_pop(b).alias("sy"))
    value = F.when((F.col("n") > 1) & (F.col("sx") > 0) & (F.col("sy") > 0), F.try_divide(F.col("c"), F.col("sx") * F.col("sy")))
    return moments.select(*by, "n", round_to(value).alias("correlation"))


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Correlation of average ranks."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = both.select(*by, mid_rank(x, *by).alias("rx"), mid_rank(y, *by).alias("ry"))
    return pearson(ranked, "rx", "ry", *by)


def binary_separation(df: DataFrame, *by: str) -> DataFrame:
    """ROC-AUC by mid-ranks, average precision by (score descending, position), and prevalence.

    ``df`` is (positive boolean, score, position) and the columns ``by``.  AUC is
    null without both classes, average precision without positives.  Rows are
    first summed by score, and only those sums are ranked; within a score each row's place comes from its position.
    """
    hit = F.col("positive").cast("int")
    ties = df.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("tied"), F.sum(hit).alias("tied_hits"))
    above = W.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    placed = ties.select(*by, "score", "tied", "tied_hits", F.coalesce(F.sum("tied").over(above), F.lit(0)).alias("before"), F.coalesce(F.sum("tied_hits").over(above), F.lit(0)).alias("hits_before"))
    within = W.partitionBy(*by, "score").orderBy("position")
    inner = df.select(*by, "score", "positive", F.row_number().over(within).alias("i"), F.sum(hit).over(within.rowsBetween(W.unboundedPreceding, 0)).alias("h"))
    same = F.lit(True)
    for c in (*by, "score"):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    ranked = inner.alias("r").join(placed.alias("t"), same).select(*[f"r.{c}" for c in by], "positive", "before", "tied", (F.col("before") + F.col("i")).alias("at"), (F.col("hits_before") + F.col("h")).alias("hits"))
    # The mid-rank from below is n - before - (tied - 1) / 2.
    sums = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("positives"), F.sum(F.when(F.col("positive"), F.col("before") + (F.col("tied") - 1) / 2.0)).alias("from_top"),
        F.sum(F.when(F.col("positive"), F.col("hits") / F.col("at"))).alias("precisions"),
    ).withColumn("ranks", F.col("positives") * F.col("n") - F.col("from_top"))
    p, n = F.col("positives"), F.col("n")
    auc = F.try_divide(F.col("ranks") - p * (p + 1) / 2.0, (p * (n - p)).cast("double"))
    return sums.select(*by, "n", "positives", round_to(auc).alias("roc_auc"), round_to(F.try_divide(F.col("precisions"), p.cast("double"))).alias("average_precision"), round_to(F.try_divide(p.cast("double"), n)).alias("prevalence"))


def graph_decision(separation: DataFrame) -> DataFrame:
    """'graph-next' iff AUC >= 0.65 and average precision >= 2 * prevalence, else 'stop'."""
    go = (F.col("roc_auc") >= 0.65) & (F.col("average_precision") >= 2 * F.col("prevalence"))
    return separation.withColumn("decision", F.when(F.coalesce(go, F.lit(False)), "graph-next").otherwise("stop"))


def agreement(df: DataFrame, positive: str, negative: str, uncertain: str = "uncertain") -> DataFrame:
    """One row on two reviewers' labels (a, b).

    Exact agreement is over pairs that both have a label, and uncertain never
    agrees; resolved pairs are those of the two decisive labels.  Undefined
    ratios are null.
    """
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()
    decisive = a.isin(positive, negative) & b.isin(positive, negative)
    counts = df.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(both).alias("labelled"), F.count_if(both & (a == b) & (a != uncertain)).alias("exact"), F.count_if(decisive).alias("resolved"),
        F.count_if((a == positive) & (b == positive)).alias("pp"), F.count_if((a == negative) & (b == negative)).alias("nn"), F.count_if(decisive & (a != b)).alias("mixed"),
    )
    ratio = lambda x, y: round_to(F.try_divide(x.cast("double"), y))
    pp, nn, mixed = F.col("pp"), F.col("nn"), F.col("mixed")
    return counts.select(
        "pairs", "labelled", "resolved", ratio(F.col("exact"), F.col("labelled")).alias("exact_agreement"), ratio(pp + nn, F.col("resolved")).alias("resolved_agreement"),
        ratio(2 * pp, 2 * pp + mixed).alias("positive_agreement"), ratio(2 * nn, 2 * nn + mixed).alias("negative_agreement"),
    )


def coverage_gate(counts: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``counts`` has <name>_covered and <name>_total; passed and the names below their least share, sorted."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(F.try_divide(F.col(f"{n}_covered").cast("double"), F.col(f"{n}_total")), F.lit(0.0)) < share, F.lit(n)) for n, share in sorted(limits.items())]))
    return counts.select("*", failed.alias("failed_conditions")).withColumn("passed", F.size("failed_conditions") == 0)


#: Clusters whose sums are one row, and the parts into which the replicates are dealt.
BLOCK_CLUSTERS, REPLICATE_PARTS = 1 << 14, 8
#: Draws that a task holds at once.
DRAWN_AT_ONCE = 1 << 18


def cluster_bootstrap(df: DataFrame, cluster: str, arms: tuple[str, str], replicates: int = 2000, seed: int = 1729) -> DataFrame:
    """Percentile interval of the difference in accuracy of two arms, resampling whole clusters.

    ``df`` has boolean columns named by the arms.  Each replicate draws as many
    clusters as there are, in the order of their names, from PCG64(seed), so
    that it equals a local run.  Blocks of cluster sums meet parts of the
    replicates in tasks of their own; a task replays the stream up to its part
    and adds up the draws that fall into its block.  Nothing but the sums of a
    replicate, of which there are few, comes together.
    """
    sums = cluster_sums(df, cluster, arms)
    rows = placed(sums, [cluster])
    block = F.floor(F.col("place") / BLOCK_CLUSTERS).alias("block")
    listed = F.sort_array(F.collect_list(F.struct("place", "n", "d"))).alias("own")
    blocks = rows.groupBy(block, "placed_of").agg(listed)
    parts = blocks.select("placed_of", "own", F.explode(F.sequence(F.lit(0), F.lit(REPLICATE_PARTS - 1))).alias("part"))

    def drawn(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                clusters, part = row["placed_of"], row["part"]
                first = row["own"][0]["place"]
                n, d = (np.array([x[c] for x in row["own"]], np.int64) for c in "nd")
                begin, end = part * replicates // REPLICATE_PARTS, (part + 1) * replicates // REPLICATE_PARTS
                rng = np.random.Generator(np.random.PCG64(seed))
                out = []
                for replicate in range(end):
                    total, gain, left = 0, 0, clusters
                    while left:
                        own = rng.integers(0, clusters, size=min(left, DRAWN_AT_ONCE))
                        left -= len(own)
                        if replicate >= begin:
                            own = own[(own >= first) & (own < first + len(n))] - first
                            total, gain = total + int(n[own].sum()), gain + int(d[own].sum())
                    if replicate >= begin:
                        out.append((replicate, total, gain))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], ["replicate", "n", "d"])

    each = parts.repartition(REPLICATE_PARTS, "part").mapInArrow(drawn, "replicate long, n long, d long").groupBy("replicate").agg((F.sum("d") / F.sum("n")).alias("delta"))
    interval = each.agg(F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return point_difference(sums).crossJoin(interval).select(  # a row each
        "clusters", F.lit(replicates).alias("replicates"), "delta", round_to(F.col("q")[0]).alias("low"), round_to(F.col("q")[1]).alias("high")
    )


def cluster_sums(df: DataFrame, cluster: str, arms: tuple[str, str]) -> DataFrame:
    """Rows of each cluster and by how many the first arm is right more often."""
    a, b = arms
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(a).cast("int") - F.col(b).cast("int")).alias("d"))


def point_difference(sums: DataFrame) -> DataFrame:
    """One row: clusters and the difference in accuracy over all rows; null without rows."""
    return sums.agg(F.count(F.lit(1)).cast("int").alias("clusters"), round_to(F.try_divide(F.sum("d").cast("double"), F.sum("n"))).alias("delta"))
