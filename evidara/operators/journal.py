"""Append-only journals: what is missing, what is open, what may still run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_runs(planned: DataFrame, recorded: DataFrame, *keys: str) -> DataFrame:
    """Planned keys without a record; a failed record counts as done."""
    return planned.join(recorded.select(*keys).distinct(), list(keys), "left_anti")


def journal_state(events: DataFrame, identifier: str = "candidate_id") -> DataFrame:
    """State of each id from its (id, event) rows, event being 'started' or a terminal one.

    ``completed``; ``outcome-unknown`` for a start without an end, which is never
    sent again; ``invalid`` for doubled events or an end without a start.
    """
    counts = events.groupBy(identifier).agg(F.count_if(F.col("event") == "started").alias("starts"), F.count_if(F.col("event") != "started").alias("ends"))
    state = F.when((F.col("starts") > 1) | (F.col("ends") > 1) | (F.col("starts") == 0), "invalid").when(F.col("ends") == 1, "completed").otherwise("outcome-unknown")
    return counts.withColumn("state", state)


def to_run(planned: DataFrame, states: DataFrame, identifier: str = "candidate_id") -> DataFrame:
    """Planned ids that no event names: at most one attempt each."""
    return planned.join(states.select(identifier), identifier, "left_anti")


def budgeted_dispatch(requests: DataFrame, budget: float, *order: str, cost: str = "seconds", failed: str = "failed", group: str = "run_id") -> DataFrame:
    """Which requests of a run are sent: those before the budget is spent and before the first failure.

    The request that crosses the budget is still sent; nothing after it is.
    """
    before = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(before), F.lit(0.0))
    halted = F.coalesce(F.max(F.col(failed).cast("int")).over(before), F.lit(0))
    return requests.withColumn("spent_before", spent).withColumn("dispatched", (F.col("spent_before") < budget) & (halted == 0))


def schedule_mismatches(expected: DataFrame, recorded: DataFrame, *keys: str, at: str = "position") -> DataFrame:
    """Positions at which the recorded order differs from the expected one, absent rows included."""
    a = expected.select(at, *[F.col(k).alias(f"expected_{k}") for k in keys])
    b = recorded.select(at, *[F.col(k).alias(f"recorded_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"expected_{k}").eqNullSafe(F.col(f"recorded_{k}"))
    return a.join(b, at, "full_outer").filter(~same)
