"""The journal's state machine on a stream: one start, one end, and a timer for outcomes that stay unknown."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: No timer.
NEVER = 1 << 62


#: Groups of ids that share a state and a timer; a query that goes on from a checkpoint must keep the number.
BUCKETS = 1 << 12


def journal_states(events: DataFrame, patience: int = 3_600_000, buckets: int = BUCKETS) -> DataFrame:
    """(candidate_id, starts, ends, state, overdue) of a stream of (candidate_id, event), a row for each change.

    The state of an id is how often it started and ended; ids are kept in
    buckets by their hash, so that one call serves many, and rows are read a
    frame at a time.  A start without an end is told again, as ``overdue``, once
    ``patience`` milliseconds of processing time have gone by since its last
    event; it is never sent anew.
    """

    def changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = pickle.loads(state.get[0]) if state.exists else None
        # A null id is one id, as in a batch.
        for frame in () if state.hasTimedOut else frames:
            started = frame["event"] == "started"
            own = pd.DataFrame({"candidate_id": frame["candidate_id"], "starts": started.astype("int64"), "ends": (~started).astype("int64"), "due": now + patience, "new": True})
            both = own if held is None else pd.concat([held, own], ignore_index=True)
            held = both.groupby("candidate_id", as_index=False, dropna=False, sort=False).agg({"starts": "sum", "ends": "sum", "due": "max", "new": "any"})
        if held is None:
            return
        open_ = (held["starts"] == 1) & (held["ends"] == 0)
        late = open_ & ~held["new"] & (held["due"] <= now)
        told = held[held["new"] | late]
        names = np.select([(told["starts"] > 1) | (told["ends"] > 1) | (told["starts"] == 0), told["ends"] == 1], ["invalid", "completed"], "outcome-unknown")
        # Who is told as overdue has no timer any more.
        due = held["due"].where(~late, NEVER)
        state.update((pickle.dumps(held.assign(due=due, new=False)),))
        waiting = due[open_ & (due < NEVER)]
        if len(waiting):
            state.setTimeoutDuration(max(1, int(waiting.min()) - now))
        yield told[["candidate_id", "starts", "ends"]].assign(state=names, overdue=late[told.index])

    kind = dict(events.dtypes)["candidate_id"]
    # Null ids are alone in theirs, as a null makes floats of a frame's whole numbers.
    bucket = F.when(F.col("candidate_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("candidate_id"), F.lit(buckets)))
    grouped = events.select("candidate_id", "event", bucket.alias("bucket")).groupBy("bucket")
    return grouped.applyInPandasWithState(changed, f"candidate_id {kind}, starts long, ends long, state string, overdue boolean", "held binary", "update", GroupStateTimeout.ProcessingTimeTimeout)


#: Batches without rows, which timers of processing time would ask for without end.
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def follow(states: DataFrame, path: str, checkpoint: str):
    """Write every change to a folder, numbered by batch; a batch that runs again replaces its own rows.

    Ends when all available rows are read; timers that have run out by then are
    told with the next rows.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf = states.sparkSession.conf
    before = conf.get(IDLE_BATCHES, "true")
    conf.set(IDLE_BATCHES, "false")  # a query keeps the settings that it started under
    try:
        return states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(IDLE_BATCHES, before)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every id that ``follow`` has written."""
    told = F.max_by(F.struct("starts", "ends", "state", "overdue"), F.struct(F.col("batch"), F.col("overdue").cast("int")))
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("candidate_id").agg(told.alias("t")).select("candidate_id", "t.*")
