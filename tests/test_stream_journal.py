"""The journal's machine on a stream of files, over restarts, against the batch operator."""

from evidara.operators import journal
from evidara.streaming import machine

SCHEMA = "candidate_id long, event string"


def test_stream_equals_batch_after_restarts_and_tells_overdue_outcomes(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    parts = [
        [(1, "started"), (2, "started"), (3, "result"), (4, "started"), (4, "started")],
        [(1, "result"), (5, "started"), (5, "result")],
        [(5, "result"), (6, "started"), (3, "started")],
    ]
    for at, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = machine.follow(machine.journal_states(stream, patience=1), out, checkpoint)
        assert query.awaitTermination(100)
        so_far = spark.createDataFrame([x for p in parts[: at + 1] for x in p], SCHEMA)
        expected = {tuple(r) for r in journal.journal_state(so_far).select("candidate_id", "starts", "ends", "state").collect()}
        got = machine.latest(spark, out).collect()
        assert {(r.candidate_id, r.starts, r.ends, r.state) for r in got} == expected
    known = {r.candidate_id: (r.state, r.overdue) for r in got}
    assert known[2] == ("outcome-unknown", True) and known[1] == ("completed", False)


def test_ids_share_buckets_and_timers(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    parts = [[*[(i, "started") for i in range(60)], (None, "started"), ((1 << 60) + 1, "started")], [*[(i, "result") for i in range(0, 60, 2)], (None, "result")], [(7, "result")]]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = machine.follow(machine.journal_states(spark.readStream.schema(SCHEMA).parquet(source), patience=1, buckets=3), out, checkpoint)
        assert query.awaitTermination(100)
    got = {r.candidate_id: (r.starts, r.ends, r.state, r.overdue) for r in machine.latest(spark, out).collect()}
    want = {i: (1, 1, "completed", False) if i % 2 == 0 or i == 7 else (1, 0, "outcome-unknown", True) for i in [*range(60), (1 << 60) + 1]}
    assert got == want | {None: (1, 1, "completed", False)}
    told = spark.read.parquet(f"{out}/batch=*").filter("overdue").groupBy("candidate_id").count().collect()
    assert {r["count"] for r in told} == {1}  # once each
