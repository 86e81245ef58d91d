"""best_pair deals its rows to as many tasks as they ask for."""

from evidara.operators import intervals


def test_more_rows_make_more_tasks_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(intervals, "ROWS_A_TASK", 10)
    windows = [(k, s, s + 40) for k in range(20) for s in (50, 100, 150, 100)]  # one of them twice
    windows = spark.createDataFrame(windows, "k int, start int, end int")
    reference = spark.createDataFrame([(k, 30, 130 + k) for k in range(20)] * 2, "k int, start int, end int")
    found = intervals.best_pair(windows, reference, "k")
    assert {r["k"]: (r["starts"], r["covered"]) for r in found.collect()} == {k: ([50, 100], 70 + min(k, 10)) for k in range(20)}
    plan = found._jdf.queryExecution().toString()
    assert "hashpartitioning(k" in plan and ", 8)" in plan  # 80 rows, 10 a task
    more = intervals.best_pair(windows.union(windows), reference, "k")
    assert ", 16)" in more._jdf.queryExecution().toString()
