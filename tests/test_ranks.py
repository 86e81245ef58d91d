"""Positions, medians and the bootstrap against local computation, over hot groups and few partitions."""

import statistics

import numpy as np
from pyspark.sql import functions as F

from evidara.operators import ranks, sampling
from evidara.operators import statistics as st

SCHEMA = "g string, v double, id long"


def rows(seed, n=4000):
    r = np.random.Generator(np.random.PCG64(seed))
    names = ["hot"] * 6 + ["a", "b", None]
    return [(names[int(r.integers(0, 9))], None if i % 17 == 0 else float(r.integers(0, 60)) / 4, i) for i in range(n)]


def test_places_over_groups_that_span_parts(spark):
    data = rows(1)
    got = ranks.placed(spark.createDataFrame(data, SCHEMA).repartition(6), ["v", "id"], "g").collect()
    for g in ("hot", "a", "b", None):
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert {r.id: r.place for r in got if r.g == g} == {x[2]: i for i, x in enumerate(own)}
        assert {r.placed_of for r in got if r.g == g} == {len(own)}
    whole = ranks.placed(spark.createDataFrame(data, SCHEMA), ["id"]).collect()
    assert [r.place for r in sorted(whole, key=lambda r: r.id)] == list(range(len(data)))


def test_medians_equal_the_exact_ones(spark):
    data = rows(2) + [("one", 3.0, -1), ("none", None, -2)]
    frame = spark.createDataFrame(data, SCHEMA).withColumn("w", F.col("id") % 7)
    found = {r.g: r for r in st.distribution(frame, "v", "g").collect()}
    for g in ("hot", "a", "b", None, "one", "none"):
        own = [x[1] for x in data if x[0] == g and x[1] is not None]
        assert (found[g].n, found[g].median) == (len(own), statistics.median(own) if own else None)
    both = {r.g: (r.v, r.w) for r in ranks.medians(frame, ["v", "w"], "g").collect()}
    assert both["hot"][1] == statistics.median(x[2] % 7 for x in data if x[0] == "hot")
    plan = st.distribution(frame, "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan
    assert ranks.medians(frame, ["v"]).first().v == statistics.median(x[1] for x in data if x[1] is not None)


def test_schedules_and_bands_without_one_task(spark):
    data = rows(3, 500)
    frame = spark.createDataFrame(data, SCHEMA)
    arms = {r.id: r.arms for r in sampling.rotating_arms(frame, "id", ["x", "y", "z"]).collect()}
    assert all(arms[i] == [["x", "y", "z"], ["y", "z", "x"], ["z", "x", "y"]][i % 3] for i in range(500))
    picked = sorted((r["at"], r.id) for r in sampling.preflight(frame.filter("v IS NOT NULL"), "v", "id").collect())
    own = sorted((x[1], x[2]) for x in data if x[1] is not None)
    assert picked == [(1, own[0][1]), ((len(own) - 1) // 2 + 1, own[(len(own) - 1) // 2][1]), (len(own), own[-1][1])]
    bands = {r.id: r.band for r in sampling.banded(frame.filter("v IS NOT NULL"), "v", "id", "g").collect()}
    hot = sorted((x[1], x[2]) for x in data if x[1] is not None and x[0] == "hot")
    assert {i: bands[i] for _, i in hot} == {x[1]: min(5, i * 5 // len(hot) + 1) for i, x in enumerate(hot)}
    assert "Window" not in sampling.rotating_arms(frame, "id", ["x"])._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_replays_the_seeded_stream(spark, monkeypatch):
    r = np.random.Generator(np.random.PCG64(5))
    data = [(int(r.integers(0, 37)), bool(r.integers(0, 2)), bool(r.integers(0, 3))) for _ in range(600)]
    frame = spark.createDataFrame(data, "c long, a boolean, b boolean")
    names = sorted({x[0] for x in data})
    n = np.array([sum(x[0] == c for x in data) for c in names], float)
    d = np.array([sum(x[1] - x[2] for x in data if x[0] == c) for c in names], float)
    rng = np.random.Generator(np.random.PCG64(1729))
    deltas = []
    for _ in range(300):
        drawn = rng.integers(0, len(names), size=len(names))
        deltas.append(d[drawn].sum() / n[drawn].sum())
    low, high = np.quantile(deltas, [0.025, 0.975])
    expected = (len(names), 300, round(d.sum() / n.sum(), 6), round(low, 6), round(high, 6))
    assert tuple(st.cluster_bootstrap(frame, "c", ("a", "b"), 300).first()) == expected
    monkeypatch.setattr(st, "BLOCK_CLUSTERS", 10)
    monkeypatch.setattr(st, "DRAWN_AT_ONCE", 7)
    monkeypatch.setattr(st, "REPLICATE_PARTS", 3)
    assert tuple(st.cluster_bootstrap(frame, "c", ("a", "b"), 300).first()) == expected
    assert tuple(st.cluster_bootstrap(frame.limit(0), "c", ("a", "b"), 300).first()) == (0, 300, None, None, None)
