"""Small goldens of the retrieval operators."""

import math

import pytest
from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.operators import chunking, context, dense, fusion, graph, intervals, journal, lexical, metrics, statistics
from evidara.operators.checks import ContractError, require_unique
from evidara.operators.review import manifest_violations
from evidara.plans.engine import Engine
from evidara.plans.strategies import CATALOGUE, DEFAULT, available
from evidara.sources import readers, sinks


def test_metrics_at_two(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 1), ("q2", "d3", 1)], "query_id string, doc_id string, grade int")
    ranking = spark.createDataFrame([("q1", "d1", 1), ("q1", "x", 2), ("q2", "x", 1), ("q2", "d3", 2)], "query_id string, doc_id string, rank int")
    row = metrics.ranking_metrics(qrels, ranking, 2).first()
    third = 1 / math.log2(3)
    assert (row["map"], row["recall"], row["precision"], row["mrr"]) == (0.5, 0.75, 0.5, 0.75)
    assert row["ndcg"] == pytest.approx((1 / (1 + third) + third) / 2, abs=1e-6)


def test_metrics_count_queries_without_relevant_or_ranked(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d1", 0), ("q3", "d9", 2)], "query_id string, doc_id string, grade int")
    ranking = spark.createDataFrame([("q1", "d1", 1), ("q2", "d1", 1)], "query_id string, doc_id string, rank int")
    row = metrics.ranking_metrics(qrels, ranking, 1).first()
    assert row["queries"] == 3 and row["ndcg"] == pytest.approx(1 / 3, abs=1e-6)


def _lists(spark, *named):
    rows = [("q", d, i, r, str(i), 0.0) for i, docs in enumerate(named) for r, d in enumerate(docs, 1)]
    return spark.createDataFrame(rows, "query_id string, doc_id string, list int, rank int, channel string, score double")


def test_reciprocal_rank_fusion(spark):
    got = fusion.reciprocal_rank_fusion(_lists(spark, ["dense", "shared"], ["shared", "keyword"]), 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["shared", "dense", "keyword"]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)


def test_union_and_rerank_ties_by_id(spark):
    pool = fusion.union_of_lists(_lists(spark, ["shared", "bm25"], ["dense", "shared"]))
    scores = spark.createDataFrame([("q", "shared", 0.1), ("q", "bm25", 0.8), ("q", "dense", 0.8)], "query_id string, doc_id string, score double")
    assert [r["doc_id"] for r in fusion.rerank(pool, scores, 3).orderBy("rank").collect()] == ["bm25", "dense", "shared"]
    with pytest.raises(Exception, match="finite"):
        fusion.rerank(pool, scores.filter("doc_id <> 'bm25'"), 3).collect()


def test_robust_normaliser(spark):
    rows = [("q", f"d{i}", c, float(v)) for c, vs in {"a": [0, 1, 2, 3], "b": [0, 0, 0, 10], "c": [7, 7, 7, 7]}.items() for i, v in enumerate(vs)]
    got = fusion.robust_normalised(spark.createDataFrame(rows, "query_id string, doc_id string, channel string, score double"))
    by = {(r["channel"], r["doc_id"]): r["normalised"] for r in got.collect()}
    assert by["a", "d0"] + by["a", "d3"] == pytest.approx(1) and by["a", "d1"] + by["a", "d2"] == pytest.approx(1)
    assert [by["b", f"d{i}"] for i in range(4)] == pytest.approx([1 / 3, 1 / 3, 1 / 3, 1], abs=1e-6)
    assert {by["c", f"d{i}"] for i in range(4)} == {0.5}


def test_incomplete_features_fail(spark):
    pool = fusion.pool(_lists(spark, ["a", "b"]))
    scores = spark.createDataFrame([("q", "a", "x", 1.0)], "query_id string, doc_id string, channel string, score double")
    with pytest.raises(ContractError):
        fusion.feature_matrix(pool, scores, ["x"])


def test_equal_mean(spark):
    rows = [("q", "first", "a", 0.9), ("q", "first", "b", 0.1), ("q", "second", "a", 0.6), ("q", "second", "b", 0.6)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, channel string, score double")
    got = fusion.equal_mean(fusion.identity_normalised(df), 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [("second", 0.6), ("first", 0.5)]


def test_sentence_packs_and_rewriting():
    text = "Alpha beta. Gamma delta. Epsilon zeta."
    assert chunking.greedy_pack(text, chunking.spans_of(text), None, 4, 6) == ["Alpha beta. Gamma delta.", "Epsilon zeta."]
    text = "Aspirin works today. It helps greatly."
    clusters = [[chunking.Mention(0, 7, "Aspirin", ("PROPN",)), chunking.Mention(21, 23, "It", ("PRON",))]]
    assert len(chunking.greedy_pack(text, chunking.spans_of(text), None, 4, 6)) == 2
    assert chunking.greedy_pack(text, chunking.spans_of(text), clusters, 4, 6) == ["Aspirin works today. Aspirin helps greatly."]
    text = "Aspirin was tested. Its effect was measured."
    clusters = [[chunking.Mention(0, 7, "Aspirin", ("PROPN",)), chunking.Mention(20, 23, "Its", ("PRON",), True)]]
    assert "Aspirin's effect" in chunking.resolve(text, clusters)


def test_interval_packing_keeps_chains():
    text = "One two three four five six seven. Aspirin was tried. It worked well."
    spans = chunking.spans_of(text)
    it = text.index("It ")
    clusters = [[chunking.Mention(35, 42, "Aspirin", ("PROPN",)), chunking.Mention(it, it + 2, "It", ("PRON",))]]
    groups = chunking.interval_groups(chunking.Rewriter(text, spans, clusters), 10, 12)
    assert groups == [(0, 1), (1, 3)]
    assert chunking.contiguous_windows("a b c d e", 2) == [(0, 4), (4, 8), (8, 9)]


def test_intervals(spark):
    a = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 10, 12), ("k", 11, 11)], "k string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in intervals.union_intervals(a, "k").collect()) == [(0, 7), (10, 12)]
    b = spark.createDataFrame([("k", 4, 11)], "k string, start int, end int")
    row = intervals.span_coverage(a, b, "k").first()
    assert (row["selected"], row["reference"], row["shared"]) == (9, 7, 4)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 9), (7, 8)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 7: 7, 8: 7}


def test_budgeted_admission_goes_on_after_a_reject(spark):
    rows = [("c", 0, 0.9, 50), ("c", 1, 0.8, 80), ("c", 2, 0.7, 40)]
    got = context.admit_within_budget(spark.createDataFrame(rows, "candidate_id string, ordinal int, score double, tokens int"), 100)
    assert {r["ordinal"]: r["admitted"] for r in got.collect()} == {0: True, 1: False, 2: True}


def test_citation_gate(spark):
    rows = [("yes [a]", ["a"]), ("no [b]", ["a"]), ("INSUFFICIENT evidence", ["a"]), ("none", ["a"])]
    got = context.gate_answers(spark.createDataFrame(rows, "answer string, allowed array<string>")).collect()
    assert [(r["final"], r["valid"]) for r in got] == [("yes [a]", True), ("insufficient evidence", False), ("insufficient evidence", True), ("insufficient evidence", False)]


def test_agreement_and_correlation_undefined_are_null(spark):
    row = statistics.agreement(spark.createDataFrame([("uncertain", "uncertain"), (None, "yes")], "a string, b string"), "yes", "no").first()
    assert row["exact_agreement"] == 0 and row["positive_agreement"] is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert statistics.pearson(flat, "x", "y").first()["correlation"] is None


def test_journal_states(spark):
    rows = [("a", "started"), ("a", "result"), ("b", "started"), ("c", "result"), ("d", "started"), ("d", "started")]
    got = {r["candidate_id"]: r["state"] for r in journal.journal_state(spark.createDataFrame(rows, "candidate_id string, event string")).collect()}
    assert got == {"a": "completed", "b": "outcome-unknown", "c": "invalid", "d": "invalid"}


def test_text_functions(spark):
    df = spark.createDataFrame([("VERDICT: SUPPORTED\nbecause [d1] and [d1] [d2]",)], "t string")
    row = df.select(T.verdict(F.col("t")).alias("v"), T.verdict_rest(F.col("t")).alias("r"), T.citations(F.col("t")).alias("c"), T.occurrences(F.lit("aaa"), F.lit("aa")).alias("n")).first()
    assert (row["v"], row["c"], row["n"]) == ("SUPPORTED", ["d1", "d2"], 2) and row["r"].startswith("because")
    udf = df.select(T.normalised_udf(F.lit("ﬁne  Straße")).alias("n"), T.canonical_key_udf(F.lit("“Hello,  World!”")).alias("k")).first()
    assert (udf["n"], udf["k"]) == ("fine strasse", "hello, world")


def test_best_chunk_depends_on_representations(spark):
    chunks = spark.createDataFrame([("d1", "strict", 0, [1.0, 0.0]), ("d1", "broad", 0, [0.0, 1.0]), ("d2", "strict", 0, [0.0, 0.9])], "doc_id string, representation string, ordinal int, embedding array<float>")
    asked = spark.createDataFrame([("q", [0.1, 1.0])], "query_id string, embedding array<float>")
    assert dense.vector_search(asked, chunks, 1).first()["doc_id"] in ("d1", "d2")
    assert dense.vector_search(asked, chunks, 1, ["strict"]).first()["doc_id"] == "d2"


def test_top_k_survives_small_batches(spark):
    import numpy as np

    r = np.random.Generator(np.random.PCG64(9))
    rows = [(int(i // 3), "r", int(i % 3), r.normal(size=8).tolist()) for i in range(120)] + [(50, "r", 0, [0.0] * 8), (51, "r", 0, None)]
    chunks = spark.createDataFrame(rows, "doc_id long, representation string, ordinal int, embedding array<double>").repartition(7)
    asked = [(q, r.normal(size=8).tolist()) for q in range(4)]
    got = dense.vector_search(spark.createDataFrame(asked, "query_id long, embedding array<double>"), chunks, 5).collect()
    for q, v in asked:
        best = {}
        for d, _, _, e in rows:
            if e and any(e):
                best[d] = max(best.get(d, -2.0), round(float(np.dot(e, v) / np.linalg.norm(e) / np.linalg.norm(v)), 6))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(x["doc_id"], x["score"]) for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == want


def test_all_strategies_run(spark):
    docs = spark.createDataFrame([(1, "Aspirin", "Aspirin lowers fever. It works fast."), (2, "Tea", "Tea warms hands."), (3, "Fever", "Fever may follow a cold.")], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(1, "aspirin fever")], "query_id long, text string")
    engine = Engine(docs)
    assert len(CATALOGUE) == 33 and DEFAULT in CATALOGUE
    for name in ("bm25", "keyword", "token-window", "bm25-coref-max-rrf", "rerank-msmarco", "pooled-four-channel-rrf", "pooled-coref-interval-rankzephyr", DEFAULT):
        assert engine.search(asked, name, 3).filter("rank = 1").first()["doc_id"] == 1, name
    answer = engine.ask(asked, "bm25", 2).first()
    assert answer["valid"] and answer["citations"] == ["1"]
    assert available({"store"})["default"] == "bm25"


def test_readers_and_sinks(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"_id": "1", "text": "a"}\n{"_id": "1", "text": "b"}\n')
    assert [r["text"] for r in readers.queries(spark, str(path)).collect()] == ["b"]
    with pytest.raises(ContractError):
        require_unique(spark.createDataFrame([(1,), (1,)], "k long"), "k")
    target = tmp_path / "once.txt"
    assert sinks.write_once("x", str(target)) and not sinks.write_once("x", str(target))
    with pytest.raises(ContractError):
        sinks.write_once("y", str(target))
    sinks.write_report({"b": 1}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text().startswith("{")
    assert manifest_violations({"run_id": "a b"}, {"run_id": str}, [], ["run_id"]) == ["run_id is not a safe name"]


def test_bm25_ranks_the_rarer_term_first(spark):
    docs = spark.createDataFrame([(1, "", "common rare"), (2, "", "common common"), (3, "", "")], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    assert [r["doc_id"] for r in lexical.bm25_search(asked, docs, 5).orderBy("rank").collect()] == [1, 2]
