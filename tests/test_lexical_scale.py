"""Searches keep the best of each task, so pairs of query and document are not shuffled."""

import random

import pytest

from evidara.operators import lexical


@pytest.fixture(scope="module")
def given(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 30))) for _ in range(150)]
    # Copies and short texts tie; a null text has no word.
    rows = [(i, draw.choice(words), texts[i % 150] if i % 7 else None) for i in range(600)]
    asked = [(i, " ".join(draw.choices(words, k=i % 5))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string").repartition(5)
    return spark.createDataFrame(asked, "query_id long, text string"), docs


@pytest.mark.parametrize("name", ["bm25", "keyword"])
def test_search_equals_all_scores(given, name, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_ROWS", 16)
    asked, docs = given
    scores, search = (getattr(lexical, f"{name}_{what}") for what in ("scores", "search"))
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())
    expected = rows(lexical.top_k(scores(asked, docs), 9).filter("score > 0"))
    assert len(expected) > 80 and rows(search(asked, docs, 9)) == expected


@pytest.mark.parametrize("name", ["bm25", "keyword"])
def test_search_shuffles_no_pairs(given, name):
    asked, docs = given
    plan = getattr(lexical, f"{name}_search")(asked, docs, 9)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan
    assert not any("Exchange" in line and "doc_id" in line.split("hashpartitioning(")[-1].split(")")[0] for line in plan.split("\n") if "hashpartitioning(" in line)


def test_many_terms_are_joined(given, monkeypatch):
    asked, docs = given
    expected = sorted(map(tuple, lexical.bm25_search(asked, docs, 4).collect()))
    monkeypatch.setattr(lexical, "MOST_BROADCAST_TERMS", 3)
    assert lexical.asked_terms(asked) is None
    assert sorted(map(tuple, lexical.bm25_search(asked, docs, 4).select("query_id", "doc_id", "score", "rank").collect())) == expected


@pytest.mark.parametrize("name", ["bm25", "keyword"])
def test_one_row_group_meets_all_cores(given, name, spark, tmp_path):
    """Words are made behind an exchange that deals the rows, so one file of one row group is not one task's work."""
    asked, docs = given
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    plan = getattr(lexical, f"{name}_search")(asked, spark.read.parquet(str(tmp_path / "docs")), 9)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "REBALANCE" in plan[plan.index("MapInArrow") :]


def test_words_of_arrays_are_tokens(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from evidara.functions.text import tokens

    texts = ["ΟΔΥΣΣΕΥΣ Σ ΣΑ", "İstanbul I", None, "", " a_b--c1\n", "Ünï ŒUVRE", "x\u0000y", "中文 ٣ 3", "\U0001d400"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert lexical.word_lists(pa.array(texts)).to_pylist() == [r["w"] for r in rows.select(tokens(F.col("t")).alias("w")).collect()]
    assert lexical.word_lists(pa.array(["x", *texts])[1:4], lower=False).to_pylist() == [["ΟΔΥΣΣΕΥΣ", "Σ", "ΣΑ"], ["İstanbul", "I"], []]


def test_postings_shuffle_no_words(spark):
    """Words are counted in their rows; a doc_id that stands twice is still counted once."""
    rows = spark.createDataFrame([(1, "A", "b b c"), (2, None, None), (3, "", "x"), (3, "", "x")], "doc_id long, title string, text string")
    once = lexical.postings(rows.filter("doc_id < 3"))
    assert sorted(map(tuple, once.collect())) == [(1, "a", 4, 1), (1, "b", 4, 2), (1, "c", 4, 1)]
    assert "Aggregate" not in once._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in lexical.postings(rows).filter("doc_id = 3").collect()] == [(3, "x", 1, 2)]
    assert sorted(map(tuple, lexical.postings(rows, spark.createDataFrame([("b",)], "term string")).collect())) == [(1, "b", 4, 2)]
