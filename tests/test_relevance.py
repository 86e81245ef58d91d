"""Documents that hold an item's text: found where the items travel as where they are joined."""

from evidara.operators import lexical
from evidara.plans import views


def test_travelling_items_find_what_joins_find(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "xx the rare word yy"), (2, "no the rare  word"), (3, None), (4, "the rare word"), (5, "the rare wordy Ünï")], "doc_id long, t string")
    inner = spark.createDataFrame([(1, "the rare word", ["rare"]), (2, "a nowhere b", ["nowhere"]), (3, "?", None), (4, "e rare w", ["rare"])], "query_id long, text string, w array<string>")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id").distinct().collect()))
    expected = [(1, 1), (1, 4), (1, 5), (4, 1), (4, 4), (4, 5)]
    assert rows(views._holders(docs, inner)) == expected == rows(views._joined_holders(docs, inner))
    assert rows(views._holders(docs, inner.filter("w IS NULL"))) == []


def test_nothing_asked_and_nothing_held(spark):
    docs = spark.createDataFrame([(1, "a", "b c"), (2, None, None)], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(1, "c a"), (2, "")], "query_id long, text string")
    for search in (lexical.bm25_search, lexical.keyword_search):
        assert [tuple(r)[:2] for r in search(asked, docs, 3).collect()] == [(1, 1)]
        assert search(asked.filter("query_id = 2"), docs, 3).collect() == []
        assert search(asked, docs.limit(0), 3).collect() == []
    pool = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id long, doc_id long")
    assert [r["score"] > 0 for r in sorted(lexical.bm25_rescore(asked, docs, pool).collect())] == [True, False, False]
    assert [r["score"] > 0 for r in sorted(lexical.keyword_rescore(asked, docs, pool).collect())] == [True, False, False]
