"""The stored index and the snapshot store under it."""

import numpy as np
import pytest

from evidara.operators import lexical
from evidara.operators.index import LexicalIndex
from evidara.sources.snapshots import ChunkStore, Snapshots, StaleVersionError

DOCS = "doc_id long, title string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x) for i, (t, x) in rows.items()], DOCS)


def texts(seed, n, vocabulary=60):
    """Texts of Zipf-like words, so that a few words are in nearly all of them."""
    r = np.random.Generator(np.random.PCG64(seed))
    words = lambda k: " ".join(f"w{min(vocabulary, int(x))}" for x in r.zipf(1.3, k))
    return {i: (words(2) if i % 3 else None, words(int(r.integers(0, 30)))) for i in range(n)}


def answers(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))


QUERIES = [(1, "w1 w2 w3"), (2, "w7"), (3, "w40 w1"), (4, ""), (5, None), (6, "absent"), (7, "w1 w1 W5 w6 w7 w8 w9")]


def test_index_equals_scan_after_updates_removals_and_compaction(spark, tmp_path):
    asked = spark.createDataFrame(QUERIES, "query_id long, text string")
    rows = texts(1, 300)
    index = LexicalIndex(spark, str(tmp_path), buckets=3, block=8)
    assert index.refresh(frame(spark, rows)) == 1
    assert answers(index.search(asked, 5)) == answers(lexical.bm25_search(asked, frame(spark, rows), 5))
    batch = texts(2, 40) | {900: ("w7", "w7 w7 w40"), 901: (None, None)} | {50: rows[50]}
    rows |= batch
    del rows[3], rows[200]
    index.refresh(frame(spark, batch).filter("doc_id <> 3"), spark.createDataFrame([(3,), (200,), (12345,)], "doc_id long"))
    expected = answers(lexical.bm25_search(asked, frame(spark, rows), 5))
    assert answers(index.search(asked, 5)) == expected
    batch = {900: ("gone", "w1"), 7: ("w7", "w7")}
    rows |= batch
    index.refresh(frame(spark, batch))
    expected = answers(lexical.bm25_search(asked, frame(spark, rows), 7))
    assert answers(index.search(asked, 7)) == expected
    index.compact()
    assert answers(LexicalIndex(spark, str(tmp_path)).search(asked, 7)) == expected


def test_search_skips_blocks_and_reads_no_text(spark, tmp_path):
    asked = spark.createDataFrame([(1, "w1 rare")], "query_id long, text string")
    rows = {i: (None, f"w1 x{i} y z") for i in range(2000)} | {5000 + i: (None, "rare rare w1") for i in range(4)}
    index = LexicalIndex(spark, str(tmp_path), buckets=2, block=50)
    index.refresh(frame(spark, rows))
    work = index.work(asked, 3).first()
    assert work.postings == 2004 + 4 and work.postings_read < work.postings / 5
    assert answers(index.search(asked, 3)) == answers(lexical.bm25_search(asked, frame(spark, rows), 3))
    plan = index.search(asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "documents-" not in plan and index.store.manifest()["n"] == 2004


def test_unchanged_documents_are_not_written_again(spark, tmp_path):
    rows = texts(4, 30)
    index = LexicalIndex(spark, str(tmp_path), buckets=2)
    index.refresh(frame(spark, rows))
    index.refresh(frame(spark, rows))
    state = index.store.manifest()
    assert state["n"] == 30 and index.store.read(state["segments"][1]["documents"]).count() == 0


def test_snapshots_swap_whole_versions(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert store.version() == 0 and store.manifest() == {}
    first = store.write("rows", spark.range(3))
    assert store.commit(0, {"rows": first}) == 1
    reader = store.read(store.manifest()["rows"])
    second = store.write("rows", spark.range(5))
    assert store.read(store.manifest()["rows"]).count() == 3  # written but not committed
    assert Snapshots(spark, str(tmp_path)).commit(1, {"rows": second}) == 2
    with pytest.raises(StaleVersionError):
        store.commit(1, {"rows": first})
    assert reader.count() == 3 and store.read(store.manifest()["rows"]).count() == 5
    assert store.clean() == [first.split("/")[1]] and store.read(store.manifest()["rows"]).count() == 5


def test_a_race_for_the_same_version_has_one_winner(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, str(tmp_path))
    store.commit(0, {"who": "a"})
    late = Snapshots(spark, str(tmp_path))
    monkeypatch.setattr(late, "version", lambda: 0)  # it looked before the other moved its manifest into place
    with pytest.raises(StaleVersionError):
        late.commit(0, {"who": "b"})
    assert store.manifest() == {"who": "a"}


def test_chunks_are_replaced_whole(spark, tmp_path):
    schema = "doc_id long, representation string, ordinal int, text string"
    old = [(d, r, o, f"old {d}{r}{o}") for d in range(4) for r in ("a", "b") for o in range(3)]
    store = ChunkStore(spark, str(tmp_path))
    docs = spark.range(4).withColumnRenamed("id", "doc_id")
    store.replace(spark.createDataFrame(old, schema), docs, ["a", "b"])
    before = store.chunks()
    new = [(1, "a", 0, "new"), (3, "a", 0, "new")]
    store.replace(spark.createDataFrame(new, schema), spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), ["a"])
    expected = [x for x in old if x[1] == "b" or x[0] == 0] + new
    assert sorted(map(tuple, store.chunks().collect())) == sorted(expected)
    assert sorted(map(tuple, before.collect())) == sorted(old)
    with pytest.raises(StaleVersionError):
        store.replace(spark.createDataFrame(new, schema), docs, ["b"], base=1)
    assert sorted(map(tuple, store.chunks().collect())) == sorted(expected)


def test_pairs_of_query_and_document_are_never_shuffled(spark, tmp_path):
    asked = spark.createDataFrame([(i, f"w1 w2 w{3 + i % 20} w{i}") for i in range(30)] + [(99, "absent")], "query_id long, text string")
    rows = texts(5, 400)
    index = LexicalIndex(spark, str(tmp_path), buckets=2, block=8)
    index.refresh(frame(spark, {i: (t, x) if i % 3 else (t, "other") for i, (t, x) in rows.items()}))
    index.refresh(frame(spark, rows))
    found = index.search(asked, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan and "Aggregate [doc_id" in plan
    assert answers(found) == answers(lexical.bm25_search(asked, frame(spark, rows), 5))
    assert index.search(asked.filter("query_id = 99"), 5).count() == 0


def test_blocks_are_cut_where_their_postings_stand(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path), buckets=2, block=8)
    index.refresh(frame(spark, texts(6, 200)))
    blocks = index.store.read(index.store.manifest()["segments"][0]["blocks"]).collect()
    postings = lexical.postings(frame(spark, texts(6, 200))).collect()
    assert sorted((b.term, p.doc_id, p.tf, p.dl) for b in blocks for p in b.postings) == sorted((p.term, p.doc_id, p.tf, p.dl) for p in postings)
    for b in blocks:
        assert (b.n, b.max_tf, b.min_dl) == (len(b.postings), max(p.tf for p in b.postings), min(p.dl for p in b.postings)) and b.n <= 8 and b.low <= b.high
    assert len({(b.term, b.chunk) for b in blocks}) == len(blocks)
    made = index._blocks(lexical.postings(frame(spark, texts(6, 200))), 10.0)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("RepartitionByExpression") == 1 and "Aggregate [bucket" not in made  # postings go once, by ranges
    assert not list(tmp_path.glob("data/incoming-*"))


def test_a_segment_without_postings_can_be_read(spark, tmp_path):
    asked = spark.createDataFrame(QUERIES, "query_id long, text string")
    rows = texts(7, 60)
    index = LexicalIndex(spark, str(tmp_path), buckets=2, block=8)
    index.refresh(frame(spark, rows))
    index.refresh(frame(spark, rows))  # nothing is new
    assert answers(index.search(asked, 5)) == answers(lexical.bm25_search(asked, frame(spark, rows), 5))
