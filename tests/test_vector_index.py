"""Pruned vector search against the search of all chunks."""

import numpy as np
import pytest

from evidara.operators import dense
from evidara.operators.checks import ContractError
from evidara.operators.vector_index import VectorIndex

SCHEMA = "doc_id long, representation string, ordinal int, embedding array<float>"


def clustered(seed, n, centres=20, width=0.05, size=12):
    r = np.random.Generator(np.random.PCG64(seed))
    middle = r.normal(size=(centres, size))
    rows = [(i // 3, "ab"[i % 2], i % 3, (middle[i % centres if i % 3 else 0] + width * r.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n, "a", 0, None), (n + 1, "a", 0, [0.0] * size), (n + 2, "a", 0, rows[0][3]), (n + 3, "b", 1, rows[0][3])], middle


def answers(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "representation", "ordinal", "score", "rank").collect()))


def test_pruned_search_equals_full_search_and_reads_less(spark, tmp_path):
    rows, middle = clustered(1, 1500)
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, m.astype(np.float32).tolist()) for i, m in enumerate(middle)] + [(90, None), (91, [0.0] * 12), (92, rows[0][3])], "query_id long, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path))
    index.build(chunks)
    for k in (1, 7):
        assert answers(index.search(asked, k)) == answers(dense.vector_search(asked, chunks, k))
    assert answers(index.search(asked, 3, ["b"])) == answers(dense.vector_search(asked, chunks, 3, ["b"]))
    work = index.work(asked, 7).collect()
    # A third of all chunks lies around the first centre, which only its own queries read.
    assert sum(r.chunks_met for r in work) < 0.35 * sum(r.chunks for r in work)


def test_random_vectors_and_more_results_than_documents(spark, tmp_path):
    rows, _ = clustered(2, 90, 90, 3.0, 4)
    chunks = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows[:9])], "query_id long, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path))
    index.build(chunks, cells=10)
    for k in (5, 200):
        assert answers(index.search(asked, k)) == answers(dense.vector_search(asked, chunks, k))


def test_empty_and_uneven(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert index.search(asked, 3).count() == 0
    index.build(spark.createDataFrame([], SCHEMA))
    assert index.search(asked, 3).count() == 0
    with pytest.raises(ContractError):
        index.build(spark.createDataFrame([(1, "a", 0, [1.0]), (2, "a", 0, [1.0, 2.0])], SCHEMA))


def test_reduced_keeps_ties_and_the_first_chunk():
    import pyarrow as pa

    docs, reps, ordinals = pa.array([2, 1, 1, 3]), pa.array(["a", "b", "a", "a"]), pa.array([0, 0, 1, 0])
    scores = np.array([[0.5, -np.inf], [0.7, 0.1], [0.7, 0.1], [0.5, 0.3]])
    q, row, score = dense.reduced(docs, reps, ordinals, scores, 2)
    assert sorted(zip(q.tolist(), row.tolist(), score.tolist(), strict=True)) == [(0, 0, 0.5), (0, 2, 0.7), (0, 3, 0.5), (1, 2, 0.1), (1, 3, 0.3)]
