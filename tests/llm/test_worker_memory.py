"""The pipeline's stages hold few texts and no needless copies at a time, with the same results."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from evidara.llm import decontaminate, jaccard, language, pieces
from evidara.llm.runtime import giving_back


def test_repeated_values_take_one_sorted_copy():
    held = [np.random.default_rng(i).integers(0, 400_000, 50_000).astype(np.uint64) for i in range(10)]
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    tracemalloc.start()
    found, times = jaccard.repeated(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.tolist() == keys[counts > 1].tolist() and times.tolist() == counts[counts > 1].tolist()
    assert peak < 2.6 * 8 * 500_000  # np.unique takes more than 3 times the input
    for few in ([], [7], [7, 7], [1, 2, 2, 3, 3, 3]):
        found, times = jaccard.repeated([np.array(few, np.uint64)])
        assert dict(zip(found.tolist(), times.tolist(), strict=True)) == {x: few.count(x) for x in few if few.count(x) > 1}


def test_fewer_characters_at_once_give_the_same_pieces(spark):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"word{i % 3} of some text " * (i % 5)) for i in range(40)], "doc_id long, text string")
    whole = pieces.encode_documents(docs, check=True).orderBy("doc_id").collect()
    assert pieces.encode_documents(docs, check=True, run_characters=10).orderBy("doc_id").collect() == whole
    assert corpus_pipeline.RUN_CHARACTERS < pieces.RUN_CHARACTERS


def test_a_batch_is_kept_in_small_parts(spark):
    english = "the cat and the dog sat on the mat with a hat and the end of it "
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("12 34")).when(F.col("id") % 3 == 1, F.repeat(F.lit(english), 500)).alias("text"), F.lit("en").alias("lang")).coalesce(1)
    left = language.keep_identified(docs, language.fit_profiles(docs), 0.2)
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == [i for i in range(300) if i % 3 == 1]


def test_a_task_gives_its_memory_back():
    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    last = []

    def run(batches):
        many = [np.ones(6000) for _ in range(4000)]
        last.append(np.ones(6000))  # stands behind them, so that freeing them alone leaves the heap as it is
        yield from batches
        assert held() > before + 150
        del many

    before = held()
    assert list(giving_back(run)(iter([1, 2]))) == [1, 2]
    assert held() < before + 50


def test_shingles_are_read_from_the_words_where_they_stand(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "W3 w4, w5"), (3, ""), (4, None), (5, " ".join(words[:9])), (6, "É " + " ".join(words[:12]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[2:13])), (2, "w4 w5"), (3, "w29")], "item_id long, text string")
    found = decontaminate.find_windows(docs, items)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "arrays_zip" not in plan
    got = {(r.doc_id, r.item_id, r.start) for r in found.filter("start IS NOT NULL").collect()}
    assert got == {(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 29), (2, 2, 1), (5, 2, 4), (6, 1, 3), (6, 2, 5)}
