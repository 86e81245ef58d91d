"""What a task holds of its chunks and texts does not grow with its batches."""

import pyarrow as pa

from evidara.functions import text as T
from evidara.operators import chunking


def test_chunks_are_told_in_parts(spark, monkeypatch):
    frames = []
    frame = chunking.pd.DataFrame
    docs = spark.createDataFrame([(i, "Alpha Beta went. It came back. " * 4) for i in range(50)], "doc_id long, text string").coalesce(1)

    class Captured:
        dtypes = docs.dtypes

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            frames.extend(run(iter([frame({"doc_id": range(50), "text": ["Alpha Beta went. It came back. " * 4] * 50})])))
            return self

    chunking._analysed(Captured(), lambda t: [("r", 0, t, True)], held=1000)
    assert len(frames) > 4 and sum(map(len, frames)) == 50 and max(map(len, frames)) < 12
    one = sorted(map(str, chunking.coreference_sentences(docs, None).collect()))
    two = sorted(map(str, chunking.coreference_sentences(docs, False).unionByName(chunking.coreference_sentences(docs, True)).collect()))
    assert one == two and len(one) > 100


def test_unicode_forms_stay_in_arrow(spark):
    assert T._each(pa.array(["ﬁ", None, ""]), str.upper).to_pylist() == ["FI", None, ""]
    df = spark.createDataFrame([(1, "ﬁ  ﬀ Ａ"), (2, None), (3, "")], "i long, t string")
    got = df.select("i", T.normalised_udf("t").alias("a"), T.nfkc_udf("t").alias("b")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, "fi ff a", "fi  ff A"), (2, None, None), (3, "", "")]
