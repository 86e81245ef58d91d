"""Word classes come from all training rows, and hashed words are those of the texts."""

import numpy as np
import pyarrow as pa
import xxhash

from evidara.llm import lm


def test_classes_know_the_words_of_every_row(spark):
    common = [[f"le{k}" for k in range(12)], [f"der{k}" for k in range(12)]]
    # Of each of 2,400 rows one word is its own; its ending tells nothing.
    rows = [(i, " ".join([*common[i % 2], *[f"{i * 7919 % 10007}w"] * 4])) for i in range(2400)]
    classes = lm.fit_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    table = lm.WordTable(classes)
    own = [[table[f"{i * 7919 % 10007}w".encode()] for i in range(2400) if i % 2 == k] for k in (0, 1)]
    unseen = table[b"unseen"]
    kinds = [set(table.kinds()[x].tolist()) for x in own]
    assert len(kinds[0]) == len(kinds[1]) == 1 and kinds[0] != kinds[1]
    assert not (kinds[0] | kinds[1]) & {classes.count - 1, table.kinds()[unseen]}


def test_hashed_words_are_the_tokens(spark):
    texts = [None, "", " \t", "Ärger  ONE\ntwo ", "x y one", *["a b"] * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: list(np.frombuffer(r["words"], np.uint64)) for r in lm.as_words(df).collect()}
    assert got == {i: [xxhash.xxh64_intdigest(w) for w in [*lm.tokens_of(t), lm.END]] for i, t in enumerate(texts)}
    part = lm.Words(pa.array([np.array(got[i], np.uint64).tobytes() for i in range(len(texts))], pa.binary()).slice(3, 4))
    ends = [*part.starts[1:].tolist(), len(part.ids)]
    assert [part.hashes[part.ids[a:b]].tolist() for a, b in zip(part.starts.tolist(), ends, strict=True)] == [got[i] for i in (3, 4, 5, 6)]
    assert part.hashes[part.end] == xxhash.xxh64_intdigest(lm.END)
