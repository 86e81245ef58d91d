"""Texts decoded all at once equal texts decoded one by one."""

import numpy as np
import pyarrow as pa

from evidara.llm import pieces


def test_decoded_texts_are_decoded_ids():
    vocabulary = pieces.Vocabulary.load()
    texts = [" two  blanks ", "", None, "▁ Ünï 中\n", "x", "\U0001f600\x00", ""]
    ids, begin = pieces.sample_ids(texts, np.arange(len(texts)).astype(np.uint64), vocabulary, 1, 0.5)
    table = pa.array(vocabulary.bytes_of, pa.large_binary())
    one_by_one = [pieces.decode_ids(ids[a:b], vocabulary) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    assert pieces.decoded_texts(ids, begin, table).cast(pa.string()).to_pylist() == one_by_one == [t or "" for t in texts]
    none = pieces.decoded_texts(np.empty(0, np.int32), np.zeros(3, np.int64), table)
    assert none.to_pylist() == [b"", b""]
