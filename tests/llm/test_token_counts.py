"""Cached token counts against the library text by text."""

import shutil

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evidara.llm import token_counts

SCHEMA = "doc_id long, text string, digest string, n_tokens string, content string, version string"
ROWS = [(None, None), (None, "a"), (1, ""), (2, "hello world"), (2, "hello world"), (3, "hello world"), (4, "<|endoftext|> x <|endoftext|>"), (5, "é😀\n\n  \t x"), (6, "word " * 30_000), (7, "y" * 50_000)]


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)


def brute(name):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(public_tokenizers.path(name))
        return lambda t: len(own.encode(t, add_special_tokens=False).ids)
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return lambda t: len(own.encode(t))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, tmp_path, name):
    count = brute(name)
    got = token_counts.count_tokens(frame(spark, ROWS), public_tokenizers.path(name), str(tmp_path / "cache")).collect()
    expected = [(i, len((t or "").encode()), n := count(t or ""), n > 1024) for i, t in ROWS]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    version = token_counts.tokenizer_version(path)
    stored = lambda: spark.read.parquet(f"{cache}/version={version}")
    many = ROWS + [(100 + i, f"text {i % 5}") for i in range(500)]
    token_counts.count_tokens(frame(spark, many).repartition(7), path, cache).collect()
    assert stored().count() == len({t or "" for _, t in many}) == stored().select("digest").distinct().count()
    # What is stored is believed: a planted count comes back, and only the new text is added.
    shutil.rmtree(f"{cache}/version={version}")
    planted = spark.createDataFrame([("hello world", 99), ("hello world", 99)], "text string, n_tokens long").select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "n_tokens")
    planted.write.parquet(f"{cache}/version={version}")
    got = token_counts.count_tokens(frame(spark, [(1, "hello world"), (2, "new"), (3, "hello world")]), path, cache).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 99), (2, 1), (3, 99)]
    assert stored().count() == 3
    again = token_counts.count_tokens(frame(spark, [(1, "hello world"), (2, "new")]), path, cache)
    assert again.count() == 2 and stored().count() == 3


def test_versions_do_not_share_counts(spark, tmp_path):
    one, two = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    assert token_counts.tokenizer_version(one) != token_counts.tokenizer_version(two)
    docs = frame(spark, [(1, "über 12345 naïve façade ☃")])
    counts = [token_counts.count_tokens(docs, p, str(tmp_path)).first().n_tokens for p in (one, two)]
    assert counts[0] != counts[1]


def test_empty_table(spark, tmp_path):
    assert token_counts.count_tokens(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path)).count() == 0


def test_normalised_contents_share_a_count(spark, tmp_path):
    """Counts of a lower-casing tokenizer do not change with case, so contents may be lower-cased first."""
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.count_tokens(frame(spark, [(1, "Some Words"), (2, "some words")]), path, str(tmp_path), normalise=F.lower).collect()
    assert len({r.n_tokens for r in got}) == 1
    assert spark.read.parquet(f"{tmp_path}/version={token_counts.tokenizer_version(path)}").count() == 1


def test_counting_by_parts_equals_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.parts_at_spaces(path)
    assert not token_counts.parts_at_spaces(public_tokenizers.path("word_bpe_49k.json"))
    r = np.random.Generator(np.random.PCG64(3))
    signs = list("ab'stre12.,;  \n\n\t\r\x0b\x1c\x1f\x85\xa0\u2003\u3000é漢😀") + ["<|endoftext|>", "<|endof", "text|>", "'re", " '", "\u200b"]
    texts = ["".join(r.choice(signs, int(r.integers(0, 40)))) for _ in range(3000)]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL").collect()]
    assert token_counts.counter(path)(texts) == list(map(brute("byte_bpe_50k.json"), texts))
