"""Token counts over a digest cache: only contents that no run has counted are encoded.

The cache is a folder of Parquet rows (content digest, count), one part for
each version of a tokenizer.  A row is a fact about its content, so appending
it twice, by two runs or by the second try of a lost task, changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.runtime import shared_dir, slices, spread_join

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
#: Digests that a task remembers to send copies of a content only once; whatever it forgets meets again behind the shuffle.
LOCAL_DIGESTS = 1 << 17
#: Where a part of a text starts: a blank or line feed behind anything that is not white space.
PART_START = re.compile(r"(?<=\S)(?=[ \n])")
#: Parts of texts whose counts a worker remembers before it starts anew.
KNOWN_PARTS = 1 << 17


def tokenizer_version(path: str) -> str:
    """Digest of everything a count depends on: the vocabulary file, the library and its version, and the settings used."""
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    digest = hashlib.sha256(f"{library.__name__} {library.__version__} without begin, end, truncation, padding\n".encode())
    digest.update(Path(path).read_bytes())
    return digest.hexdigest()


def parts_at_spaces(path: str) -> bool:
    """Whether a tokenizer never joins a blank or line feed to what stands before it, so that texts may be counted part by part.

    So it is for byte-level BPE with its own pattern: only its runs of white
    space go on into white space, and nothing else of it looks back.
    """
    if not path.endswith(".json"):
        return False
    said = json.loads(Path(path).read_text(encoding="utf-8"))
    first = said["pre_tokenizer"] or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in said["added_tokens"])
    return said["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex", False) and not first["add_prefix_space"] and plain


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts by the library of the file: tokenizers for .json, sentencepiece for .model.  A worker loads it once."""
    if not path.endswith(".json"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, add_bos=False, add_eos=False, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not parts_at_spaces(path):
        return whole
    known: dict[str, int] = {}

    def by_parts(texts: list[str]) -> list[int]:
        if len(known) > KNOWN_PARTS:
            known.clear()
        parts = [PART_START.split(t) for t in texts]
        new = list({p for own in parts for p in own if p not in known})
        for at in range(0, len(new), 1000):
            known.update(zip(new[at : at + 1000], whole(new[at : at + 1000]), strict=True))
        return [sum(map(known.__getitem__, own)) for own in parts]

    return by_parts


def cached(spark: SparkSession, folder: str, version: str) -> DataFrame | None:
    """digest and n_tokens, once each, that the cache holds for a version; None if it holds nothing yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={version}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    found = spark.read.schema("digest binary, n_tokens long").parquet(f"{folder}/version={version}")
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, key: str = "doc_id", normalise: Callable[[Column], Column] = lambda c: c, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Tokens of every whole text: ``key``, n_bytes, n_tokens, over_limit.

    ``path`` is a vocabulary file that every worker can open, ``cache`` a folder
    that driver and executors share.  ``normalise`` maps texts to the content
    that is counted and must not change a count; null texts count as empty.
    Each distinct content missing in the cache is encoded once, however many
    rows have it, and appended before the rows read their counts from there.
    Rows with null or repeated keys are kept as rows; other columns are not read.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    content = normalise(text)
    digest = F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest")

    def once(batches):
        """Leaves out a content that this task sent lately."""
        seen: dict[bytes, None] = {}
        for batch in batches:
            keep = []
            for own in batch.column(0).to_pylist():
                keep.append(own not in seen)
                seen[own] = None
                if len(seen) > LOCAL_DIGESTS:
                    del seen[next(iter(seen))]
            yield batch.filter(pa.array(keep))

    def encode(batches):
        count, last = counter(path), None
        for batch in batches:
            # Equal digests stand together, so the one before tells a repeat.
            digests = batch.column(0).to_pylist()
            new = [own != before for own, before in zip(digests, [last, *digests], strict=False)]
            last = digests[-1] if digests else last
            left = batch.filter(pa.array(new, pa.bool_()))
            at = 0
            for part in slices(left.column(1)):
                counts = count(part.to_pylist())
                yield pa.RecordBatch.from_arrays([left.column(0).slice(at, len(part)), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
                at += len(part)

    contents = docs.select(digest, content.alias("content")).mapInArrow(once, "digest binary, content string").repartition("digest")
    stored = cached(spark, cache, version)
    if stored is not None:
        contents = contents.join(stored.select("digest").hint("shuffle_hash"), "digest", "left_anti")
    misses = contents.sortWithinPartitions("digest").mapInArrow(encode, "digest binary, n_tokens long")
    misses.write.mode("append").parquet(f"{cache}/version={version}")
    rows = docs.select(key, F.octet_length(text).cast("long").alias("n_bytes"), digest)
    counted = spread_join(rows, cached(spark, cache, version), ["digest"], key)
    return counted.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def new_cache(spark: SparkSession) -> str:
    """A cache folder of its own in the shared folder, for results that depend on no earlier run."""
    return f"{shared_dir(spark)}/token-counts-{uuid4().hex}"
