"""Corpus pipeline: language ID, near-duplicate removal, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import decontaminate, jaccard, language, pieces
from evidara.llm.runtime import TEXT_KEYS, checkpointed, small, table, with_text_keys

#: Documents below this language score have next to none of any learnt language's n-grams.
LEAST_LANGUAGE_SCORE = 0.2
#: Rows to drop that may be broadcast; with more the join shuffles.
MOST_BROADCAST_ROWS = 1 << 20
#: Characters that the last stage encodes together; its workers also hold what the stages before left in them.
RUN_CHARACTERS = 400_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with text keys, without the rows that equal one of ``gone`` in all its columns, nulls included."""
    mine, theirs = docs.alias("mine"), small(gone, MOST_BROADCAST_ROWS).alias("theirs")
    same = F.lit(True)
    for c in gone.columns:
        same = same & F.col(f"mine.{c}").eqNullSafe(F.col(f"theirs.{c}"))
    return mine.join(theirs, same, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (a null text too) and those like no learnt language.

    If no document has a lang, nothing is learnt and only those without a letter go.
    """
    return language.keep_identified(docs, language.fit_profiles(docs), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingles at a similarity of 0.8 stays: that of least doc_id.

    A document is a row, whether its doc_id is null or stands in other rows with
    other texts; null doc_ids come last.  Of rows equal in doc_id and text one stays.
    """
    keyed, columns = with_text_keys(docs), docs.columns
    gone, repeats = jaccard.near_duplicates(docs, width=5, threshold=(8, 10))
    kept = _without(keyed, gone)
    if repeats.isEmpty():
        return kept.select(columns)
    row = ["doc_id", *TEXT_KEYS]
    texts = repeats.select(*TEXT_KEYS).distinct()
    again = kept.join(small(texts, MOST_BROADCAST_ROWS), [*TEXT_KEYS], "left_semi").dropDuplicates(row)
    return _without(kept, texts).select(columns).unionByName(again.select(columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document in which a window of a benchmark item occurs, whatever its doc_id or the item's."""
    found = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark")).filter("start IS NOT NULL")
    gone = checkpointed(found.select(*TEXT_KEYS).distinct())
    return _without(with_text_keys(docs), gone).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document left, and whether they decode to its text."""
    return pieces.encode_documents(docs, check=True, run_characters=RUN_CHARACTERS)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL cannot express the first, second and last stage; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
