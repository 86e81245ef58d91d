"""Storage semantics over relations: upsert, refresh, replace, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.operators.checks import broadcast_if_small


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents after an upsert of (doc_id, title, text, embedding), with ``action``.

    A new id is inserted.  A stored one is updated only if its title or text
    differs or it gains a vector; a null incoming vector keeps the stored one.
    """
    old = stored.select("doc_id", *[F.col(c).alias(f"old_{c}") for c in ("title", "text", "embedding")], F.lit(True).alias("was"))
    new = incoming.select("doc_id", "title", "text", "embedding", F.lit(True).alias("comes"))
    both = old.join(new, "doc_id", "full_outer")
    differs = ~F.col("title").eqNullSafe(F.col("old_title")) | ~F.col("text").eqNullSafe(F.col("old_text")) | (F.col("old_embedding").isNull() & F.col("embedding").isNotNull())
    action = F.when(F.col("comes").isNull(), "kept").when(F.col("was").isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
    use_new = F.col("action").isin("inserted", "updated")
    return both.withColumn("action", action).select(
        "doc_id", F.when(use_new, F.col("title")).otherwise(F.col("old_title")).alias("title"), F.when(use_new, F.col("text")).otherwise(F.col("old_text")).alias("text"),
        F.when(use_new, F.coalesce("embedding", "old_embedding")).otherwise(F.col("old_embedding")).alias("embedding"), "action",
    )


def refresh_postings(stored: DataFrame, documents: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with those of the changed doc_ids computed anew and all others kept."""
    from evidara.operators.lexical import postings

    ids = changed.select("doc_id").distinct()
    fresh = postings(documents.join(ids, "doc_id", "left_semi"))
    # The ids are the side that is held; the stored postings stream past them unsorted.
    held = broadcast_if_small(ids.hint("shuffle_hash"))
    return stored.join(held, "doc_id", "left_anti").unionByName(fresh)


def replace_representations(stored: DataFrame, incoming: DataFrame, documents: DataFrame, representations: list[str]) -> DataFrame:
    """Chunks after dropping (documents x representations) and inserting the incoming ones."""
    gone = documents.select("doc_id").distinct()
    touched = stored.filter(F.col("representation").isin(representations))
    return stored.filter(~F.col("representation").isin(representations)).unionByName(touched.join(gone, "doc_id", "left_anti")).unionByName(incoming)


def load_chunks(chunks: DataFrame, documents: DataFrame, representations: list[str]) -> DataFrame:
    """Stored chunks of the given documents and representations, in order."""
    found = chunks.filter(F.col("representation").isin(representations)).join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.orderBy("doc_id", "representation", "ordinal")
