"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations only.

Every item window (10 words) must occur whole, so it shares all its 3-word
shingles with a document that has it, and one necessary shingle is enough to
find it: the rarest one over all documents.  The documents' shingles are joined
with those prefix tokens; a match fixes where the window would start, which
must lie inside the document (positional and length bounds); then the window's
words are compared one by one.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.llm.runtime import TEXT_KEYS, checkpointed, with_text_keys
from evidara.llm.words import quick_words_of, words_of

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
#: Windows broadcast at once; a benchmark with more is worked through in blocks of so many.
BLOCK_WINDOWS = 100_000


def _token(k: int, words: str, pos: Column) -> Column:
    """Hash of k words from a position on; words past the end are null."""
    return F.xxhash64(*[F.get(F.col(words), pos + i) for i in range(k)])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, len, window (its words), k and tokens (position in the window, hash)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.lit(WINDOW_WORDS), F.size("w"))
    windows = items.select("item_id", "w", length.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("i"))
    windows = windows.select("item_id", "len", F.slice("w", F.col("i"), F.col("len")).alias("window")).distinct()
    windows = windows.withColumn("k", F.least(F.lit(SHINGLE_WORDS), F.col("len")))
    spots = windows.select("item_id", "len", "window", "k", F.posexplode("window").alias("off", "word")).filter(F.col("off") <= F.col("len") - F.col("k"))
    own = {k: _token(k, "window", F.col("off")) for k in (1, 2, 3)}
    token = F.when(F.col("k") == 1, own[1]).when(F.col("k") == 2, own[2]).otherwise(own[3])
    return spots.select("item_id", "len", "window", "k", "off", token.alias("token"))


def find_windows(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Occurrences: doc_id, the text's keys, n_words, item_id, start, stop.

    Every document row has one row here with a null start, which carries
    n_words.  Rows are told apart by doc_id and text, which the second run of a
    lost task gives again; rows equal in both have their occurrences once each.
    """
    spots = checkpointed(item_windows(benchmark))
    kinds = sorted(r["k"] for r in spots.select("k").distinct().collect()) or [SHINGLE_WORDS]
    tokens = spots.select("k", "token").distinct()
    n_tokens, n_windows = tokens.count(), spots.select("item_id", "window").distinct().count()
    texts = with_text_keys(docs.select("doc_id", "text")).select("doc_id", *TEXT_KEYS, quick_words_of(F.col("text")).alias("w"))
    # Shingles are read from the words where they stand: arrays of them would take several times a text's memory.
    spread = texts.select("doc_id", *TEXT_KEYS, "w", F.posexplode_outer("w").alias("pos", "word"))

    # Rarity: in how many places of all documents each of the benchmark's shingles stands.
    if n_tokens <= block * WINDOW_WORDS:
        small = F.broadcast
    else:
        small = lambda df: df
    counts = None
    for k in kinds:
        own = spread.select(_token(k, "w", F.col("pos")).alias("token")).join(small(tokens.filter(F.col("k") == k).select("token")), "token")
        found = own.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("k", F.lit(k))
        counts = found if counts is None else counts.unionByName(found)
    ranked = spots.join(counts, ["k", "token"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = ranked.groupBy("item_id", "len", "window", "k").agg(F.min(F.struct("df", "token", "off")).alias("first"))
    # A shingle that no document has rules its window out.
    prefix = checkpointed(rarest.filter("first.df > 0").select("item_id", "len", "window", "k", "first.token", "first.off"))

    out, blocks = None, max(1, ceil(n_windows / block))
    for number in range(blocks):
        for k in kinds if number else sorted({*kinds, SHINGLE_WORDS}):
            mine = prefix.filter((F.col("k") == k) & (F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == number)).drop("k")
            # Of the windows that a document's first place meets only one carries n_words on.
            mine = mine.withColumn("nth", F.row_number().over(W.partitionBy("token").orderBy("item_id", "window")))
            at = spread.withColumn("token", _token(k, "w", F.col("pos"))).join(F.broadcast(mine), "token", "left")
            start = F.col("pos") - F.col("off")
            inside = F.col("len").isNotNull() & (start >= 0) & (start + F.col("len") <= F.size("w"))
            same = inside & F.when(inside, F.slice("w", start + 1, F.col("len")) == F.col("window")).otherwise(F.lit(False))
            carries = (F.coalesce(F.col("pos"), F.lit(0)) == 0) & (F.coalesce("nth", F.lit(1)) == 1) if (number, k) == (0, SHINGLE_WORDS) else F.lit(False)
            said = at.filter(carries | same).withColumn("hit", F.explode(F.filter(F.array(F.when(same, True), F.when(carries, False)), lambda x: x.isNotNull())))
            told = lambda c: F.when(F.col("hit"), c)
            rows = said.select("doc_id", *TEXT_KEYS, F.size("w").cast("long").alias("n_words"), told(F.col("item_id")).alias("item_id"), told(start).alias("start"), told(start + F.col("len")).alias("stop"))
            out = rows if out is None else out.unionByName(rows)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Score every document row against every benchmark window.

    Returns doc_id, n_words, n_hit (words inside any occurrence), n_items,
    items_sha256 and contaminated.  Null or empty texts have no words and no
    hits; an item without words has no window; an empty benchmark hits nothing
    (items_sha256 is then that of ''). Repeated rows and null ids are kept as
    rows; words of an item with a null item_id are hit, but it counts as no
    item. Extra columns are not read.
    """
    row = ["doc_id", *TEXT_KEYS]
    found = find_windows(docs, benchmark).groupBy(*row, "n_words", "item_id", "start", "stop").agg(F.count(F.lit(1)).alias("times"))
    seen = W.partitionBy(*row).orderBy(F.asc_nulls_last("start"), "stop").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(seen), F.lit(0))))
    items = F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string")))
    return (
        found.withColumn("new", F.coalesce(new, F.lit(0)))
        .groupBy(*row, "n_words")
        .agg(F.sum("new").cast("long").alias("n_hit"), items.alias("items"), F.max(F.when(F.col("start").isNull(), F.col("times"))).alias("times"))
        .withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))  # a row each again
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        )
    )
