"""I-Match document fingerprints over randomised lexicon subsets, natively.

The lexicon is a band of inverse document frequency, counted over near-distinct
texts: a group of copies or near copies counts once, however large it is.  A
text without a term in the band falls back on its terms below the band, else on
those above it.  A document's distinct lexicon terms are sorted and hashed once for the whole lexicon and once for each
randomised subset of it (64 bits each).  A level's subsets are disjoint cells of
a hash of the terms, so they are random but not independent of each other: a
term that two texts do not share spoils one part of a level instead of several.
Subsets come in three levels: they keep one term in
16, 64 or 256, so that texts of any length have a level whose subsets hold a few
of their terms.  The likeness of two fingerprints is the share of equal parts
among those that either has, on the sparsest level with enough of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.llm.runtime import checkpointed
from evidara.llm.words import quick_words_of as words_of

#: Levels of randomised subsets as (bits, subsets): one term in 2 ** bits, so many subsets.
LEVELS = [(4, 16), (6, 24), (8, 32)]
#: Parts that a pair needs on a level for that level to tell its likeness.
LEAST_PARTS = 8
#: The band: at least this share of near-distinct texts (and 2), at most that one.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.05
#: Terms, groups and texts that may be broadcast; with more the join shuffles.
MOST_TERMS, MOST_TEXTS = 1 << 18, 1 << 20
#: Bits of a term's hash in an entry; its tier stands above them.
TERM_BITS = 61
#: Groups that a level's subsets are split into before each subset is taken from its group.
GROUPS = 4
#: Rows to a range of doc_id, and ranges at most.
RANGE_ROWS, MOST_RANGES = 500, 1 << 16


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def near_distinct(docs: DataFrame, column: str = "text") -> tuple[DataFrame, int]:
    """text_key and weight of the texts that do not count as one text for each row, and the number of near-distinct texts.

    Of a text that stands in c rows each row weighs 1 / c.  A text weighs 0 if
    one of three minimum hashes of its runs of three words also occurs in a text
    of a lower key; the lowest of each group of near copies stays.
    """
    w, first = F.col("w"), F.col("h")
    rows = docs.select(F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("text_key"), words_of(F.col(column)).alias("w"))
    rows = rows.select("text_key", F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))).alias("h"))
    ends = [F.array_min(first), F.array_max(first), F.array_min(F.transform(first, lambda x: x.bitwiseXOR(F.lit(0x5A5A5A5A5A5A5A5A))))]
    keys = [f"k{j}" for j in range(len(ends))]
    rows = rows.select("text_key", *[F.xxhash64(F.lit(j), F.coalesce(e, F.col("text_key"))).alias(k) for j, (k, e) in enumerate(zip(keys, ends, strict=True))])
    texts = checkpointed(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), *[F.max(k).alias(k) for k in keys]))
    met = texts.select("text_key", F.explode(F.array(*keys)).alias("k")).groupBy("k").agg(F.min("text_key").alias("lowest"), F.count(F.lit(1)).alias("n"))
    groups = _small(checkpointed(met.filter("n > 1").select("k", "lowest")), MOST_TEXTS)
    stays = F.lit(True)
    for j, k in enumerate(keys):
        texts = texts.join(groups.select(F.col("k").alias(k), F.col("lowest").alias(f"lowest{j}")), k, "left")
        stays = stays & (F.coalesce(f"lowest{j}", "text_key") == F.col("text_key"))
    texts = checkpointed(texts.select("text_key", "copies", stays.alias("stays")))
    others = texts.filter(~F.col("stays") | (F.col("copies") > 1)).select("text_key", F.when(F.col("stays"), 1 / F.col("copies")).otherwise(0.0).alias("weight"))
    return others, texts.filter("stays").count()


def lexicon(docs: DataFrame, column: str = "text") -> DataFrame:
    """term (hash) and tier: 0 inside the band, 2 above it; terms below it have no row.

    Document frequencies are exact over the near-distinct texts.
    """
    others, n = near_distinct(docs, column)
    text = F.col(column)
    weighed = docs.select(text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key")).join(_small(others, MOST_TEXTS), "text_key", "left")
    weighed = weighed.select("text", F.coalesce("weight", F.lit(1.0)).alias("weight")).filter("weight > 0")
    terms = weighed.select("weight", F.explode(F.array_distinct(words_of(F.col("text")))).alias("t")).select("weight", F.xxhash64("t").alias("term"))
    low, high = max(2, round(LEAST_SHARE * n)), max(2, int(MOST_SHARE * n))
    df = terms.groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("df")).filter(F.col("df") >= low)
    return checkpointed(df.select("term", F.when(F.col("df") > high, 2).otherwise(0).alias("tier")))


def with_tiers(spread: DataFrame, words: DataFrame) -> DataFrame:
    """Adds each term's tier; null where the lexicon has no row.

    The lexicon is broadcast up to ``MOST_TERMS`` rows.  Beyond, only the terms
    above the band are, if they are as few, which is likely as each is in many
    texts; the others meet the band in a shuffle.  ``spread`` has no texts, only
    hashes, and a null term stands for a text without words.
    """
    if words.count() <= MOST_TERMS:
        return spread.join(F.broadcast(words), "term", "left")
    met = spread.join(_small(words.filter("tier = 2"), MOST_TERMS), "term", "left")
    settled = F.col("tier").isNotNull() | F.col("term").isNull()
    rest = met.filter(~settled).drop("tier").join(words.filter("tier = 0"), "term", "left")
    return met.filter(settled).unionByName(rest)


def _cell(entry: Column, level: int) -> Column:
    """The subset of a level that a term is in: bits of its hash that no other level uses."""
    shift = sum(bits for bits, _ in LEVELS[:level])
    return F.shiftrightunsigned(entry, shift).bitwiseAND(F.lit((1 << LEVELS[level][0]) - 1))


def _with_parts(df: DataFrame, entries: str, whole: str, out: str) -> DataFrame:
    """Adds ``out``, the part hashes of a sorted array of entries: the whole lexicon, then each subset.

    0 where a subset has none of the terms; ``whole`` stands in for the first
    part where the lexicon has none.
    """

    def hashed(terms: Column) -> Column:
        return F.when(F.size(terms) > 0, F.xxhash64(terms)).otherwise(F.lit(0).cast("long"))

    def within(i: int, least: int, end: int):
        return lambda e: (_cell(e, i) >= least) & (_cell(e, i) < end)

    def in_subset(i: int, k: int):
        return lambda e: _cell(e, i) == k

    # Columns of their own: a level's terms are found once, then those of each group of subsets, and a subset filters its group alone.
    own = {f"__{out}_{i}": F.filter(entries, within(i, 0, n)) if n < 1 << bits else F.col(entries) for i, (bits, n) in enumerate(LEVELS)}
    df, groups = df.withColumns(own), {}
    for i, (c, (_, n)) in enumerate(zip(own, LEVELS, strict=True)):
        width = n // GROUPS
        groups |= {f"{c}_{g}": F.filter(c, within(i, g * width, (g + 1) * width)) for g in range(GROUPS)}
    df = df.withColumns(groups)
    parts = [F.when(F.size(entries) > 0, F.xxhash64(entries)).otherwise(F.col(whole))]
    for i, (c, (_, n)) in enumerate(zip(own, LEVELS, strict=True)):
        parts += [hashed(F.filter(f"{c}_{k * GROUPS // n}", in_subset(i, k))) for k in range(n)]
    own |= groups
    return df.withColumn(out, F.array(*parts)).drop(*own)


def _shown(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal parts as a share of those that either fingerprint has, on one level.

    The level is the sparsest with ``LEAST_PARTS`` of them, else the densest; if
    neither text has a term on it, only the first parts tell: 1 if equal, else 0.
    """
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(0)).when(x == y, F.lit(2)).otherwise(F.lit(1)))
    at, value = 2, F.when(F.get(both, F.lit(0)) == 2, F.lit(1.0)).otherwise(F.lit(0.0))
    for i, (_, n) in enumerate(LEVELS):
        own = F.slice(both, at, n)
        some, equal = F.size(F.filter(own, lambda x: x > 0)), F.size(F.filter(own, lambda x: x == 2))
        value = F.when(some >= (LEAST_PARTS if i else 1), equal / some).otherwise(value)
        at += n
    return value.cast("double")


def _in_order(docs: DataFrame, text: Column) -> DataFrame:
    """Rows dealt into ranges of doc_id: at, border, doc_id, text.

    Each range also gets, as border rows, the first document that comes after it
    in descending doc_id; behind the last range comes the very first document.
    """
    rows = docs.select("doc_id", text.alias("text"))
    n = rows.count()
    ranges = min(MOST_RANGES, max(1, n // RANGE_ROWS))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges).alias("c")).first()["c"] or []
    cuts = sorted({*cuts})
    steps = [1 << i for i in range(len(cuts).bit_length())][::-1]
    if cuts:
        table = F.array(*[F.lit(c) for c in cuts]) if len(cuts) < 2 else F.from_json(F.lit(str(cuts)), "array<bigint>")

        def further(at: Column, step: Column) -> Column:
            to = at + step
            return F.when((to <= len(cuts)) & (F.coalesce(F.get(table, to - 1), F.lit(2**63 - 1)) <= F.col("doc_id")), to).otherwise(at)

        at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)
    else:
        at = F.lit(0)
    rows = rows.withColumn("at", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at).cast("int"))
    tops = sorted(tuple(r) for r in rows.groupBy("at").agg(F.max("doc_id").alias("top")).collect())  # at most MOST_RANGES rows
    follows = [(tops[i - 1][1], tops[i][0]) for i in range(len(tops))]  # i - 1 = -1: behind the last comes the first
    kind = dict(docs.dtypes)["doc_id"]
    targets = docs.sparkSession.createDataFrame(follows, f"doc_id {kind}, target int") if follows else None
    own = rows.withColumn("border", F.lit(0))
    if targets is None:
        return own
    joined = rows.alias("r").join(F.broadcast(targets.alias("t")), F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")))
    return own.unionByName(joined.select("r.doc_id", "r.text", F.col("t.target").alias("at"), F.lit(1).alias("border")))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text keeps all but the last floor(n / 2) code points and goes on
    with as many of the next document in descending doc_id (all, if it is
    shorter; after the last document comes the first).  Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty.  A text without a word is fingerprinted as a whole, so equal texts always have equal fingerprints.  Rows that share a
    doc_id follow each other in the order of their texts; null doc_ids come last.
    A single row is its own next.  doc_id is an integer.  Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = lexicon(docs)
    order = W.partitionBy("at").orderBy("border", F.desc_nulls_last("doc_id"), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    placed = _in_order(docs, text).select("at", "border", "doc_id", "text", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next"))
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.coalesce(F.col("next"), F.lit("")).substr(F.lit(1), half))
    placed = placed.select("at", "border", "doc_id", "row", "text", edited.alias("edited"))
    sides = [F.struct(F.lit(i).alias("version"), F.col(c).alias("text")) for i, c in enumerate(("text", "edited"))]
    versions = placed.select("at", "row", "border", "doc_id", n.cast("long").alias("n_chars"), F.explode(F.array(*sides)).alias("v"))
    versions = versions.select("at", "row", "border", "doc_id", "n_chars", "v.version", F.col("v.text").alias("side"))
    spread = versions.select("*", F.posexplode_outer(F.array_distinct(words_of(F.col("side")))).alias("pos", "t"))
    # A term's row has hashes in place of texts, whichever way it meets the lexicon; those of the whole text stand on its first row.
    lead_row = F.coalesce("pos", F.lit(0)) == 0
    spread = spread.select(
        "at", "row", "border", "doc_id", "n_chars", "version", F.when(F.col("t").isNotNull(), F.xxhash64("t")).alias("term"),
        F.when(lead_row, F.xxhash64("side", F.lit("no term"))).alias("whole"),
        F.when(lead_row & (F.col("version") == 1), F.sha2(F.col("side").cast("binary"), 256)).alias("sha"),
    )
    entry = F.shiftleft(F.coalesce("tier", F.lit(1)).cast("long"), TERM_BITS).bitwiseOR(F.col("term").bitwiseAND(F.lit((1 << TERM_BITS) - 1)))
    kept = with_tiers(spread, words).select("at", "row", "border", "doc_id", "n_chars", "version", entry.alias("entry"), "whole", "sha")
    of_tier = lambda first: lambda e: F.shiftright(e, TERM_BITS) == F.shiftright(first, TERM_BITS)
    of = lambda i, c: F.when(F.col("version") == i, F.col(c))
    gathered = kept.groupBy("at", "row").agg(
        F.max("border").alias("border"), F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        F.array_sort(F.collect_list(of(0, "entry"))).alias("e0"), F.array_sort(F.collect_list(of(1, "entry"))).alias("e1"),
        F.max(of(0, "whole")).alias("w0"), F.max(of(1, "whole")).alias("w1"),
    )
    # Entries of the lowest tier that the text has.
    gathered = gathered.withColumns({c: F.filter(c, of_tier(F.get(c, F.lit(0)))) for c in ("e0", "e1")})
    parts = _with_parts(_with_parts(gathered, "e0", "w0", "f0"), "e1", "w1", "f1").drop("e0", "w0", "e1", "w1")
    following = F.lead("f0").over(W.partitionBy("at").orderBy("row"))
    return (
        parts.withColumn("f2", following)
        .filter("border = 0")
        .select(
            "doc_id", "n_chars", "edited_sha256", _shown(F.col("f0")).alias("fingerprint"), _shown(F.col("f1")).alias("edited_fingerprint"),
            likeness(F.col("f0"), F.col("f1")).alias("near_edited"), likeness(F.col("f0"), F.col("f2")).alias("near_next"),
        )
    )
