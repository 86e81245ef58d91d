"""N-gram Jaccard join: a size-aware heavy-light join over shingle sets.

Two sets of sizes s and s' reach the Jaccard threshold exactly if they share
c(s, s') = ceil(t / (1 + t) * (s + s')) shingles.

* Light sets (up to a boundary): every subset of c(s, s') shingles is a bucket
  key.  Sets that meet in a bucket share that subset, so they are linked with
  nothing left to verify, and a bucket of any size gives one edge a member.
* Heavy sets: the inverted lists of their rarest shingles are scanned (with s -
  c + 1 of them no link is missed).  A list is first tied to its least member,
  by verified pairs, one a member; only pairs between different components that
  are still open are then verified one by one.

The boundary is the one of least cost under the counted sizes.  A node is a
distinct set, named by a number of its own, so copies cost nothing beyond one
aggregate, and texts that share a doc_id keep their own links.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.llm.components import connected_components
from evidara.llm.runtime import TEXT_KEYS, checkpointed, giving_back, mix64, small, to_signed, with_text_keys

#: Frequent shingles whose counts order the rest by rarity, at most: a fixed size, whatever the corpus.
FREQUENT_SHINGLES = 1 << 20
#: Shingles that a task counts exactly at a time.
COUNTED_AT_ONCE = 2_000_000
#: Relative cost of one heavy key: it is shuffled, tied and may be verified.
HEAVY_KEY_COST = 4.0
#: A light bucket key also names its two sizes, as smaller * PAIR + larger.
PAIR = 1000
_NONE = np.empty(0, np.int64)

_P = np.uint64(0x9E3779B97F4A7C15)
_RANGES = np.arange(64, dtype=np.uint64) << np.uint64(58)
#: Rows that may be broadcast to pick texts or to split hubs; with more the join shuffles.
MOST_BROADCAST_IDS = 1 << 17
#: Numbers of rows that are copies of another's set that may be broadcast.
MOST_OTHERS = 1 << 20
#: Pairs of one end, and members of one open list, that a task takes at a time.
HUB_PAIRS, LIST_BLOCK = 256, 512
#: Rarity level (a half octave) from which a shingle's list is split over tasks: 4096 occurrences.
HOT_LEVEL = 24


class _WordHashes(dict):
    """Word bytes -> 64-bit hash, filled as words appear; emptied when it grows."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_runs(texts: list[str | None], width: int, hashes: dict, most_words: int = 200_000):
    """Yields a list of hash arrays, one a text, not yet distinct, for runs of whole texts.

    A-Z are lower-cased and ASCII white space separates words.  Fewer words than
    ``width`` form one shingle; no text or no word gives an empty array.  A run
    has about ``most_words`` words, or one longer text.
    """
    run: list[list[bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        run.append(words)
        held += len(words)
        if held >= most_words or i == len(texts) - 1:
            yield _hash_run(run, held, width, hashes)
            run, held = [], 0


def _slices(column: pa.Array, rows: int = 1000):
    """A column's values as lists of few rows, so that only those stand in Python at once."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def _hash_run(run: list[list[bytes]], held: int, width: int, hashes: dict) -> list[np.ndarray]:
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(run)), np.uint64, held)
    n = max(0, held - width + 1)
    full = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            full = mix64(full * _P + h[j : j + n])
    out, at = [], 0
    for words in run:
        if len(words) >= width:
            out.append(full[at : at + len(words) - width + 1])
        else:
            short = np.full(min(1, len(words)), len(words), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(len(words)):
                    short = mix64(short * _P + h[at + j])
            out.append(short)
        at += len(words)
    return out


def distinct(found: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    found = np.sort(found)
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def repeated(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values that stand more than once in arrays, sorted, and how often; beside one sorted copy, only they take memory."""
    found = np.concatenate(held)
    found.sort()
    same = np.zeros(len(found) + 1, bool)
    same[1:-1] = found[1:] == found[:-1]  # as the value before
    first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
    return found[first], last - first + 1


def shingle_set(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of one whole text."""
    return distinct(next(shingle_runs([text], width, hashes))[0])


def profile(found: np.ndarray) -> bytes:
    """How many shingles fall into each of 64 ranges of the hash.

    The profiles of two sets differ by at most the sets' own difference, so a
    pair whose profiles differ by more than a link allows is none.
    """
    return np.minimum(np.diff(np.searchsorted(found, _RANGES), append=len(found)), 65535).astype(np.uint16).tobytes()


class Overlap:
    """Exact integer arithmetic of a Jaccard threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def needed(self, a: int, b: int) -> int:
        """Least overlap of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def least(self, a: int) -> int:
        return -(-self.num * a // self.den)

    def most(self, a: int) -> int:
        return self.den * a // self.num

    def prefix(self, a: int) -> int:
        """Any linked partner shares at least ``least(a)``, so one of so many of them."""
        return a - self.least(a) + 1

    def subsets(self, a: int) -> int:
        """Bucket keys of a light set of size a."""
        return sum(comb(a, self.needed(a, b)) for b in range(self.least(a), self.most(a) + 1))


def choose_boundary(sizes: dict[int, int], overlap: Overlap) -> int:
    """Largest light size: the one of least total cost over the counted sizes.

    The search ends where the light keys alone cost more than the best so far.
    """
    best, at = None, 0
    for boundary in range(PAIR):
        light = sum(n * overlap.subsets(s) for s, n in sizes.items() if 0 < s <= boundary)
        if best is not None and light > best:
            break
        heavy = sum(n * overlap.prefix(s) for s, n in sizes.items() if overlap.most(s) > boundary)
        cost = light + HEAVY_KEY_COST * heavy
        if best is None or cost < best:
            best, at = cost, boundary
    return at


def _statistics(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Frequent shingles (sorted) with their levels, and documents by number of shingles.

    All shingles of all documents are counted; those that a task meets once
    among millions are left at level 0.  The levels only set the order in which
    prefixes are taken, and any fixed order gives the same links.
    """

    def count(batches):
        hashes, sizes, held, n = _WordHashes(), Counter(), [], 0

        def counted():
            keys, counts = repeated(held)
            keys = to_signed(keys)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), np.int32)), pa.array(keys), pa.array(counts)], ["kind", "key", "n"])

        for batch in batches:
            for run in chain.from_iterable(shingle_runs(texts, width, hashes) for texts in _slices(batch.column(0))):
                sizes.update(map(len, run))
                held += run
                n += sum(map(len, run))
                if n >= COUNTED_AT_ONCE:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()
        keys, counts = np.fromiter(sizes.keys(), np.int64, len(sizes)), np.fromiter(sizes.values(), np.int64, len(sizes))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.array(keys), pa.array(counts)], ["kind", "key", "n"])

    rows = checkpointed(docs.select("text").mapInArrow(giving_back(count), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    level = (F.floor(F.log2(F.col("n").cast("double")) * 2)).cast("int")
    found = rows.filter("kind = 0 AND n > 3")
    by_level = {r["level"]: r["n"] for r in found.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = 0, 0
    for at in sorted(by_level, reverse=True):
        total += by_level[at]
        if total > FREQUENT_SHINGLES:
            least = at + 1
            break
    frequent = found.filter(level >= least).select("key", level.alias("level")).toArrow()
    keys = frequent.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    sizes = {r["key"]: r["n"] for r in rows.filter("kind = 1").collect()}
    return keys[order], np.minimum(frequent.column("level").to_numpy()[order], 63).astype(np.uint64), sizes


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as one Arrow list column."""
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int64), kind))


def _leveled(found: np.ndarray, frequent: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as keys that sort by rarity: the level on top of 58 bits of the hash."""
    keys = found & np.uint64((1 << 58) - 1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        keys |= np.where(frequent[at] == found, levels[at], np.uint64(0))
    return keys


def _signatures(docs: DataFrame, width: int, overlap: Overlap, boundary: int, frequent: np.ndarray, levels: np.ndarray) -> DataFrame:
    """A row per document: doc_id, text keys, n, set signature s1 and s2, profile, heavy keys and light keys.

    A heavy key is a shingle under its order: the rarity level on top of 58 bits
    of its hash.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, levels << np.uint64(58)))
    kind = dict(docs.dtypes)["doc_id"]

    def sign(batches):
        (frequent, levels), hashes = shared.value, _WordHashes()
        for batch in batches:
            at = 0
            for run in chain.from_iterable(shingle_runs(texts, width, hashes) for texts in _slices(batch.column(3))):
                n, s1, s2, profiles, heavy, light, pair = [], [], [], [], [], [], []
                sets = [distinct(found) for found in run]
                ranked = _leveled(np.concatenate(sets), frequent, levels)
                begin = 0
                for found in sets:
                    size = len(found)
                    begin += size
                    digest = xxhash.xxh3_128_intdigest(found.tobytes())
                    n.append(size)
                    s1.append(digest & ((1 << 63) - 1))
                    s2.append(digest >> 65)
                    profiles.append(profile(found))
                    heavy.append(_NONE)
                    if size and overlap.most(size) > boundary:
                        keys = np.sort(ranked[begin - size : begin])
                        heavy[-1] = to_signed(keys[: overlap.prefix(size)])
                    keys, sizes = [], []
                    if 0 < size <= boundary:
                        values = found.tolist()
                        for other in range(overlap.least(size), min(boundary, overlap.most(size)) + 1):
                            for subset in combinations(values, overlap.needed(size, other)):
                                keys.append(xxhash.xxh3_128_digest(np.array(subset, np.uint64).tobytes()))
                                sizes.append(min(size, other) * PAIR + max(size, other))
                    light.append(keys)
                    pair.append(sizes)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(run)) for i in range(3)), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(profiles, pa.binary()), _lists(heavy, pa.int64()), pa.array(light, pa.list_(pa.binary())), pa.array(pair, pa.list_(pa.int32()))],
                    ["doc_id", *TEXT_KEYS, "n", "s1", "s2", "profile", "heavy", "light", "pair"],
                )
                at += len(run)

    return (
        with_text_keys(docs.select("doc_id", "text"))
        .select("doc_id", *TEXT_KEYS, "text")
        .mapInArrow(giving_back(sign), f"doc_id {kind}, {TEXT_KEYS[0]} long, {TEXT_KEYS[1]} long, n long, s1 long, s2 long, profile binary, heavy array<long>, light array<binary>, pair array<int>")
    )


def _joined(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Checkpointed ``pairs`` with what ``left`` has of their end a and ``right`` of b; an end of many pairs in several parts.

    Such an end's row is repeated for every ``HUB_PAIRS`` of its pairs and the
    pairs are dealt over the repeats, so no task meets a whole hub.  Few pairs are broadcast to the first side.
    """

    def split(out: DataFrame, side: str, other: str, nodes: DataFrame) -> DataFrame:
        degree = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("d")).filter(f"d > {HUB_PAIRS}")
        hubs = small(checkpointed(degree.select(side, F.ceil(F.col("d") / HUB_PAIRS).cast("int").alias("parts"))), MOST_BROADCAST_IDS)
        dealt = out.join(hubs, side, "left").withColumn("deal", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        spread = nodes.join(hubs, side, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return dealt.join(spread, [side, "deal"]).drop("deal")

    few = pairs.count() <= MOST_BROADCAST_IDS
    out = left.join(F.broadcast(pairs), "a") if few else split(pairs, "a", "b", left)
    return split(out, "b", "a", right)


def _possible(pairs: DataFrame, sets: DataFrame, overlap: Overlap) -> DataFrame:
    """The pairs (a, b) whose profiles do not rule a link out, with their other columns."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb"))
    kept = [f"{c} {t}" for c, t in pairs.dtypes]

    def check(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            pa_, pb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, 64).astype(np.int64) for c in ("pa", "pb"))
            allowed = na + nb - 2 * (-(-overlap.num * (na + nb) // (overlap.num + overlap.den)))
            yield batch.select(names).filter(pa.array(np.abs(pa_ - pb).sum(axis=1) <= allowed))

    names = pairs.columns
    return _joined(pairs, left, right).select(*names, "na", "nb", "pa", "pb").mapInArrow(giving_back(check), ", ".join(kept))


def _texts(docs: DataFrame, groups: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, text) of the nodes ``ends``, one row each: the text of the set's first document."""
    picked = checkpointed(groups.select("node", "first", "times").join(ends.distinct(), "node", "left_semi").select("node", "first.*", "times"))
    picked = picked.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", *TEXT_KEYS)}).drop("_null", "null")
    same = F.lit(True)
    for c in (*TEXT_KEYS, "doc_id"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = with_text_keys(docs.select("doc_id", "text")).join(small(picked, MOST_BROADCAST_IDS), same).select("node", "text", "times")
    if picked.filter("times > 1").isEmpty():
        return found.drop("times")
    repeated = found.filter("times > 1").groupBy("node").agg(F.first("text").alias("text"))  # equal texts all
    return found.filter("times = 1").select("node", "text").union(repeated)


def _verified(pairs: DataFrame, docs: DataFrame, groups: DataFrame, width: int, overlap: Overlap) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold."""
    pairs = pairs.select("a", "b")
    ends = {c: _texts(docs, groups, pairs.select(F.col(c).alias("node"))) for c in ("a", "b")}

    def check(batches):
        hashes, sets = _WordHashes(), {}

        def of(node, text):
            if node not in sets:
                if len(sets) > 500:
                    sets.clear()
                sets[node] = shingle_set(text, width, hashes)
            return sets[node]

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                a, b, ta, tb = (part.column(i).to_pylist() for i in range(4))
                keep = []
                for i in range(len(a)):
                    x, y = of(a[i], ta[i]), of(b[i], tb[i])
                    keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= overlap.needed(len(x), len(y)))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = _joined(pairs, ends["a"].toDF("a", "ta"), ends["b"].toDF("b", "tb"))
    return whole.select("a", "b", "ta", "tb").mapInArrow(giving_back(check), "a long, b long")


def _open_pairs(left: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): the members of one open list that are in different components and may be linked.

    Members meet only in one band of sizes or in neighbouring ones; a long list
    is dealt in blocks, each of which meets the list's other side in a task of its own.
    """
    sizes = left.groupBy("key", "band").agg(F.count(F.lit(1)).alias("m"))
    long = small(checkpointed(sizes.filter(f"m > {LIST_BLOCK}").select("key", "band", F.ceil(F.col("m") / LIST_BLOCK).cast("int").alias("blocks"))), MOST_BROADCAST_IDS)
    marked = left.join(long, ["key", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = marked.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    # The other side: each member in its own band and in the one below, once for each block there.
    y = left.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    y = y.join(long, ["key", "band"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    # n and pos are those of x, m and q those of y; within a band each pair is met twice, and once is kept.
    y = y.select("key", "band", "block", F.col("node").alias("other"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("part").alias("far"), F.col("own").alias("their"))
    need = F.ceil((F.col("n") + F.col("m")) * threshold[0] / F.lit(threshold[0] + threshold[1]))
    fits = (F.col("n") * threshold[1] >= F.col("m") * threshold[0]) & (F.col("m") * threshold[1] >= F.col("n") * threshold[0])
    once = (F.col("their") != F.col("own")) | (F.col("node") > F.col("other"))
    met = x.join(y, ["key", "band", "block"]).filter((F.col("part") != F.col("far")) & once & fits & (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("q")) >= need))
    return met.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def _numbers(docs: DataFrame):
    """A number for each row, unique once written; those of smaller doc_ids are mostly smaller.

    Lists are tied to their least member.  The earliest of near copies is the
    likeliest to be like all others, so fewer pairs stay open; which one it is
    changes only the work.
    """
    made = F.monotonically_increasing_id()
    part, row = F.shiftright(made, 33), made.bitwiseAND(F.lit((1 << 33) - 1))
    number = F.shiftleft(part, 30).bitwiseOR(row)
    fits = (part < 1 << 20) & (row < 1 << 30)
    number = F.when(fits, number).otherwise(F.raise_error(F.lit("more than 2^20 partitions, or 2^30 rows in one")).cast("long"))
    if dict(docs.dtypes)["doc_id"] not in ("bigint", "int", "smallint", "tinyint"):
        return number
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return number
    place = F.floor((F.col("doc_id").cast("double") - float(low)) / (float(high) - float(low) + 1.0) * 8000.0).cast("long")
    return F.shiftleft(F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(7999)), F.lit(8000)), 50).bitwiseOR(number)


def _components(docs: DataFrame, width: int, threshold: tuple[int, int], boundary: int | None, tie_ids: bool) -> tuple[DataFrame, DataFrame]:
    """The documents' rows with their sets (doc_id, text keys, n, s1, s2), and the sets in components.

    The second relation has s1, s2, first (the set's first document: null flag,
    doc_id, text keys), times (rows like that first one), copies (all its rows)
    and component; sets without shingles are not in it.
    """
    overlap = Overlap(*threshold)
    frequent, levels, sizes = _statistics(docs, width)
    if boundary is None:
        boundary = choose_boundary(sizes, overlap)
    rows = checkpointed(_signatures(docs, width, overlap, boundary, frequent, levels).withColumn("rid", _numbers(docs)))
    alike = rows.filter("n > 0").groupBy("s1", "s2", "doc_id", *TEXT_KEYS).agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("times"))
    this = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", *TEXT_KEYS)
    groups = checkpointed(alike.groupBy("s1", "s2").agg(F.min(F.struct(this.alias("first"), "times")).alias("f"), F.min("rid").alias("node"), F.sum("times").alias("copies")).select("s1", "s2", "node", "copies", "f.first", "f.times"))
    # One row a distinct set, that of the row which gave it its number; few others go, so the key arrays mostly stay where they are.
    others = checkpointed(rows.filter("n > 0").select("s1", "s2", F.col("rid").alias("node")).join(groups.filter("copies > 1").select("s1", "s2", F.col("node").alias("of")), ["s1", "s2"]).filter("node <> of").select("node"))
    sets = rows.filter("n > 0").select(F.col("rid").alias("node"), "n", "profile", "heavy", "light", "pair")
    if others.count() <= MOST_OTHERS:
        sets = sets.join(F.broadcast(others), "node", "left_anti")
    else:
        sets = checkpointed(sets.join(others, "node", "left_anti"))

    # Light: sets that share a bucket key are linked through its least member.
    keys = sets.select("node", "n", F.explode(F.arrays_zip("light", "pair")).alias("k")).select("node", "n", F.col("k.light").alias("key"), F.col("k.pair").alias("pair"))
    buckets = keys.groupBy("key", "pair").agg(F.min("node").alias("first"), F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("size"))
    # Both sizes must be there (or the one that pairs with itself): then the shared subset suffices.
    tied = buckets.filter(f"size > 1 AND low * {PAIR} + high = pair").select("key", "pair", "first")
    light_edges = keys.join(tied, ["key", "pair"]).select(F.col("node").alias("a"), F.col("first").alias("b")).filter("a <> b").distinct()

    # Heavy: inverted lists of the rarest shingles, in bands of size that links span at most one step of.
    step = float(np.log(threshold[1] / threshold[0]))
    packed = F.shiftleft("n", 32).bitwiseOR(F.col("pos")).alias("n_pos")
    every = sets.select("node", "n", F.posexplode("heavy").alias("pos", "key")).select("key", "node", packed)
    n = F.shiftright("n_pos", 32)
    band = F.floor(F.log(n.cast("double")) / F.lit(step)).cast("int")
    # One shuffle by shingle finds those of one set only and each list's heads (its least member
    # in a row's own band and in the one below).  Frequent shingles, whose lists may be
    # long, are kept unseen: their level tells them, and a list of one gives no pair.
    hot = F.shiftrightunsigned("key", 58) >= HOT_LEVEL
    by_key = W.partitionBy("key")
    listed = every.filter(~hot).withColumn("size", F.count(F.lit(1)).over(by_key)).filter("size > 1").withColumns({"n": n, "band": band})
    heads = {"h1": by_key.orderBy("band").rangeBetween(0, 0), "h0": by_key.orderBy("band").rangeBetween(-1, -1)}
    listed = listed.withColumns({h: F.min(F.struct("node", "n")).over(w) for h, w in heads.items()})

    def near(h: str):
        m = F.col(f"{h}.n")
        fits = (F.col("n") * threshold[1] >= m * threshold[0]) & (m * threshold[1] >= F.col("n") * threshold[0])
        return F.when((F.col(f"{h}.node") != F.col("node")) & fits, F.col(f"{h}.node")).alias(h)

    none = F.lit(None).cast("long")
    kept = checkpointed(listed.select("key", "node", "n_pos", near("h1"), near("h0")).unionByName(every.filter(hot).withColumns({"h1": none, "h0": none})))
    lists = kept.select("key", "node", n.alias("n"), F.col("n_pos").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), band.alias("band"))
    own = kept.filter(~hot).select("node", F.explode(F.array("h1", "h0")).alias("b")).filter("b IS NOT NULL")
    # Long lists meet their heads in a join instead, which Spark can split.
    long = lists.filter(hot)
    head = long.groupBy("key", "band").agg(F.min(F.struct("node", "n")).alias("h1")).select("key", "band", "h1")
    head = head.union(head.withColumn("band", F.col("band") + 1))
    own = own.union(long.join(head, ["key", "band"]).select("node", near("h1")).filter("h1 IS NOT NULL"))
    tries = own.groupBy(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    tries = checkpointed(_possible(checkpointed(tries), sets, overlap))
    # First one pair a document, that of most common lists; it mostly joins a whole group.
    best = checkpointed(tries.groupBy("a").agg(F.max(F.struct("common", "b")).alias("best")).select("a", "best.b"))
    edges = _verified(best, docs, groups, width, overlap).union(light_edges)
    if tie_ids:
        several = alike.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).filter("x <> y")
        several = checkpointed(several.select("doc_id", F.col("x.s1").alias("x1"), F.col("x.s2").alias("x2")))
        if not several.isEmpty():
            named = groups.select("s1", "s2", "node")
            first = several.join(named.toDF("x1", "x2", "b"), ["x1", "x2"]).select("doc_id", "b")
            edges = edges.union(alike.select("s1", "s2", "doc_id").join(first, "doc_id").join(named, ["s1", "s2"]).select(F.col("node").alias("a"), "b"))
    edges = checkpointed(edges)
    parts = connected_components(edges)

    # What is still open: pairs of a list whose documents are in different components.
    member = lists.join(small(parts, MOST_BROADCAST_IDS), "node", "left").select("node", "n", "pos", "key", "band", F.col("band").alias("own"), F.coalesce("component", "node").alias("part"))
    open_keys = member.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
    left = checkpointed(member.join(open_keys, "key", "left_semi"))
    pairs = checkpointed(_open_pairs(left, threshold).join(best, ["a", "b"], "left_anti"))
    pairs = checkpointed(_possible(pairs, sets, overlap))
    if not pairs.isEmpty():
        more = checkpointed(_verified(pairs, docs, groups, width, overlap))
        if not more.isEmpty():
            stars = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
            parts = connected_components(stars.union(more))
    return rows.select("doc_id", *TEXT_KEYS, "n", "s1", "s2"), groups.join(parts, "node", "left").select("s1", "s2", "first", "times", "copies", F.coalesce("component", "node").alias("component"))


def near_duplicate_components(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (8, 10), boundary: int | None = None) -> DataFrame:
    """Components of the documents whose shingle sets reach a Jaccard similarity.

    ``docs`` needs doc_id and text; other columns are not read.  Returns doc_id,
    n_shingles and component_id, the least doc_id that links reach, itself
    included; one row per row.  A null or empty text has no shingles and is
    linked with nothing; fewer words than ``width`` are one shingle.  Texts that
    share a doc_id keep the links of each and are one document, so they are in
    one component.  Rows with a null doc_id are documents of their own that
    others are linked through; component_id is null where all of a component's are.
    ``boundary`` overrides the cost-based choice (tests).
    """
    rows, found = _components(docs, width, threshold, boundary, tie_ids=True)
    found = checkpointed(found)
    # A set of one row that stands alone tells nothing that its row does not.
    least = found.groupBy("component").agg(F.min("first.doc_id").alias("component_id"), F.sum("copies").alias("all")).filter("all > 1")
    shared = found.join(small(checkpointed(least.select("component", "component_id")), MOST_BROADCAST_IDS), "component").select("s1", "s2", "component_id")
    return (
        rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("s1")).alias("s1"), "s2")
        .join(shared, ["s1", "s2"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (8, 10)) -> tuple[DataFrame, DataFrame]:
    """The rows to drop so that one of each component stays, by doc_id and text keys; and those kept that repeat.

    Rows are told apart by doc_id and text, also where doc_ids repeat or are
    null.  The row of least doc_id (null ones last) and then text key stays.  Rows that
    equal in both are given in the second relation if they are the ones to
    keep: one of them stays.  Rows without shingles are linked with nothing.
    """
    rows, found = _components(docs, width, threshold, None, tie_ids=False)
    found = checkpointed(found)
    keep = found.groupBy("component").agg(F.min(F.struct("first", "times")).alias("k"), F.sum("copies").alias("all")).filter("all > 1")
    keep = checkpointed(keep.select("component", F.col("k.first").alias("keep"), F.col("k.times").alias("keep_times")))
    # The row of a set of one row that stands alone stays.
    of_set = found.join(small(keep, MOST_BROADCAST_IDS), "component").select("s1", "s2", "keep")
    mine = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", *TEXT_KEYS)
    gone = rows.filter("n > 0").join(of_set, ["s1", "s2"]).filter(~mine.eqNullSafe(F.col("keep"))).select("doc_id", *TEXT_KEYS).distinct()
    repeats = keep.filter("keep_times > 1").select("keep.doc_id", *[f"keep.{c}" for c in TEXT_KEYS])
    return checkpointed(gone), checkpointed(repeats)
