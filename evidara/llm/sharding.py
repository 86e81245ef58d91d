"""Sharding: minimax contiguous partition of ordered atomic groups of equal texts.

Groups are ordered by the hash of their text and summed in cells, which are
ranges of the hash.  The smallest capacity is bracketed: cells taken as whole
give a capacity that suffices, cells taken as divisible one that is necessary.
Only cells in which a cut may fall are split further, until both agree; the
cuts are then those of the exact minimax over the groups themselves.

Everything that touches rows is DataFrame work.  The driver sees tables of
proven size only: at most ``shards`` oversize groups, ``2 ** FIRST_BITS`` cells,
and in each round the parts of the few cells around a cut.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.llm.runtime import checkpointed

ROW_OVERHEAD = 16
#: Leading bits of the hash that tell the first cells, and bits by which a cell is split.
FIRST_BITS, MORE_BITS = 14, 4


def feasible_cuts(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Greedy check: the cut positions if ``capacity`` suffices for ``shards``, else None."""
    cuts, filled = [], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if filled + size > capacity:
            cuts.append(i)
            filled = 0
            if len(cuts) >= shards:
                return None
        filled += size
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the smallest capacity that the greedy check accepts."""
    low, high = max([0, *sizes]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if feasible_cuts(sizes, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cut positions of a contiguous partition whose largest shard is smallest.

    Among the partitions with that capacity each cut is the one nearest to an
    even share of what is left, provided that the rest still fits.
    """
    capacity, ends, n = smallest_capacity(sizes, shards), [0, *accumulate(sizes)], len(sizes)
    need = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[max(i + 1, bisect_right(ends, ends[i] + capacity) - 1)]
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        furthest = bisect_right(ends, ends[at] + capacity) - 1
        want = ends[at] + (ends[n] - ends[at]) / (left + 1)
        i = min(bisect_right(ends, want) - 1, furthest)
        if i < furthest and ends[i + 1] - want < want - ends[i]:
            i += 1
        i = max(i, at)
        while need[i] > left and i < furthest:
            i += 1
        cuts.append(i)
        at = i
    return cuts


class Cells:
    """Ordered ranges of the hash: (bits, prefix) of each, its bytes and whether it is a single group."""

    def __init__(self, cells: list[tuple[int, int, int, int]]):
        self.cells = sorted(cells, key=lambda c: c[1] << (64 - c[0]))  # bits, prefix, bytes, groups
        self.ends = [0, *accumulate(c[2] for c in self.cells)]
        self.whole = [c[3] == 1 for c in self.cells]

    def greedy(self, shards: int, capacity: int, divisible: bool) -> tuple[list[int], bool]:
        """Furthest cuts in bytes from the start, and whether ``shards`` hold everything."""
        at, cuts, ends = 0, [], self.ends
        for _ in range(shards):
            to = at + capacity
            if to >= ends[-1]:
                return cuts, True
            i = bisect_right(ends, to) - 1
            if ends[i] < to and (self.whole[i] or not divisible):
                to = max(ends[i], at)
            cuts.append(to)
            at = to
        return cuts, False

    def least(self, shards: int, divisible: bool) -> int:
        """Smallest capacity of the whole or the divisible cells."""
        low, high = -(-self.ends[-1] // shards), self.ends[-1]
        while low < high:
            middle = (low + high) // 2
            if self.greedy(shards, middle, divisible)[1]:
                high = middle
            else:
                low = middle + 1
        return low

    def undecided(self, shards: int) -> list[int]:
        """Numbers of the cells to split: those with several groups in which a cut of the optimum may fall."""
        low, high = self.least(shards, True), self.least(shards, False)
        if low == high:
            return []
        first, last = self.greedy(shards, low, False)[0], self.greedy(shards, high, True)[0]
        found: set[int] = set()
        for k, start in enumerate(first):
            stop = last[k] if k < len(last) else self.ends[-1]
            found.update(range(max(0, bisect_right(self.ends, start) - 1), min(len(self.cells), bisect_left(self.ends, stop))))
        return sorted(i for i in found if not self.whole[i])

    def split(self, at: list[int], parts: list[tuple[int, int, int, int]]) -> Cells:
        gone = set(at)
        return Cells([c for i, c in enumerate(self.cells) if i not in gone] + parts)


def exact_cells(groups: DataFrame, shards: int, first_bits: int | None = None) -> Cells:
    """Cells of ``groups`` (h, bytes) fine enough around every cut for the exact minimax."""

    def sums(df: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        prefix = F.shiftright("h", 64 - bits).alias("prefix")
        return [(bits, r["prefix"], r["bytes"], r["n"]) for r in df.groupBy(prefix).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()]

    spark = groups.sparkSession
    found = Cells(sums(groups, first_bits or FIRST_BITS))
    while at := found.undecided(shards):
        parts = []
        for bits in sorted({found.cells[i][0] for i in at}):
            own = spark.createDataFrame([(found.cells[i][1],) for i in at if found.cells[i][0] == bits], "cell long")
            inside = groups.join(F.broadcast(own), F.shiftright("h", 64 - bits) == F.col("cell"), "left_semi")  # cells around the cuts
            parts += sums(inside, min(64, bits + MORE_BITS))
        found = found.split(at, parts)
    return found


def _step(first_of: list[int], base: int) -> Column:
    """base + the number of cuts at or before the row's hash."""
    out = F.lit(base)
    for first in first_of:
        out = out + (F.col("h") >= F.lit(first).cast("long")).cast("int")
    return out


def shard_documents(docs: DataFrame, shards: int = 40, blocks: int = 256) -> DataFrame:
    """Deal all rows into ``shards`` of nearly equal bytes, equal texts together.

    Equal texts form an atomic group; groups are ordered by their hash.  A group
    above an even share gets a shard of its own, since no cut can split it, and
    the minimax search divides the rest among the shards that remain.  With
    fewer groups than shards some shards stay empty.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.  A null
    text counts as no bytes (size 16, crc 0, in the group of the empty text); a
    null doc_id is kept.  Repeated rows each keep their slot; an empty table
    gives none.  Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = checkpointed(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        )
    )
    by_group = checkpointed(slim.groupBy("h").agg(F.sum("size").alias("bytes")))
    total = by_group.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("t")).first()["t"]
    largest = [tuple(r) for r in by_group.orderBy(F.desc("bytes"), "h").limit(shards).collect()]
    alone: list[int] = []
    for h, size in largest:
        left = shards - len(alone)
        if left <= 1 or size * left <= total:
            break
        alone.append(h)
        total -= size
    cells = exact_cells(by_group.filter(~F.col("h").isin(alone)) if alone else by_group, shards - len(alone))
    cuts = minimax_cuts([c[2] for c in cells.cells], shards - len(alone)) if cells.cells else []
    # A cut behind the last cell starts no row's shard.
    first_of = [cells.cells[i][1] << (64 - cells.cells[i][0]) for i in cuts if i < len(cells.cells)]
    shard = _step(first_of, len(alone))
    for i, h in enumerate(alone):
        shard = F.when(F.col("h") == F.lit(h), F.lit(i)).otherwise(shard)
    placed = slim.select(
        "*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)).cast("int").alias("block")
    )
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "block"])  # at most shards * blocks rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
