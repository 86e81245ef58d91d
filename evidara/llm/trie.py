"""Conversation prefix trie: chained digests of every prefix, one node for each (depth, digest).

A turn becomes the SHA-256 of its role and text; the digests of a
conversation's prefixes chain those of its turns.  Conversations of any length
are chained in blocks: turns within a block, then the digests of whole blocks
in the same way, so no task ever walks through one whole conversation.  All
conversations with an equal prefix meet in a node, named by its smallest
member.  As members only leave on the way down, the nodes named after one
conversation are a run of its own path; a conversation's own run hangs below
runs of others.  Sums over subtrees therefore explode each run, instead of each
of its nodes, to all runs above it, which never makes more rows than there are
turns, and add up from the deep end within a run.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.llm.runtime import checkpointed, shuffle_width

#: Turns chained one after the other in one group; longer conversations chain the digests of such blocks.
BLOCK_TURNS = 256
#: Nodes of one run that one window adds up; longer runs add the totals of such blocks.
BLOCK_NODES = 4096
#: Characters of member ids that are put together before they meet the rest of their node's.
CHUNK_CHARS = 1 << 16
#: Fork rule of ``forked``: conversations share the opening turns of the first of their hundred.
FORK_GROUP, FORK_MODULUS = 100, 6


class Trie(NamedTuple):
    """nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    ends: conv_id, depth (of the node), member (a conversation that ends there)."""

    nodes: DataFrame
    ends: DataFrame


def _changes(column: pa.Array, last) -> np.ndarray:
    """Where a sorted column differs from the value before, which for the first row is ``last``."""
    new = np.ones(len(column), bool)
    new[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    new[0] = last is None or column[0].as_py() != last
    return new


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, place (from 1), item (digest), n_chars; and conv_id, n_turns.

    Turns stand by ``turn``, nulls first, ties by their digest; null roles and
    texts count as empty.  Rows without a conv_id belong to no conversation and
    stay out.  Rows are dealt by ranges of the sort key, so that one
    conversation may lie in any number of tasks; a task numbers its own rows,
    and the counts of the parts before are added.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    item = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", item.alias("item"), F.length(text).cast("long").alias("n_chars"))
    order = ["conv_id", F.asc_nulls_first("turn"), "item"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "item", "n_chars", F.spark_partition_id().alias("part"))

    def number(batches):
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.arange(batch.num_rows)
            new = _changes(batch.column(0), last)
            first = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(first < 0, at + 1 + held, at - first + 1)
            last, held = batch.column(0)[-1].as_py(), int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])

    kind = dict(dealt.dtypes)["conv_id"]
    held = checkpointed(dealt.mapInArrow(number, f"conv_id {kind}, item binary, n_chars long, part int, place long"))
    parts = held.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    convs = checkpointed(parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")))
    # A part has at most one conversation that began in an earlier one: no more rows than parts.
    split = convs.filter(F.size("parts") > 1).select("conv_id", F.posexplode("parts").alias("i", "p"), "parts").filter("i > 0")
    before = F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    offsets = F.broadcast(split.select("conv_id", F.col("p.part").alias("part"), before.alias("before")))
    placed = held.join(offsets, ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "item", "n_chars")
    return placed, convs.select("conv_id", "n_turns")


def forked(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns of conversations that open with turns of the first of their hundred: conv_id, depth, item, n_chars.

    Conversation c takes the first crc32(c) % 6 turns of c - c % 100 (fewer or
    none if that has fewer), then its own turns after as many.
    """
    group = F.pmod(F.col("conv_id"), F.lit(FORK_GROUP))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(FORK_MODULUS))
    own = convs.select("conv_id", "n_turns", taken.alias("taken"), (F.col("conv_id") - group).alias("base"))
    sizes = convs.filter(group == 0).select(F.col("conv_id").alias("base"), F.col("n_turns").alias("there"))
    shifted = own.join(sizes, "base", "left").withColumn("shift", F.col("taken") - F.least("taken", F.coalesce("there", F.lit(0))))
    # Dealt by blocks of places, a conversation of any length meets its shift in many tasks.
    block = F.floor(F.col("place") / BLOCK_NODES).cast("long")
    blocks = shifted.select("conv_id", "taken", "shift", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_turns") / BLOCK_NODES).cast("long"))).alias("block"))
    rest = turns.withColumn("block", block).join(blocks, ["conv_id", "block"]).filter("place > taken").select("conv_id", (F.col("place") - F.col("shift")).alias("depth"), "item", "n_chars")
    opening = turns.filter((group == 0) & (F.col("place") < FORK_MODULUS)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "item", "n_chars")
    heads = own.filter("taken > 0").select("conv_id", "base", "taken").join(opening, "base").filter("depth <= taken").select("conv_id", "depth", "item", "n_chars")
    return rest.unionByName(heads)


def prefix_digests(turns: DataFrame, longest: int, block: int = BLOCK_TURNS) -> DataFrame:
    """Adds digest, that of the conversation's turns up to each, to conv_id, depth (from 1), item and other columns.

    Equal sequences of items have equal digests, whatever their conversation's length.
    """
    rows = turns.withColumn("block", F.floor((F.col("depth") - 1) / block).cast("long"))
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "depth")
    names = rows.columns
    conv, place, item = (names.index(c) for c in ("conv_id", "block", "item"))

    def chain(batches):
        last, so_far = None, b""
        for batch in batches:
            out = []
            for mark, own in zip(zip(batch.column(conv).to_pylist(), batch.column(place).to_pylist(), strict=True), batch.column(item).to_pylist(), strict=True):
                so_far = hashlib.sha256((so_far if mark == last else b"") + own).digest()
                last = mark
                out.append(so_far)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "inner"])

    chained = rows.mapInArrow(chain, ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("inner", "binary")])).drop("item")
    if longest <= block:
        outer = chained.withColumn("outer", F.lit(b""))
    else:
        chained = checkpointed(chained)
        whole = chained.filter(F.col("depth") % block == 0).select("conv_id", (F.col("block") + 1).alias("depth"), F.col("inner").alias("item"))
        above = prefix_digests(whole, longest // block, block).select("conv_id", F.col("depth").alias("block"), F.col("digest").alias("outer"))
        outer = chained.join(above, ["conv_id", "block"], "left").withColumn("outer", F.coalesce("outer", F.lit(b"")))
    return outer.withColumn("digest", F.unhex(F.sha2(F.concat("outer", "inner"), 256))).drop("inner", "outer", "block")


def _from_the_end(nodes: DataFrame, values: list[str], longest: int) -> DataFrame:
    """Replaces values by their sums over the node's and all greater depths of its conv_id."""
    cut = nodes.withColumn("block", F.floor(F.col("depth") / BLOCK_NODES).cast("long"))
    deep = W.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    inside = cut.withColumns({c: F.sum(c).over(deep) for c in values})
    if longest < BLOCK_NODES:
        return inside.drop("block")
    below = W.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in values])
    totals = totals.select("conv_id", "block", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"more_{c}") for c in values])
    return inside.join(totals, ["conv_id", "block"]).withColumns({c: F.col(c) + F.col(f"more_{c}") for c in values}).drop("block", *[f"more_{c}" for c in values])


def build_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of conversations given as conv_id, depth (1, 2, ... without gaps), item (binary) and n_chars.

    ``convs`` names every conversation, also those without turns, which end at
    the root.  saved_tokens sums (n_convs - 1) * n_chars over the subtree.  No
    conversation gives no node.  One prefix may belong to any share of all
    conversations: rows are counted by prefix and a hash of the conversation
    first, and get their node's name back over the same hash.
    """
    spark = turns.sparkSession
    longest = turns.agg(F.max("depth")).first()[0] or 0
    prefixes = prefix_digests(turns.select("conv_id", "depth", "item", "n_chars"), longest)
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_chars"), F.lit(b"").alias("digest"))
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(shuffle_width(spark)))
    prefixes = checkpointed(prefixes.select(roots.columns).unionByName(roots).withColumn("salt", salt))

    key = ["depth", "digest"]
    partial = prefixes.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    named = partial.groupBy(*key).agg(F.sum("n").alias("n_convs"), F.min("least").alias("name"), F.collect_list("salt").alias("salts"))
    named = named.select(*key, "n_convs", "name", F.explode("salts").alias("salt"))
    paths = checkpointed(prefixes.join(named, [*key, "salt"]).select("conv_id", "depth", "n_chars", "n_convs", "name"))

    # Runs of a path by the name of their nodes; a conversation's own run, if any, is its last.
    mine = F.col("name") == F.col("conv_id")
    saved = (F.col("n_convs") - 1) * F.col("n_chars")
    runs = paths.groupBy("conv_id", "name").agg(F.min("depth").alias("top"), F.max("depth").alias("end"), F.sum(F.when(mine, saved)).alias("saved"))
    tips = checkpointed(
        runs.groupBy("conv_id").agg(
            F.max(F.struct("end", "name")).alias("last"), F.max(F.when(~mine, F.struct("end", "name"))).alias("above"),
            F.max(F.when(mine, F.col("top"))).alias("top"), F.max(F.when(mine, F.col("saved"))).alias("saved"),
        )
    )
    owners = tips.filter(F.col("top").isNotNull())
    hung = owners.filter("above IS NOT NULL").groupBy(F.col("above.name").alias("conv_id"), F.col("above.end").alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    tails = owners.select("conv_id", "saved", "top", F.col("last.end").alias("depth"), F.col("above.name").alias("parent")).join(hung, ["conv_id", "depth"], "left")
    tails = checkpointed(tails.withColumn("leaf", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long")).drop("hung"))
    up = runs.filter(~mine).select("conv_id", F.col("name").alias("over"), F.col("end").alias("at"))
    sums = up.join(tails.select("conv_id", "saved", "leaf"), "conv_id").groupBy(F.col("over").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))

    parts = [
        paths.filter(mine).select("conv_id", "depth", "n_convs", saved.alias("saved")),
        sums,
        hung,
        tails.select("conv_id", "depth", F.col("leaf").alias("leaves"), F.lit(1).alias("stops")),
        tails.select("conv_id", F.col("top").alias("depth"), "parent", F.lit(1).alias("starts")),
    ]
    facts = parts[0]
    for more in parts[1:]:
        facts = facts.unionByName(more, allowMissingColumns=True)
    added = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_convs", "saved", "leaves", "hung", "stops", "starts")]
    nodes = facts.groupBy("conv_id", "depth").agg(*added, F.max("parent").alias("parent"))
    nodes = _from_the_end(nodes, ["saved", "leaves"], longest)
    nodes = nodes.select(
        "conv_id", "depth", F.when(F.col("starts") > 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        (F.col("hung") + 1 - F.col("stops")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    return Trie(nodes, tips.select(F.col("last.name").alias("conv_id"), F.col("last.end").alias("depth"), F.col("conv_id").alias("member")))


def ends_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of a trie's ends: the digest of the members' ids, ascending, comma-joined.

    Ids are put together in sorted chunks by tasks that may share a node; then
    one pass over a node's chunks feeds its digest, so no list is held whole.
    """
    order = ["conv_id", "depth", "member"]
    rows = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("said", F.col("member").cast("string"))
    kinds = dict(rows.dtypes)

    def chunks(batches):
        out, mark, first, said, held = [], None, None, [], 0
        for batch in batches:
            for conv, depth, member, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if said and (mark != (conv, depth) or held >= CHUNK_CHARS):
                    out.append((*mark, first, ",".join(said)))
                    said, held = [], 0
                if not said:
                    mark, first = (conv, depth), member
                said.append(text)
                held += len(text) + 1
            yield from packed(out, batch.schema)
            out = []
        if said:
            yield from packed([(*mark, first, ",".join(said))], batch.schema)

    def packed(out, schema):
        if out:
            kinds = [schema.field(i).type for i in range(3)] + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "depth", "first", "said"])

    def digests(batches):
        mark, state = None, None
        for batch in batches:
            out = []
            for conv, depth, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mark != (conv, depth):
                    if state:
                        out.append((*mark, state.hexdigest()))
                    mark, state = (conv, depth), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "depth", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*mark, state.hexdigest()), kinds, strict=True)], ["conv_id", "depth", "ends_sha256"])

    head = f"conv_id {kinds['conv_id']}, depth {kinds['depth']}"
    said = rows.mapInArrow(chunks, f"{head}, first {kinds['member']}, said string")
    return said.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digests, f"{head}, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> Trie:
    """The trie of conversations as they stand (conv_id, turn, role, text); see ``ordered_turns`` for nulls and ties."""
    turns, convs = ordered_turns(conversations)
    return build_trie(turns.withColumnRenamed("place", "depth"), convs)


def forked_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of forked conversations, with the digest of the conversations that end at each.

    Rows with a null conv_id are in no conversation; null roles and texts are
    empty; null turns come first, ties by digest; repeated rows are turns of
    their own; an empty table gives no node; extra columns are not read.
    """
    turns, convs = ordered_turns(conversations)
    trie = build_trie(forked(turns, convs), convs)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return trie.nodes.join(ends_digests(trie.ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
