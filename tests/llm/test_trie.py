"""The conversation trie against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth string, name string, place string"


def frame(spark, rows):
    """Conversations with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], TURNS)


def item(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows, fork=True):
    """Nodes as {(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends digest)}."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, item(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in by.items()}
    if fork:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out = {}

    def walk(p, parent):
        leaves, saved = not children[p], (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        name = min(members[p])
        for q in children[p]:
            more = walk(q, name)
            leaves, saved = leaves + more[0], saved + more[1]
        ends = ",".join(str(c) for c in sorted(members[p]) if len(own[c]) == len(p))
        out[name, len(p)] = (parent, len(members[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if own:
        walk((), None)
    return out


def told(nodes):
    rows = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    out = {(r[0], r[1]): tuple(r[2:]) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n=260, longest=9):
    """Few distinct turns, so that many conversations share prefixes; copies, prefixes of others and absent bases."""
    r = np.random.Generator(np.random.PCG64(seed))
    rows = []
    for c in range(3, n):
        if c % 100 == 0 and c % 200:
            continue
        base = np.random.Generator(np.random.PCG64(c % 7)).integers(0, 3, longest) if c % 3 else r.integers(0, 2, longest)
        for t in range(int(r.integers(1, longest + 1))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"é{base[t]}" * int(base[t])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_forked_trie_equals_brute_force(spark, seed):
    rows = conversations(seed)
    assert told(trie.forked_trie(frame(spark, rows))) == brute(rows)


def test_small_blocks_and_chunks_give_the_same_trie(spark, monkeypatch):
    rows = conversations(5, 120, 40) + [(7000 + c, t, "user", f"t{t}") for c in (1, 2) for t in range(150 - 20 * c)]
    expected = brute(rows)
    monkeypatch.setattr(trie, "BLOCK_NODES", 4)
    monkeypatch.setattr(trie, "CHUNK_CHARS", 5)
    turns, convs = trie.ordered_turns(frame(spark, rows))
    whole = trie.prefix_digests(trie.forked(turns, convs), 150, 256).select("conv_id", "depth", "digest")
    assert told(trie.forked_trie(frame(spark, rows))) == expected
    monkeypatch.setattr(trie.prefix_digests, "__defaults__", (3,))  # three turns a block: five levels
    assert told(trie.forked_trie(frame(spark, rows))) == expected
    again = trie.prefix_digests(trie.forked(turns, convs), 150)
    same = whole.alias("a").join(again.alias("b"), ["conv_id", "depth"]).groupBy(F.col("a.digest").alias("a")).agg(F.countDistinct("b.digest").alias("n"))
    assert same.filter("n > 1").count() == 0 and whole.count() == again.count()


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(100, None, None, None), (100, 0, "user", "a"), (100, 0, "user", "a"), (100, 0, "user", "b"), (None, 0, "user", "a"), (101, 5, "u", "x" * 100_000), (102, 1, "u", ""), (103, 1, None, "")]
    rows += [(205, 0, "u", "a")]  # crc32 % 6 of 205 may take over more turns than there are: its base is absent
    assert told(trie.forked_trie(frame(spark, rows))) == brute(rows)
    found = told(trie.forked_trie(frame(spark, rows)))
    assert all(k[0] is not None for k in found)


def test_empty_table_gives_no_node(spark):
    assert trie.forked_trie(frame(spark, [])).count() == 0


def test_plain_trie_with_string_ids(spark):
    rows = [("b", 0, "u", "hi"), ("a", 0, "u", "hi"), ("a", 1, "v", "yes"), ("c", 0, "u", "no")]
    found = trie.conversation_trie(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    nodes = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in found.nodes.collect()}
    assert nodes == {("a", 0): (None, 3, 2, 2, 2), ("a", 1): ("a", 2, 1, 1, 2), ("a", 2): ("a", 1, 0, 1, 0), ("c", 1): ("a", 1, 0, 1, 0)}
    assert sorted(map(tuple, found.ends.collect())) == [("a", 1, "b"), ("a", 2, "a"), ("c", 1, "c")]


def test_one_conversation_over_many_tasks(spark):
    """A conversation with most rows is numbered across the parts it lies in."""
    rows = [(1, t, "u", f"t{t}") for t in range(3000)] + [(2, t, "u", f"t{t}") for t in range(200)]
    turns, convs = trie.ordered_turns(frame(spark, rows).repartition(4))
    assert {(r.conv_id, r.place): r.item for r in turns.collect()} == {(c, t + 1): item("u", x) for c, t, _, x in rows}
    assert sorted(map(tuple, convs.collect())) == [(1, 3000), (2, 200)]
    assert told(trie.forked_trie(frame(spark, rows))) == brute_deep(rows)


def brute_deep(rows):
    """``brute`` without recursion for two conversations of which the second opens like the first."""
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in (1, 2)}
    own = {c: [(r, x) for k, _, r, x in rows if k == c][h[c] :] for c in (1, 2)}
    both = 0
    while both < len(own[2]) and both < len(own[1]) and own[1][both] == own[2][both]:
        both += 1
    empty = hashlib.sha256(b"").hexdigest()
    out = {}
    for c in (1, 2):
        for d in range(both + 1 if c == 2 else 0, len(own[c]) + 1):
            shared = d <= both
            two = both < len(own[2])
            n_children = (d < len(own[c])) + (c == 1 and d == both and two)
            saved = sum(len(x) for _, x in own[1][max(d, 1) - 1 : both]) if shared else 0
            ends = str(c) if d == len(own[c]) else "2" if not two and d == both else ""
            out[c, d] = (None if d == 0 else 1 if d <= both + 1 else c, 1 + shared, n_children, 1 + (shared and two), saved, hashlib.sha256(ends.encode()).hexdigest() if ends else empty)
    return out
