"""SentencePiece encoding by sampling, and decoding.

A text's piece lattice has a node between any two characters and an edge for
each piece of a given vocabulary.  Forward filtering sums the weights of all
ways to reach each node; backward sampling then draws edges from the end with
exactly those odds, so a segmentation has the probability of the product of its
pieces.  The draws are counter-based: a hash of the seed, the row's key and the
place, so the same row gives the same segmentation wherever and whenever it runs.

The lattice falls apart where no piece can cross (before a word's leading
spaces and around line feeds), so equal words share one filtered lattice, and
words of one length are filtered together as arrays.

The vocabulary is a file of a public tokenizer, given by its path; nothing is
trained here.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.runtime import giving_back, mix64, runs

DEFAULT_MODEL = os.environ.get("EVIDARA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Stands for a U+2581 of the text itself; no valid text has a lone surrogate.
LITERAL = "\ud800"
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
#: Offset of a piece's rank in its weight: the weight of rank r is 1 / (r + RANK_OFFSET).
RANK_OFFSET = 50.0
#: Characters that are encoded together: equal words among them share a lattice.
RUN_CHARACTERS = 2_000_000
_UNITS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class _Numbers(dict):
    """Keys -> 0, 1, 2, ... in the order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = value = len(self)
        return value


class Vocabulary:
    """Pieces, weights and byte pieces of a SentencePiece model, in plain arrays."""

    def __init__(self, pieces: list[str], ranks: list[float], byte_ids: list[int], skipped: set[int]):
        self.size, self.byte_ids = len(pieces), np.array(byte_ids, np.int64)
        usable = [i for i, p in enumerate(pieces) if i not in skipped and i not in set(byte_ids) and p]
        # A piece with a space behind another character, or with a line feed in it, would cross units.
        usable = [i for i in usable if SPACE not in pieces[i].lstrip(SPACE) and "\n" not in pieces[i]]
        weight = {i: 1.0 / (ranks[i] + RANK_OFFSET) for i in usable}
        least = min(weight.values(), default=1.0)
        total = sum(weight.values()) + 256 * least
        self.log_byte = float(np.log(least / total))
        self.longest = max([1, *(len(pieces[i]) for i in usable)])
        self.bytes_of = [b""] * len(pieces)
        for i in usable:
            self.bytes_of[i] = pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        by_length: dict[int, list[int]] = {}
        for i in usable:
            by_length.setdefault(len(pieces[i]), []).append(i)
        self.tables = {}
        for n, ids in by_length.items():
            codes = np.frombuffer("".join(pieces[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(-1, n)
            h = np.zeros(len(ids), np.uint64)
            for j in range(n):
                h = extend(h, codes[:, j])
            order = np.argsort(h)
            own = np.array(ids)[order]
            self.tables[n] = _slots(h[order], own, np.log([weight[i] / total for i in own.tolist()]))

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        """Read a model file, on the driver."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        at = {p: i for i, p in enumerate(pieces)}
        bytes_ = [at[f"<0x{b:02X}>"] for b in range(256)]
        skipped = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls(pieces, [max(0.0, -model.get_score(i)) for i in range(n)], bytes_, skipped)

    def find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and log weights (-inf) of the pieces of length n with hashes ``h``."""
        table = self.tables.get(n)
        if table is None:
            return np.full(h.shape, -1, np.int32), np.full(h.shape, -np.inf)
        slot, bits, keys, ids, logs = table
        spot = slot[(h >> bits).astype(np.int64)]
        out = np.full(h.shape, -1, np.int32)
        log = np.full(h.shape, -np.inf)
        # Keys of one slot stand one behind the other; most slots are empty.
        open_ = np.flatnonzero(spot.ravel() >= 0)
        flat_h, at = h.ravel()[open_], spot.ravel()[open_].astype(np.int64)
        flat_out, flat_log = out.ravel(), log.ravel()
        while len(open_):
            same = keys[at] == flat_h
            flat_out[open_[same]] = ids[at[same]]
            flat_log[open_[same]] = logs[at[same]]
            at = at + 1
            more = ~same & (at < len(keys))
            more[more] = (keys[at[more]] >> bits) == (flat_h[more] >> bits)
            open_, flat_h, at = open_[more], flat_h[more], at[more]
        return out, log


def extend(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one character longer."""
    with np.errstate(over="ignore"):
        h = (h + codes.astype(np.uint64) + np.uint64(1)) * _P
        return h ^ (h >> np.uint64(29))


def _slots(keys: np.ndarray, ids: np.ndarray, logs: np.ndarray):
    """A table from the top bits of a hash to the first of its sorted keys (-1: none)."""
    width = max(8, int(4 * len(keys)).bit_length())
    bits = np.uint64(64 - width)
    slot = np.full(1 << width, -1, np.int32)
    top = (keys >> bits).astype(np.int64)
    slot[top[::-1]] = np.arange(len(keys))[::-1]
    return slot, bits, keys, ids.astype(np.int32), logs


def _filtered(units: list[str], vocabulary: Vocabulary, power: float):
    """Lattices of units of one length: cumulative odds and ids of the edges into each node.

    Shapes are units x nodes x edge length; an id below 0 is -1 - code point, a
    character without a piece, which is spelt in bytes.
    """
    n, longest = len(units[0]), min(vocabulary.longest, len(units[0]))
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), n)
    log = np.full((len(units), n + 1, longest), -np.inf)
    ids = np.zeros((len(units), n + 1, longest), np.int32)
    h = np.zeros((len(units), n), np.uint64)
    for k in range(1, longest + 1):
        h = extend(h[:, : n - k + 1], codes[:, k - 1 :])
        found, weight = vocabulary.find(k, h)
        weight = weight * power
        if k == 1:
            missing = found < 0
            size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            weight = np.where(missing, size * vocabulary.log_byte * power, weight)
            found = np.where(missing, -1 - codes.astype(np.int64), found)
        log[:, k:, k - 1], ids[:, k:, k - 1] = weight, found
    forward = np.full((len(units), n + 1), -np.inf)
    forward[:, 0] = 0.0
    for j in range(1, n + 1):
        k = min(j, longest)
        ways = log[:, j, :k] + forward[:, j - k : j][:, ::-1]
        top = ways.max(axis=1)
        odds = np.exp(ways - top[:, None])
        sums = odds.sum(axis=1)
        forward[:, j] = top + np.log(sums)
        cumulative = np.cumsum(odds / sums[:, None], axis=1)
        log[:, j, :k] = cumulative
        log[:, j, k - 1 :] = 2.0  # rounding never leaves the last edge out
        if k > 1:
            # Edges behind the last one that exists must not be drawn either.
            last = k - 1 - np.argmax(odds[:, ::-1] > 0, axis=1)
            log[:, j, :k] = np.where(np.arange(k) >= last[:, None], 2.0, cumulative)
    return log.astype(np.float32), ids


def sample_ids(texts: list[str | None], keys: np.ndarray, vocabulary: Vocabulary, seed: int, power: float) -> tuple[np.ndarray, np.ndarray]:
    """All sampled ids one behind the other, and where each text's begin (one more at the end)."""
    number = _Numbers()
    parts: list[list[str]] = []
    for text in texts:
        if text:
            # A literal U+2581 is spelt in bytes, so that decoding gives it back.
            marked = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
            parts.append(_UNITS.findall(marked))
        else:
            parts.append([])
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    total = int(ends[-1])
    own = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, total)
    if not total:
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
    with np.errstate(over="ignore"):
        start = mix64(keys[text_of] ^ np.uint64(seed)) + (np.arange(total) - ends[text_of]).astype(np.uint64) * _Q
    units = list(number)
    lengths = np.array([len(u) for u in units])
    of_length = lengths[own]
    counts = np.zeros(total, np.int64)
    drawn: list[tuple[np.ndarray, int, np.ndarray]] = []
    local = np.zeros(len(units), np.int64)
    for n in np.unique(lengths).tolist():
        wanted = np.flatnonzero(lengths == n)
        whole = np.flatnonzero(of_length == n)
        most = max(1, 2_000_000 // (n + 1) // min(vocabulary.longest, n))
        for first in range(0, len(wanted), most):
            some = wanted[first : first + most]
            local[some] = np.arange(len(some))
            odds, ids = _filtered([units[i] for i in some.tolist()], vocabulary, power)
            at = whole if most >= len(wanted) else whole[np.isin(own[whole], some)]
            node, row, step = np.full(len(at), n), local[own[at]], 0
            while len(at):
                with np.errstate(over="ignore"):
                    u = (mix64(start[at] + np.uint64(step + 1) * _P) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
                edge = (odds[row, node] <= u[:, None]).sum(axis=1)
                drawn.append((at, step, ids[row, node, edge]))
                counts[at] += 1
                node = node - edge - 1
                more = node > 0
                at, node, row, step = at[more], node[more], row[more], step + 1
    begin = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(begin[-1], np.int64)
    for at, step, ids in drawn:
        out[begin[at + 1] - 1 - step] = ids
    text_begin = begin[ends]
    return _spelt(out, text_begin, vocabulary)


def _spelt(ids: np.ndarray, begin: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Negative ids, which are characters, become the ids of their bytes."""
    spots = np.flatnonzero(ids < 0)
    if not len(spots):
        return ids.astype(np.int32), begin
    spelt = {c: list(_bytes(-1 - c)) for c in np.unique(ids[spots]).tolist()}
    sizes = np.ones(len(ids), np.int64)
    sizes[spots] = [len(spelt[c]) for c in ids[spots].tolist()]
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.repeat(ids, sizes)
    for i in range(max(len(x) for x in spelt.values()) if spelt else 0):
        own = spots[sizes[spots] > i]
        out[at[own] + i] = [vocabulary.byte_ids[spelt[c][i]] for c in ids[own].tolist()]
    return out.astype(np.int32), at[begin]


def _bytes(code: int) -> bytes:
    """UTF-8 of a character, with the stand-in undone."""
    return (SPACE if chr(code) == LITERAL else chr(code)).encode("utf-8", "surrogatepass")


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of ids: their bytes, without the space that encoding put in front."""
    text = b"".join(map(vocabulary.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
    return text[1:] if text.startswith(" ") else text


def decoded_texts(ids: np.ndarray, begin: np.ndarray, table: pa.Array) -> pa.Array:
    """``decode_ids`` of all texts at once: their bytes lie one behind the other, so only the bounds are made anew."""
    spelt = table.take(pa.array(ids))
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(spelt).to_numpy())))[begin].astype(np.int64)
    data = np.frombuffer(spelt.buffers()[2] or b"", np.uint8)
    # Two pieces a text: the space in front, if there is one, and the rest.
    cuts = np.repeat(ends, 2)[:-1]
    some = np.flatnonzero(ends[1:] > ends[:-1])
    cuts[2 * some + 1] += data[ends[some]] == 32
    halves = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return halves.take(pa.array(np.arange(1, len(cuts) - 1, 2)))


def encode_documents(docs: DataFrame, key: str = "doc_id", seed: int = 1, power: float = 0.5, vocabulary: Vocabulary | None = None, check: bool = False, run_characters: int = RUN_CHARACTERS) -> DataFrame:
    """Sampled piece ids of every whole text, and what they decode to.

    Returns ``key``, ids (array of int) and decoded; with ``check`` instead of
    the last n_ids and lossless, whether decoding gave the text back.  ``power`` sharpens (above
    1) or flattens the odds.  A null text has null ids and decodes to null; an
    empty one has none and decodes to ''.  Rows with equal keys and texts get
    equal ids; a null key counts as 0.  Any character without a piece is spelt
    in bytes, so decoding is lossless.  Other columns are not read.
    ``run_characters`` are encoded together: fewer take less memory and more time, the result is the same.
    """
    pieces = vocabulary or Vocabulary.load()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        vocabulary = shared.value
        table = pa.array(vocabulary.bytes_of, pa.large_binary())
        for batch in batches:
            at = 0
            for texts in runs(batch.column(2), run_characters):
                keys = batch.column(1).slice(at, len(texts)).to_numpy().view(np.uint64)
                ids, begin = sample_ids(texts, keys, vocabulary, seed, power)
                decoded = decoded_texts(ids, begin, table)
                null = np.array([t is None for t in texts] + [False])
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32), mask=null), pa.array(ids))
                if check:
                    whole = batch.column(2).slice(at, len(texts)).cast(pa.large_binary())
                    rest = {"n_ids": pa.array(np.diff(begin), pa.int64()), "lossless": pc.equal(whole, decoded)}
                else:
                    rest = {"decoded": pc.if_else(pa.array(null[:-1]), pa.scalar(None, pa.string()), decoded.cast(pa.string()))}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists, *rest.values()], [key, "ids", *rest])
                at += len(texts)

    hashed = F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(key).cast("string")))
    return docs.select(key, hashed.alias("__key"), "text").mapInArrow(giving_back(run), f"`{key}` {kind}, ids array<int>, " + ("n_ids long, lossless boolean" if check else "decoded string"))


def decode_documents(tokens: DataFrame, key: str = "doc_id", vocabulary: Vocabulary | None = None) -> DataFrame:
    """Texts of piece ids: ``key`` and text; null ids give a null text, no ids an empty one."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())
    kind = dict(tokens.dtypes)[key]

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else decode_ids(np.array(ids, np.int64), shared.value) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return tokens.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
