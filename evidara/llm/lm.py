"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(cell | class, history) * P(token | cell).
Classes are topics and bands of frequency, from all training documents.
The class of the next token is a softmax over hashed features of the history:
the last word, the last two, the last but one alone (skip) and the last two
classes.  The words of a class are told apart by a binary tree over the leading
bits of their hash, as deep as the class has words; each branch is a softmax
over two sides with hashed features (last word, last two, skip) of its own, and
begins at the sides' counts.  P(token | cell), a leaf of the tree, comes from
counts over all training documents.

Both factors learn from every training row, by rounds of distributed gradient
steps: each row is in one round, each task takes Adagrad steps over its share
from the common weights, and the results are averaged by the squared gradients
that each task met, so that a context that few tasks met keeps its weight.

Counts of the most frequent tokens (``HEAD_TOKENS`` at most) travel to every
task; all other tokens meet their counts in a shuffle join, so no table of words
here grows with the corpus except in distributed form.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.runtime import MASK, checkpointed, crc_residue, mix64, slices, to_signed

#: Tokens whose counts are broadcast: a fixed bound.
HEAD_TOKENS = 1 << 20
FIT_ROUNDS, STEP = 2, 0.3
#: Classes of words; those below a count, and the end of a text, have one more each.
TOPICS, BANDS, ANCHORS, LEAST_TOPIC_COUNT = 6, 3, 64, 4
#: Anchors with less of the texts start no topic: they are far from all others.
LEAST_ANCHOR_SHARE = 0.0005
#: Hashed rows of each of the three word features of the class softmax, and the most that a growing corpus makes of them.
FEATURE_ROWS, MOST_FEATURE_ROWS = 1 << 14, 1 << 17
#: Hashed weights of the word trees: least and most; between them one for 64 to 128 training tokens.
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 24
#: Levels of a class's tree at most: leaves of the largest classes then hold several words.
MOST_DEPTH = 14
#: Weights that one task averages.
BLOCK = 1 << 18
#: The end of a text; no word contains white space.
END = b" "
END_HASH = int(np.uint64(xxhash.xxh64_intdigest(END)).astype(np.int64))
#: Words in a task's own table before it starts anew.
MOST_WORDS = 300_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, words between ASCII white space; without the end."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordClasses:
    """Word -> class, a fixed function of the hash once fitted; all training rows count.

    A class is a topic and a band of frequency.  Bands cut the words in falling
    order of their count so that each holds about the same number of tokens;
    words of one count stay together.  Words below ``least`` occurrences, words
    beyond ``HEAD_TOKENS`` and uncounted ones have a class of their own, and so
    has the end of a text.
    """

    def __init__(self, texts: list[list[bytes]]):
        """From texts at hand, which are one topic."""
        counts = Counter(w for t in texts for w in t)
        h, c = np.array([xxhash.xxh64_intdigest(w) for w in counts], np.uint64), np.array(list(counts.values()), np.int64)
        self._set(h, c, np.zeros(len(h), np.int64))

    @classmethod
    def fitted(cls, train: DataFrame, counts: DataFrame) -> WordClasses:
        """From all words of ``train`` and their ``counts``."""
        made = cls.__new__(cls)
        heads = _head(counts.filter((F.col("h") != END_HASH) & (F.col("c") >= LEAST_TOPIC_COUNT)))
        made._set(*heads, _topics(train, *heads))
        return made

    def _set(self, hashes: np.ndarray, counts: np.ndarray, topics: np.ndarray) -> None:
        order = np.argsort(hashes)
        hashes, counts, topics = hashes[order], counts[order], topics[order]
        sizes, tokens = np.unique(counts, return_inverse=True)
        mass = np.bincount(tokens, counts, minlength=len(sizes))
        above = mass.sum() - np.cumsum(mass)  # tokens of the more frequent words
        band = (BANDS * above / max(1.0, mass.sum())).astype(np.int64)[tokens]
        self.heads, self.head_kinds, self.count = hashes, (topics * BANDS + band).astype(np.uint8), TOPICS * BANDS + 2

    def kinds(self, hashes: np.ndarray) -> np.ndarray:
        """The classes of words, by their hashes."""
        out = np.full(len(hashes), self.count - 2, np.int64)
        if len(self.heads):
            spot = np.minimum(np.searchsorted(self.heads, hashes), len(self.heads) - 1)
            out = np.where(self.heads[spot] == hashes, self.head_kinds[spot], out)
        return np.where(hashes == np.uint64(END_HASH & MASK), self.count - 1, out)


def _k_means(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Cluster numbers of unit-scaled rows; starts from rows that are far apart."""
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    empty = ~points.any(axis=1)  # rows that are far from all, but start no cluster
    if not len(points):
        return np.zeros(0, np.int64)
    centres = [points.mean(axis=0)]
    while len(centres) < k:
        near = np.where(empty, np.inf, np.max(points @ np.array(centres).T, axis=1))
        centres.append(points[int(np.argmin(near))])
    centres = np.array(centres)
    own = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        for i in range(k):
            if (own == i).any():
                centres[i] = points[own == i].mean(axis=0)
                centres[i] /= max(np.linalg.norm(centres[i]), 1e-9)
    return own


def _anchored(part: Words, anchors: np.ndarray) -> np.ndarray:
    """Unit-scaled roots of how often each text has each anchor."""
    spot = np.minimum(np.searchsorted(anchors, part.hashes), len(anchors) - 1)
    column = np.where(anchors[spot] == part.hashes, spot, -1)[part.ids]
    row = np.repeat(np.arange(len(part.starts)), np.diff(part.starts, append=len(part.ids)))
    some = column >= 0
    points = np.sqrt(np.bincount(row[some] * len(anchors) + column[some], minlength=len(part.starts) * len(anchors)).reshape(-1, len(anchors)))
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)


def _topics(train: DataFrame, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The topic in which each of some words is most frequent, over all texts.

    Topics are clusters of the most frequent words (anchors) by the texts that
    they share; a text has the topic of most of its anchors.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    anchors = np.sort(hashes[np.lexsort((hashes, -counts))[:ANCHORS]])
    context = train.sparkSession.sparkContext

    def meet(batches):
        met = np.zeros((len(anchors), len(anchors)))
        for batch in batches:
            for texts in slices(batch.column(0)):
                points = _anchored(Words(texts), anchors)
                met += points.T @ points
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(met.size, dtype=np.int32)), pa.array(met.ravel())], ["at", "x"])

    rows = as_words(train).select("words")
    told = rows.mapInArrow(meet, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    met = np.zeros(len(anchors) ** 2)
    met[told.column("at").to_numpy()] = np.round(told.column("x").to_numpy(), 6)  # sums in any order
    met = met.reshape(len(anchors), -1)
    scale = np.sqrt(np.maximum(np.diag(met), 1e-9))
    rare = np.diag(met) < LEAST_ANCHOR_SHARE * np.trace(met)
    met[rare], met[:, rare] = 0.0, 0.0
    cluster = np.eye(TOPICS)[_k_means(met / scale / scale[:, None], TOPICS)]
    shared = context.broadcast(hashes)

    def count(batches):
        heads, held = shared.value, np.zeros((len(hashes), TOPICS), np.int32)
        for batch in batches:
            for texts in slices(batch.column(0)):
                part = Words(texts)
                topic = np.argmax(_anchored(part, anchors) @ cluster, axis=1)
                spot = np.minimum(np.searchsorted(heads, part.hashes), len(heads) - 1)
                spot = np.where(heads[spot] == part.hashes, spot, -1)[part.ids]
                row = np.repeat(topic, np.diff(part.starts, append=len(part.ids)))
                some = spot >= 0
                np.add.at(held.reshape(-1), spot[some] * TOPICS + row[some], 1)
        some = np.flatnonzero(held.any(axis=1))
        for at in range(0, len(some), 100_000):
            own = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(held[own, k].astype(np.int64)) for k in range(TOPICS))], ["at", *(f"c{k}" for k in range(TOPICS))])

    schema = ", ".join(["at int", *(f"c{k} long" for k in range(TOPICS))])
    told = rows.mapInArrow(count, schema).groupBy("at").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(TOPICS)]).toArrow()  # HEAD_TOKENS rows at most
    held = np.stack([told.column(f"c{k}").to_numpy() for k in range(TOPICS)], axis=1)
    out = np.zeros(len(hashes), np.int64)
    out[told.column("at").to_numpy()] = np.argmax(held / (held.sum(axis=0) + 1.0), axis=1)
    shared.unpersist()
    return out


class WordTable(dict):
    """Word -> number, with each number's hash and class; a task's own vocabulary."""

    def __init__(self, classes: WordClasses):
        super().__init__()
        self.classes, self.hash, self.kind = classes, array("Q"), np.zeros(0, np.int64)
        self.end = self[END]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hash)
        self.hash.append(xxhash.xxh64_intdigest(word))
        return number

    def hashes(self) -> np.ndarray:
        return np.array(self.hash, np.uint64)

    def kinds(self) -> np.ndarray:
        if len(self.kind) < len(self.hash):
            self.kind = np.concatenate((self.kind, self.classes.kinds(self.hashes()[len(self.kind) :])))
        return self.kind

    def numbers(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts one behind the other, and where each text begins."""
        words, at, inside, starts = split_tokens(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        own = np.fromiter(map(self.__getitem__, words.to_pylist()), np.int64, len(words))
        ids = np.full(len(inside), self.end, np.int64)
        ids[inside] = own[at]
        return ids, starts


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each word, which tokens are words (not ends), and where each text begins."""
    # A copy of its own: lowering a cast slice loses bytes in Arrow.
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays([texts.fill_null("")]).cast(pa.large_string())))
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    flat = split.flatten()
    there = pc.binary_length(flat).to_numpy() > 0  # white space at either end leaves an empty piece
    words = flat.filter(pa.array(there)).dictionary_encode()
    before = np.concatenate(([0], np.cumsum(there)))[offsets]
    inside = np.ones(len(words) + len(texts), bool)
    inside[before[1:] + np.arange(len(texts))] = False
    return words.dictionary.cast(pa.large_binary()), words.indices.to_numpy(), inside, before[:-1] + np.arange(len(texts))


class Words:
    """Texts as the hashes of their tokens: the distinct ones, each token's number among them, where each text begins."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        flat = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
        self.starts = ((offsets[:-1] - offsets[0]) // 8).astype(np.int64)
        self.hashes, self.ids = np.unique(flat, return_inverse=True)
        self.end = int(np.searchsorted(self.hashes, np.uint64(END_HASH & MASK)))


def as_words(df: DataFrame) -> DataFrame:
    """``df`` with a column ``words`` in place of ``text``: the hashes of its tokens and its end, 8 bytes each."""
    if "words" in df.columns:
        return df
    kept = [f for f in df.schema.fields if f.name != "text"]

    def hashed(batches):
        for batch in batches:
            at, column = 0, batch.column(batch.schema.get_field_index("text"))
            for texts in slices(column):
                words, number, inside, starts = split_tokens(texts)
                ends, letters = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1].tolist(), words.buffers()[2]
                letters = letters.to_pybytes() if letters else b""
                own = np.array([xxhash.xxh64_intdigest(letters[i:j]) for i, j in pairwise(ends)], np.uint64)
                hashes = np.full(len(inside), END_HASH & MASK, np.uint64)
                hashes[inside] = own[number]
                offsets = np.append(starts, len(hashes)) * 8
                made = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(hashes)])
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(at, len(texts)) for f in kept), made], [*(f.name for f in kept), "words"])
                at += len(texts)

    schema = T.StructType([*kept, T.StructField("words", T.BinaryType())])
    return df.select(*[f.name for f in kept], "text").mapInArrow(hashed, schema)


def history(ids: np.ndarray, starts: np.ndarray, table: WordTable | Words, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each token: numbers of the last word and of the last but one; hashes of the last, the last two, and the last but one."""
    one, two = np.empty_like(ids), np.empty_like(ids)
    one[0], one[1:] = table.end, ids[:-1]
    two[:2], two[2:] = table.end, ids[:-2]
    two[starts] = table.end
    with np.errstate(over="ignore"):
        word, skip = mix64(hashes * _A)[one], mix64(hashes * _B)[two]
        return one, two, word, mix64(word + skip), skip


class Softmax:
    """Weights of the class softmax: rows of hashed features and of class pairs."""

    def __init__(self, classes: int, weights: np.ndarray | None = None, features: int = FEATURE_ROWS):
        self.classes, self.features = classes, features
        self.weights = np.zeros((3 * features + classes * classes + 1, classes), np.float32) if weights is None else weights

    def rows(self, ids: np.ndarray, starts: np.ndarray, table: WordTable, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Feature rows of each token's history: tokens x 5."""
        return self.rows_of(history(ids, starts, table, hashes), kinds)

    def rows_of(self, past: tuple[np.ndarray, ...], kinds: np.ndarray) -> np.ndarray:
        one, two, *hashed = past
        mask = np.uint64(self.features - 1)
        out = np.empty((len(one), 5), np.int64)
        for j, h in enumerate(hashed):
            out[:, j] = (h & mask).astype(np.int64) + j * self.features
        out[:, 3] = 3 * self.features + kinds[one] * self.classes + kinds[two]
        out[:, 4] = 3 * self.features + self.classes * self.classes
        return out

    def _raised(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, their exponentials and the sums of those."""
        x = self.weights.take(rows[:, 0], axis=0)
        for j in range(1, 4):
            x += self.weights.take(rows[:, j], axis=0)
        x += self.weights[rows[0, 4]]
        np.clip(x, -60, 60, out=x)
        e = np.exp(x)
        return x, e, e @ np.ones(self.classes, np.float32)

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Natural logs of the classes' probabilities."""
        x, _, total = self._raised(rows)
        return x - np.log(total)[:, None]

    def log_probability(self, rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each token's class."""
        x, _, total = self._raised(rows)
        return x[np.arange(len(kinds)), kinds] - np.log(total)

    def train(self, rows: np.ndarray, kinds: np.ndarray, squares: np.ndarray, batch: int = 16384) -> None:
        """Adagrad steps over the tokens in batches."""
        for at in range(0, len(kinds), batch):
            r, k = rows[at : at + batch], kinds[at : at + batch]
            _, g, total = self._raised(r)
            g /= total[:, None]
            g[np.arange(len(k)), k] -= 1.0
            pairs = (g if self.classes % 2 == 0 else np.pad(g, ((0, 0), (0, 1)))).view(np.complex64)  # two classes are summed at once
            bits, place = batch.bit_length(), np.arange(len(k))
            for j in range(4):
                # Row and place in one number: sorting those is much faster than argsort, and keeps the tokens' order.
                keys = np.sort((r[:, j] << bits) | place)
                own = keys >> bits
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                sums = np.add.reduceat(pairs.take(keys & ((1 << bits) - 1), axis=0), first, axis=0).view(np.float32)[:, : self.classes]
                self._step(own[first], sums, squares)
            self._step(r[:1, 4], g.sum(axis=0, keepdims=True), squares)

    def _step(self, touched: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        held = squares.take(touched, axis=0)
        held += sums * sums
        squares[touched] = held
        sums *= STEP
        sums /= np.sqrt(held, out=held)
        self.weights[touched] = self.weights.take(touched, axis=0) - sums


class WordTree:
    """P(cell | class, history): a binary tree in each class over the leading bits of a word's hash.

    ``masses`` holds the smoothed counts of each class's 2 ** depth cells one
    behind the other.  A branch's logit is the log ratio of its sides' masses
    plus three hashed weights; with all weights 0 cells have their share of the
    class's mass.
    """

    def __init__(self, depth: np.ndarray, masses: np.ndarray, slots: int, weights: np.ndarray | None = None):
        self.depth, self.masses = depth.astype(np.uint32), masses
        self.offset = np.concatenate(([0], np.cumsum(1 << depth)[:-1])).astype(np.uint32)
        self.shift = np.uint32(33 - slots.bit_length())
        self.weights = np.zeros(slots, np.float32) if weights is None else weights
        self.prior = np.zeros(len(masses), np.float32)
        for at, d in zip(self.offset.tolist(), depth.tolist(), strict=True):
            m = masses[at : at + (1 << d)]
            for level in reversed(range(d)):
                self.prior[at + (1 << level) : at + (2 << level)] = np.log(m[1::2] / m[::2])
                m = m[::2] + m[1::2]

    def cells(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The cell of each word within its class."""
        d = self.depth[kinds].astype(np.uint64)
        return np.where(d > 0, hashes >> np.minimum(np.uint64(64) - d, np.uint64(63)), 0).astype(np.uint32)

    def _branches(self, kinds: np.ndarray, cells: np.ndarray, past: list[np.ndarray]):
        """Of each level: the order of the tokens that have it (deepest first), their slots, weights, side and logit."""
        depth = self.depth[kinds]
        order = np.argsort(-depth.astype(np.int8), kind="stable")
        depth, cell, at = depth[order], cells[order], self.offset[kinds][order]
        past = [h[order] for h in past]
        ends = np.searchsorted(-depth.astype(np.int64), -np.arange(MOST_DEPTH, dtype=np.int64), "left")
        for level, n in enumerate(ends.tolist()):
            if not n:
                break
            rest = depth[:n] - np.uint32(level + 1)
            prefix = cell[:n] >> rest
            node = at[:n] + np.uint32(1 << level) + (prefix >> np.uint32(1))
            mixed = node * np.uint32(0x9E3779B1)
            slots = [((mixed + h[:n]) >> self.shift).astype(np.intp) for h in past]
            held = [self.weights.take(s) for s in slots]
            logit = self.prior.take(node)
            for w in held:
                logit += w
            yield order[:n], slots, held, (prefix & np.uint32(1)).astype(np.float32), logit

    def log_probability(self, kinds: np.ndarray, cells: np.ndarray, past: list[np.ndarray]) -> np.ndarray:
        """Natural log of the probability of each token's cell given its class; ``past``: 32-bit hashes of the history."""
        out = np.zeros(len(kinds), np.float32)
        for own, _, _, side, logit in self._branches(kinds, cells, past):
            x = np.clip((1 - 2 * side) * logit, -80, 80)
            out[own] -= np.log(1 + np.exp(x))
        return out

    def train(self, kinds: np.ndarray, cells: np.ndarray, past: list[np.ndarray], squares: np.ndarray, sums: np.ndarray, batch: int = 32768) -> None:
        """Adagrad steps; ``sums`` is scratch space of zeros."""
        for i in range(0, len(kinds), batch):
            for _, slots, weights, side, logit in self._branches(kinds[i : i + batch], cells[i : i + batch], [h[i : i + batch] for h in past]):
                g = 1 / (1 + np.exp(np.clip(-logit, -80, 80))) - side
                for s, w in zip(slots, weights, strict=True):
                    np.add.at(sums, s, g)
                    total = sums.take(s)
                    if len(sums) > 8 * len(s):
                        sums[s] = 0.0
                    else:
                        sums.fill(0.0)
                    # A slot's tokens all write the same value.
                    held = squares.take(s)
                    held += total * total
                    squares[s] = held
                    total *= STEP
                    total /= np.sqrt(held, out=held)
                    w -= total
                    self.weights[s] = w


def _power(x: float, least: int, most: int) -> int:
    """The power of two above ``x``, between bounds."""
    return min(most, max(least, 1 << max(0, math.ceil(math.log2(max(1.0, x))))))


def fit_classes(train: DataFrame) -> WordClasses:
    """Word classes from all training rows."""
    return WordClasses.fitted(train, count_words(train))


def cell_masses(counts: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Depth of each class's tree, smoothed counts of all cells, and the tokens and distinct tokens of ``counts``.

    Each cell also has room for one word that was not counted.
    """
    cells = 1 << MOST_DEPTH
    rows = counts.groupBy("kind", F.shiftrightunsigned("h", 64 - MOST_DEPTH).cast("int").alias("cell")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()  # at most classes x cells
    place = rows.column("kind").to_numpy().astype(np.int64) * cells + rows.column("cell").to_numpy()
    n, v = np.zeros(classes * cells), np.zeros(classes * cells)
    n[place], v[place] = rows.column("n").to_numpy(), rows.column("v").to_numpy()
    n, v = n.reshape(classes, cells), v.reshape(classes, cells)
    depth = np.array([min(MOST_DEPTH, max(0, int(x) - 1).bit_length()) for x in v.sum(axis=1)])
    masses = [(a + 0.5 * b).reshape(1 << d, -1).sum(axis=1) + 0.5 for a, b, d in zip(n, v, depth.tolist(), strict=True)]
    return depth, np.concatenate(masses), int(n.sum()), int(v.sum())


def _average(batches):
    """One block's weights and roots of squares, averaged by the squares that each task added."""
    weights = squares = seen = None
    for batch in batches:
        for block, w, q, base in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            q = np.frombuffer(q, np.float16).astype(np.float32) ** 2
            own = np.maximum(q - np.frombuffer(base, np.float16).astype(np.float32) ** 2, 1e-6)
            w = np.frombuffer(w, np.float16).astype(np.float32)
            weights, squares, seen = (own * w, q * own, own) if seen is None else (weights + own * w, squares + q * own, seen + own)
            at = block
    if seen is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(weights / seen).astype(np.float16).tobytes()], pa.binary()), pa.array([np.sqrt(squares / seen).astype(np.float16).tobytes()], pa.binary())], ["block", "weights", "squares"])


def fit_softmax(train: DataFrame, classes: WordClasses, depth: np.ndarray, masses: np.ndarray, tokens: int) -> tuple[Softmax, WordTree]:
    """Weights of both factors from all training rows; their number grows with ``tokens``."""
    train = as_words(train)
    softmax = Softmax(classes.count, features=_power(tokens / 4096, FEATURE_ROWS, MOST_FEATURE_ROWS))
    tree = WordTree(depth, masses, _power(tokens / 128, LEAST_SLOTS, MOST_SLOTS))
    context, shape, cut = train.sparkSession.sparkContext, softmax.weights.shape, softmax.weights.size
    flat, squares = np.zeros(cut + len(tree.weights), np.float16), np.ones(cut + len(tree.weights), np.float16)
    for at in range(FIT_ROUNDS):
        shared = context.broadcast((classes, depth, masses, flat, squares))

        def step(batches, shared=shared):
            classes, depth, masses, flat, roots = shared.value
            weights, squares = flat.astype(np.float32), roots.astype(np.float32) ** 2
            softmax, tree = Softmax(classes.count, weights[:cut].reshape(shape), softmax_features), WordTree(depth, masses, len(flat) - cut, weights[cut:])
            scratch, seen = np.zeros(len(flat) - cut, np.float32), 0
            for batch in batches:
                for texts in slices(batch.column(0)):
                    part = Words(texts)
                    ids, hashes, kinds = part.ids, part.hashes, classes.kinds(part.hashes)
                    past, own = history(ids, part.starts, part, hashes), kinds[ids]
                    softmax.train(softmax.rows_of(past, kinds), own, squares[:cut].reshape(shape))
                    tree.train(own, tree.cells(hashes, kinds)[ids], [(h >> np.uint64(32)).astype(np.uint32) for h in past[2:]], squares[cut:], scratch)
                    seen += len(ids)
            if seen:
                new, held = np.clip(weights, -60000, 60000).astype(np.float16), np.minimum(np.sqrt(squares), 60000).astype(np.float16)
                for i in range(0, len(flat), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), *(pa.array([x[i : i + BLOCK].tobytes()], pa.binary()) for x in (new, held, roots))], ["block", "weights", "squares", "base"])

        softmax_features = softmax.features
        # As many tasks as the cluster runs at once: each sends one table, whatever the input.
        rows = train.filter(F.pmod(F.xxhash64(F.lit("round"), "doc_id", "words"), F.lit(FIT_ROUNDS)) == at).select("words").coalesce(max(1, context.defaultParallelism))
        told = rows.mapInArrow(step, "block int, weights binary, squares binary, base binary")
        flat, squares = flat.copy(), squares.copy()
        for r in told.groupBy("block").applyInArrow(_merged, "block int, weights binary, squares binary").toLocalIterator():
            i = r["block"] * BLOCK
            for to, c in ((flat, "weights"), (squares, "squares")):
                to[i : i + BLOCK] = np.frombuffer(r[c], np.float16)
        shared.destroy()
    weights = flat.astype(np.float32)
    return Softmax(classes.count, weights[:cut].reshape(shape), softmax.features), WordTree(depth, masses, len(flat) - cut, weights[cut:])


def _merged(group: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_average(group.to_batches())))


def count_words(train: DataFrame) -> DataFrame:
    """(h, c): hash and count of every distinct token of all training rows."""

    def count(batches):
        held, size = [], 0

        def told():
            h, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            c = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
            return h, c

        for batch in batches:
            for texts in slices(batch.column(0)):
                part = Words(texts)
                held.append((part.hashes, np.bincount(part.ids)))
                size += len(part.hashes)
                if size > 2 * MOST_WORDS:
                    held = [told()]
                    size = len(held[0][0])
                    if size > MOST_WORDS:
                        yield pa.RecordBatch.from_arrays([pa.array(to_signed(held[0][0])), pa.array(held[0][1])], ["h", "c"])
                        held, size = [], 0
        if held:
            h, c = told()
            yield pa.RecordBatch.from_arrays([pa.array(to_signed(h)), pa.array(c)], ["h", "c"])

    return as_words(train).select("words").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def with_kinds(counts: DataFrame, classes: WordClasses) -> DataFrame:
    """(h, kind, c): counted words with their classes."""
    shared = counts.sparkSession.sparkContext.broadcast(classes)

    def told(batches):
        for batch in batches:
            h = batch.column(0)
            kinds = shared.value.kinds(h.to_numpy().view(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([h, pa.array(kinds), batch.column(1)], ["h", "kind", "c"])

    return counts.select("h", "c").mapInArrow(told, "h long, kind int, c long")


def count_tokens(train: DataFrame, classes: WordClasses) -> DataFrame:
    """(h, kind, c): hash, class and count of every distinct token of all training rows."""
    return with_kinds(count_words(train), classes)


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the tokens above the least count that fits ``HEAD_TOKENS``."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = 0, 0
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > HEAD_TOKENS:
            least = at + 1
            break
    rows = counts.filter(level >= least).select("h", "c").toArrow()
    h, c = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """Learn from the rows where the column ``held_out`` is false; score all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10).  Null and empty texts consist of their end alone.  An empty
    training set leaves every token unknown.  Repeated rows are counted and
    scored as often as they stand; whole texts count; other columns are not read.
    """
    rows = checkpointed(as_words(docs.select("doc_id", held_out.alias("held_out"), "text")))
    train = rows.filter(~F.col("held_out"))
    counts = checkpointed(count_words(train))
    classes = WordClasses.fitted(train, counts)
    depth, masses, total, distinct = cell_masses(with_kinds(counts, classes), classes.count)
    softmax, tree = fit_softmax(train, classes, depth, masses, total)
    log_z = math.log10(total + 0.5 * (distinct + 1))
    shared = docs.sparkSession.sparkContext.broadcast((classes, softmax.weights, softmax.features, depth, masses, tree.weights, *_head(counts)))
    kind = dict(docs.dtypes)["doc_id"]

    def score(batches):
        classes, weights, features, depth, masses, slots, head, head_counts = shared.value
        softmax, tree = Softmax(classes.count, weights, features), WordTree(depth, masses, len(slots), slots)
        log_mass = np.log10(masses)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(2)):
                part = Words(texts)
                ids, starts, hashes, kinds = part.ids, part.starts, part.hashes, classes.kinds(part.hashes)
                # Of each word: its count, -1 for those outside the head; its own part of the scores; its cell and that cell's mass.
                spot = np.minimum(np.searchsorted(head, hashes), max(0, len(head) - 1))
                count = np.where(head[spot] == hashes, head_counts[spot], -1) if len(head) else np.full(len(hashes), -1)
                own, cells = np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0), tree.cells(hashes, kinds)
                own_mass = log_mass[tree.offset[kinds] + cells]
                log_class = np.empty(len(ids))
                past = history(ids, starts, part, hashes)
                rows, tops = softmax.rows_of(past, kinds), [(h >> np.uint64(32)).astype(np.uint32) for h in past[2:]]
                for i in range(0, len(ids), 16384):
                    own_ids = ids[i : i + 16384]
                    log_class[i : i + 16384] = softmax.log_probability(rows[i : i + 16384], kinds[own_ids]) + tree.log_probability(kinds[own_ids], cells[own_ids], [h[i : i + 16384] for h in tops])
                log_class /= math.log(10)
                word = own[ids]
                length = np.diff(starts, append=len(ids))
                tail = np.flatnonzero(count[ids] < 0)
                place = np.searchsorted(starts, tail, "right") - 1
                keys, times = np.unique((place << 32) | ids[tail], return_counts=True)
                ends = np.searchsorted(keys >> 32, np.arange(len(starts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(length),
                        pa.array(np.add.reduceat((count[ids] > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(word, starts) - length * log_z),
                        pa.array(np.add.reduceat(word + log_class - own_mass[ids], starts)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(to_signed(hashes)[keys & 0xFFFFFFFF])), pa.ListArray.from_arrays(pa.array(ends), pa.array(times)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "h", "times"],
                )
                at += len(texts)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, h array<long>, times array<long>"
    scored = checkpointed(rows.mapInArrow(score, schema).withColumn("rid", F.monotonically_increasing_id()))
    tail = scored.select("rid", F.explode(F.arrays_zip("h", "times")).alias("t")).select("rid", "t.h", "t.times")
    c = F.coalesce("c", F.lit(0))
    sums = tail.join(counts.select("h", "c"), "h", "left").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("tail"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known")
    )
    return scored.drop("h", "times").join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score"),
    )


def score_corpus(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod 5 is not 1; score all."""
    return score_documents(docs, crc_residue("doc_id", 5) == 1)
