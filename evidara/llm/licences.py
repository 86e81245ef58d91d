"""Licence scans: a trained paragraph classifier, confirmed against templates.

Paragraphs are classified by a sparse multinomial logistic regression over hashed
word 1- and 2-grams into licence families or ``unknown``.  A line is a paragraph;
lines that are wrapped (the one before ends inside a sentence) are also read as
one, and long ones in overlapping windows.  The model is trained on varied
templates, on negated ones (as unknown) and on a bounded sample of the corpus's
own lines, and its probabilities are calibrated by a temperature on a part kept
aside.  A prediction counts only if the paragraph also holds enough of one of the
family's templates, among it a 2-gram that no other family's templates have, and
does not deny it.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.runtime import runs

UNKNOWN = "unknown"
# Usual statements of each licence family, and pieces of the licences' own texts.
TEMPLATES = {
    "agpl-3.0": [
        "licensed under the gnu affero general public license version 3", "released under the agpl v3 license", "spdx license identifier agpl 3.0 only", "spdx license identifier agpl 3.0 or later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2.0", "you may obtain a copy of the license at http www apache org licenses license 2.0", "released under the apache 2.0 license", "spdx license identifier apache 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3 clause license", "released under the bsd license", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 2 clause",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "spdx license identifier cc by nc 4.0"],
    "cc-by-sa": [
        "licensed under cc by sa 4.0", "text is available under the creative commons attribution sharealike license", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "spdx license identifier cc by sa 4.0",
    ],
    "cc0": ["released under cc0 1.0 universal public domain dedication", "to the extent possible under law the author has waived all copyright to this work", "spdx license identifier cc0 1.0"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "licensed under the gpl v2", "spdx license identifier gpl 3.0 or later", "spdx license identifier gpl 2.0 only",
        "you should have received a copy of the gnu general public license along with this program",
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2.1", "released under the lgpl license", "spdx license identifier lgpl 2.1 only", "spdx license identifier lgpl 3.0 or later",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ],
    "mit": [
        "released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "proprietary": ["all rights reserved", "all rights reserved no part of this work may be reproduced without permission", "proprietary and confidential unauthorized copying of this file is strictly prohibited"],
}
# Words that, up to three words before a statement, deny it.
DENIALS = frozenset("not never neither nor without isn wasn aren cannot longer".split())
# Sentences that speak of licences or rights without granting one.
NEAR_MISSES = [
    "he renewed his driving license last week", "the license fee was paid in full", "open the file and read it", "the public library is free of charge",
    "they won the general election with a large majority", "version 3 of the report is available", "this work is based on the earlier study", "released last year under a different title",
    "the apache helicopter landed", "students at mit built a robot", "the software is free", "all rights of way are shown on the map", "under the terms of the agreement the company pays",
]
WINDOW, STRIDE = 64, 32
#: Characters from which a line that ends inside a sentence is taken for wrapped.
WRAPPED = 40
ROWS = 1 << 15
#: Paragraphs of the corpus that the classifier learns as unknown (about; lowest hash first).
FIT_PARAGRAPHS = 4000
#: Varied copies of each template that are learnt, and statements of two families for each of them.
COPIES, PAIRS = 60, 4
#: Least calibrated probability that a window states some licence (among much prose it is low), and least share of a template's 2-grams in it.
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.15, 0.6
#: Least calibrated probability of a family in a window that states some licence.
LEAST_FAMILY = 0.05
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def paragraphs(text: str | None) -> list[tuple[int, list[str], bool]]:
    """(number of the first line, words, wrapped) of every line that has words, and of every run of wrapped lines.

    A line goes on in the next one if it has ``WRAPPED`` characters or more and ends inside a sentence.
    """
    out, run, first, before = [], [], 0, ""
    for number, line in enumerate(text.split("\n") if text else []):
        words = words_of(line)
        goes_on = bool(run) and bool(words) and len(before) >= WRAPPED and before[-1] not in ".!?"
        if not goes_on:
            if len(run) > 1:
                out.append((first, [w for x in run for w in x], True))
            run, first = [], number
        if words:
            run.append(words)
            out.append((number, words, False))
        before = line.rstrip()
    if len(run) > 1:
        out.append((first, [w for x in run for w in x], True))
    return out


def windows(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(paragraph number, place of the first word, words) of every window of every paragraph that has words."""
    return [(number, at, words) for number, at, words, _ in marked_windows(text)]


def marked_windows(text: str | None) -> list[tuple[int, int, list[str], bool]]:
    """As ``windows``, with whether the paragraph is a run of wrapped lines."""
    out = []
    for number, words, wrapped in paragraphs(text):
        if len(words) <= WINDOW:
            out.append((number, 0, words, wrapped))
        else:
            out += [(number, at, words[at : at + WINDOW], wrapped) for at in range(0, len(words) - WINDOW + STRIDE, STRIDE)]
    return out


class _Rows(dict):
    """Word -> hash, filled as words appear."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word)
        return value


def gram_rows(units: list[list[str]], hashes: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the 1-grams and of the 2-grams that begin at each word, and where units begin."""
    sizes = np.array([len(u) for u in units])
    h = np.fromiter((hashes[w] for u in units for w in u), np.int64, int(sizes.sum()))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    pair = (h * 31 + np.roll(h, -1) * 17 + 7) % 1000003 % (ROWS - 1) + ROWS
    pair[starts + sizes - 1] = 2 * ROWS  # no 2-gram begins at a unit's last word
    return h % ROWS, pair, starts


class LicenceModel:
    """Hashed multinomial logistic regression; the last class is unknown."""

    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.families, self.weights, self.bias, self.temperature = families, weights, bias, temperature

    def logits(self, one: np.ndarray, two: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.weights[one] + self.weights[two], starts, axis=0)
        n = np.diff(starts, append=len(one))
        return sums / np.sqrt(2 * n)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def similarity(words: list[str], family: str) -> float:
    """The largest share of one of the family's templates' 2-grams that ``words`` states; 0 where none is stated.

    A template is stated if ``words`` also has a 2-gram of it that no other
    family's templates have, and no denial stands up to three words before it.
    """
    places: dict[tuple[str, str], int] = {}
    for i, gram in enumerate(zip(words, words[1:], strict=False)):
        places.setdefault(gram, i)
    best = 0.0
    for template in TEMPLATES[family]:
        grams = _template_grams(template)
        shared = grams & places.keys()
        share = len(shared) / len(grams)
        if share <= best or not shared & _own_grams(family):
            continue
        first = min(places[g] for g in shared)
        # A statement's beginning may lie a few words before the first shared 2-gram.
        if share >= LEAST_SIMILARITY and not DENIALS.isdisjoint(words[max(0, first - 3) : first + 1]):
            continue
        best = share
    return best


_OWN: dict[str, set] = {}


def _own_grams(family: str) -> set:
    """The 2-grams of a family's templates that no other family's have."""
    if not _OWN:
        for name, own in TEMPLATES.items():
            others = {g for other, templates in TEMPLATES.items() if other != name for t in templates for g in _template_grams(t)}
            _OWN[name] = {g for t in own for g in _template_grams(t)} - others
    return _OWN[family]


_GRAMS: dict[str, set] = {}


def _template_grams(template: str) -> set:
    if template not in _GRAMS:
        w = words_of(template)
        _GRAMS[template] = set(zip(w, w[1:], strict=False))
    return _GRAMS[template]


def training_units(corpus: list[str], seed: int = 11, copies: int = COPIES, pairs: int = PAIRS) -> tuple[list[list[str]], np.ndarray]:
    """Varied templates with their family's number, unknown paragraphs, and ``copies * pairs`` statements of two families."""
    r = random.Random(seed)
    families = sorted(TEMPLATES)
    others = [w for p in corpus for _, _, w in windows(p)]
    pool = [w for u in others for w in u] or ["text"]
    units, labels = [], []
    for k, family in enumerate(families):
        for template in TEMPLATES[family]:
            base = words_of(template)
            for _ in range(copies):
                words = [w for w in base if r.random() > 0.06] or base
                if r.random() < 0.3:
                    words = ["copyright", "c", str(r.randint(1990, 2026)), *r.choices(pool, k=r.randint(1, 3)), *words]
                if r.random() < 0.5:
                    # Prose around it, at times as much as a window holds.
                    free = max(0, (WINDOW if r.random() < 0.4 else len(words) + 24) - len(words))
                    front = r.randint(0, free)
                    words = r.choices(pool, k=front) + words + r.choices(pool, k=r.randint(0, free - front))
                units.append(words[:WINDOW])
                labels.append(k)
                if r.random() < 0.15 and base[0] not in ("all", "spdx"):
                    units.append([*r.choices(pool, k=r.randint(0, 4)), *r.choice((["is", "not"], ["are", "not"], ["never"], ["is", "no", "longer"])), *base][:WINDOW])
                    labels.append(len(families))
    for miss in NEAR_MISSES:
        for _ in range(copies // 4):
            units.append((r.choices(pool, k=r.randint(0, 10)) + words_of(miss) + r.choices(pool, k=r.randint(0, 10)))[:WINDOW])
            labels.append(len(families))
    for words in others:
        if all(similarity(words, f) < LEAST_SIMILARITY for f in families):
            units.append(words)
            labels.append(len(families))
    # Statements of two families: a unit for each of them.
    for _ in range(copies * pairs):
        a, b = r.sample(range(len(families)), 2)
        both = [*words_of(r.choice(TEMPLATES[families[a]])), r.choice(("or", "and", "at")), *r.choices(pool, k=r.randint(0, 2)), *words_of(r.choice(TEMPLATES[families[b]]))]
        units += [both[:WINDOW], both[:WINDOW]]
        labels += [a, b]
    return units, np.array(labels)


def fit(corpus: list[str], rounds: int = 40, rate: float = 0.5) -> LicenceModel:
    """Train on four fifths of the units, calibrate the temperature on the rest."""
    families = sorted(TEMPLATES)
    units, labels = training_units(corpus)
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(units))
    k = len(families) + 1
    model = LicenceModel([*families, UNKNOWN], np.zeros((2 * ROWS + 1, k), np.float32), np.zeros(k, np.float32))
    squares, bias_squares = np.full_like(model.weights, 1e-2), np.full_like(model.bias, 1e-2)
    aside, used = order[::5], np.delete(order, np.s_[::5])
    hashes = _Rows()
    for _ in range(rounds):
        for at in range(0, len(used), 512):
            own = used[at : at + 512]
            one, two, starts = gram_rows([units[i] for i in own], hashes)
            g = model.probabilities(model.logits(one, two, starts))
            g[np.arange(len(own)), labels[own]] -= 1.0
            n = np.diff(starts, append=len(one))
            per_word = np.repeat(g / np.sqrt(2 * n)[:, None], n, axis=0)
            for rows in (one, two):
                by = np.argsort(rows, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], rows[by][1:] != rows[by][:-1])))
                touched, sums = rows[by][first], np.add.reduceat(per_word[by], first, axis=0)
                squares[touched] += sums**2
                model.weights[touched] -= rate * sums / np.sqrt(squares[touched])
            total = g.sum(axis=0)
            bias_squares += total**2
            model.bias -= rate * total / np.sqrt(bias_squares)
            model.weights[2 * ROWS] = 0.0
    one, two, starts = gram_rows([units[i] for i in aside], hashes)
    logits, truth = model.logits(one, two, starts), labels[aside]

    def loss(t):
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(truth)), truth], 1e-12)).mean()

    model.temperature = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
    return model


def held_out(model: LicenceModel, corpus: list[str], seed: int = 77, copies: int = 20) -> dict[str, float]:
    """Accuracy and expected calibration error (ten bins) on freshly varied units that the model has not seen."""
    units, labels = training_units(corpus, seed, copies, pairs=0)
    p = model.probabilities(model.logits(*gram_rows(units, _Rows())))
    right, sure = p.argmax(axis=1) == labels, p.max(axis=1)
    bins = np.minimum((sure * 10).astype(int), 9)
    gap = sum(abs(right[bins == b].mean() - sure[bins == b].mean()) * (bins == b).mean() for b in range(10) if (bins == b).any())
    return {"units": len(units), "accuracy": float(right.mean()), "calibration_error": float(gap)}


def sample_lines(docs: DataFrame, paragraphs: int = FIT_PARAGRAPHS) -> list[str]:
    """At most ``paragraphs`` distinct lines of 8 to 2,000 characters, those of lowest hash: the same for the same table."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("p")).filter(F.length("p").between(8, 2000))
    h = F.xxhash64("p")
    n = lines.count()
    share = int((1 << 30) * min(1.0, 2 * paragraphs / max(1, n)))
    # A share by hash first, so that only about twice the sample is sorted.
    some = lines.filter(F.pmod(h, F.lit(1 << 30)) <= share).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["p"] for r in some.orderBy(F.pmod(h, F.lit(1 << 30)), "p").limit(paragraphs).collect())


def fit_on(docs: DataFrame, paragraphs: int = FIT_PARAGRAPHS) -> LicenceModel:
    """Fit with a bounded sample of the corpus's lines as unknown ones (see ``sample_lines``)."""
    return fit(sample_lines(docs, paragraphs))


def w_lines(text: str, first: int) -> int:
    """How many lines the run of wrapped lines that begins at a line has behind it."""
    lines, n = text.split("\n"), 0
    while first + n + 1 < len(lines) and lines[first + n + 1].strip() and len(lines[first + n].rstrip()) >= WRAPPED and lines[first + n].rstrip()[-1] not in ".!?":
        n += 1
    return n


def scan_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """The licences that each document states.

    Returns doc_id, n_paragraphs, n_licences, families (distinct, sorted, comma-joined)
    and licences: for each confirmed statement its paragraph, family, calibrated probability and similarity to the template.
    A null or empty text has no paragraph and no licence; a paragraph is a line
    that has words.  Of a paragraph that is split into windows, every family
    counts, and a family again where it is stated again; overlapping windows of
    one family count once, with the best.  What only a run of wrapped lines states has the
    number of its first line.
    Repeated rows are scanned each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_on(docs))
    kind = dict(docs.dtypes)["doc_id"]
    found_type = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches):
        model, hashes = shared.value, _Rows()
        for batch in batches:
            at = 0
            for texts in runs(batch.column(1)):
                units = [(d, n, place, w, wrapped) for d, t in enumerate(texts) for n, place, w, wrapped in marked_windows(t)]
                rows: list[list[dict]] = [[] for _ in texts]
                last: dict[tuple, tuple[int, dict]] = {}  # of each document, paragraph and family: its last window and statement
                sizes = [0] * len(texts)
                for d, _, place, _, wrapped in units:
                    sizes[d] += place == 0 and not wrapped
                if units:
                    p = model.probabilities(model.logits(*gram_rows([u[3] for u in units], hashes)))
                    said_some = np.flatnonzero(p[:, -1] < 1 - LEAST_PROBABILITY).tolist()
                    # Lines first: what they state is not told again by the run of wrapped lines that they are in.
                    for i in sorted(said_some, key=lambda i: units[i][4]):
                        d, n, place, w, wrapped = units[i]
                        for k in np.flatnonzero(p[i, :-1] >= LEAST_FAMILY).tolist():
                            family = model.families[k]
                            alike = similarity(w, family)
                            if alike < LEAST_SIMILARITY or (wrapped and any(x["family"] == family and n <= x["paragraph"] <= n + w_lines(texts[d], n) for x in rows[d])):
                                continue
                            now = {"paragraph": n, "family": family, "probability": float(p[i, k]), "similarity": alike}
                            before, said = last.get((d, n, family), (-WINDOW, now))
                            if place - before >= WINDOW:
                                rows[d].append(now)
                                said = now
                            elif said["probability"] < now["probability"]:
                                said.update(now)
                            last[d, n, family] = place, said
                    for x in rows:
                        x.sort(key=lambda y: y["paragraph"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array([len(x) for x in rows], pa.int64()), pa.array([",".join(sorted({y["family"] for y in x})) for x in rows]), pa.array(rows, found_type)],
                    ["doc_id", "n_paragraphs", "n_licences", "families", "licences"],
                )
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_paragraphs long, n_licences long, families string, licences array<struct<paragraph:int,family:string,probability:double,similarity:double>>"
    )
