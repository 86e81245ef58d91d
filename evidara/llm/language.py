"""Language ID by rank-order profiles and out-of-place distance.

A profile is the list of a language's most frequent letter n-grams (1 to 3).  A
document's own most frequent n-grams are compared with each profile: every
n-gram costs the difference of its two ranks, or the profile's length where the
profile lacks it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.llm.runtime import crc_residue, giving_back, slices

UNDETERMINED = "und"
PROFILE_GRAMS = 400
DOCUMENT_GRAMS = 300
#: Documents of each language that the profiles are fitted on (about; picked by hash).
FIT_PER_LANGUAGE = 1500
#: Values of lang whose counts may be broadcast.
MOST_BROADCAST_LANGUAGES = 10_000

_LETTER: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point: is it a letter?  Built once per worker."""
    if "is" not in _LETTER:
        _LETTER["is"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER["is"]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_counts(text: str) -> Counter:
    """Letter 1- to 3-grams of one text as strings; '_' stands for any gap between words."""
    letters = _letters()
    points = _code_points(text)
    kept = "".join(chr(c) if ok else "_" for c, ok in zip(points.tolist(), letters[points].tolist(), strict=True))
    out: Counter = Counter()
    for word in filter(None, kept.split("_")):
        padded = f"_{word}_"
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


class RankProfiles:
    """Profiles of all languages in arrays: n-gram codes, and their rank in each."""

    def __init__(self, profiles: dict[str, list[str]], document_grams: int = DOCUMENT_GRAMS):
        self.languages = sorted(profiles)
        self.document_grams = document_grams
        self.penalty = max([1, *(len(p) for p in profiles.values())])
        alphabet = sorted({c for p in profiles.values() for g in p for c in g} - {"_"})
        self.other, self.base = len(alphabet) + 1, len(alphabet) + 2
        self.index = {c: i + 1 for i, c in enumerate(alphabet)}
        codes = {g: self._code(g) for p in profiles.values() for g in p}
        self.codes = np.array(sorted(codes.values()), np.int64)
        at = {c: i for i, c in enumerate(self.codes.tolist())}
        self.ranks = np.full((len(self.languages), len(self.codes) + 1), -1, np.int64)
        for row, language in enumerate(self.languages):
            for rank, gram in enumerate(profiles[language]):
                self.ranks[row, at[codes[gram]]] = rank
        self.table: np.ndarray | None = None

    def _code(self, gram: str) -> int:
        out = 0
        for c in gram:
            out = out * self.base + (0 if c == "_" else self.index[c])
        return out * 4 + len(gram)

    def _lookup(self) -> np.ndarray:
        if self.table is None:
            table = np.where(_letters(), self.other, 0).astype(np.int64)
            for c, i in self.index.items():
                table[ord(c)] = i
            self.table = table
        return self.table

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / largest possible distance."""
        if not text or not self.languages:
            return UNDETERMINED, 0.0
        ids = self._lookup()[_code_points(text)]
        if not ids.any():
            return UNDETERMINED, 0.0
        ids = np.concatenate(([0], ids, [0]))
        ids = ids[(ids != 0) | np.concatenate(([True], ids[:-1] != 0))]
        one, b = ids[ids != 0], self.base
        two = ids[:-1] * b + ids[1:]
        middle = ids[1:-1] != 0
        three = ((ids[:-2] * b + ids[1:-1]) * b + ids[2:])[middle]
        codes, counts = np.unique(np.concatenate((one * 4 + 1, two * 4 + 2, three * 4 + 3)), return_counts=True)
        # Ties: the smaller code first; np.unique has sorted them already.
        top = np.argsort(-counts, kind="stable")[: self.document_grams]
        codes = codes[top]
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == codes
        ranks = self.ranks[:, np.where(known, at, len(self.codes))]
        cost = np.where(ranks < 0, self.penalty, np.minimum(np.abs(ranks - np.arange(len(codes))), self.penalty))
        total = cost.sum(axis=1)
        best = int(np.argmin(total))
        return self.languages[best], float(1.0 - total[best] / (self.penalty * len(codes)))


def fit_profiles(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE, grams: int = PROFILE_GRAMS) -> dict[str, list[str]]:
    """Profiles from a bounded sample: about ``per_language`` rows of each lang, picked by hash.

    Rows with a null text or lang teach nothing.  The driver receives ``grams``
    n-grams a language.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.count() <= MOST_BROADCAST_LANGUAGES
    share = F.least(F.lit(float(1 << 30)), F.lit(float(1 << 30) * per_language) / F.col("n"))
    sample = (
        usable.join(F.broadcast(sizes) if few else sizes, "lang")
        .filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share)
        .select("lang", "text")
    )

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(gram_counts(text))
            rows = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(giving_back(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= grams).orderBy("lang", "rank").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict_language(docs: DataFrame, profiles: dict[str, list[str]], keep: tuple[str, ...] = ("doc_id",), pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Append the predicted language and its score to the columns ``keep``.

    A null text, an empty one and one without a letter give ``und`` and 0; so
    does everything if no language was learnt.  Whole texts count, however long.
    Of languages at the same distance the first by name is taken.
    Only the text is an input.  Rows are neither merged nor dropped; where ``keep`` has a column of an
    output's name, choose other names with ``pred`` and ``score``.
    """
    model = RankProfiles(profiles)
    names = [*keep]

    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(len(names)).to_pylist()]
            arrays = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*names, pred, score])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{pred}` string, `{score}` double"
    return docs.select(*names, F.col("text").alias("__text")).mapInArrow(run, schema)


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter at all."""
    return bool(text) and bool(_letters()[_code_points(text)].any())


def keep_identified(docs: DataFrame, profiles: dict[str, list[str]], least: float) -> DataFrame:
    """The rows whose text has a letter and a language score of at least ``least``, with all their columns.

    If no language was learnt, there is nothing that a text could be unlike: all rows with a letter stay.
    """
    model = RankProfiles(profiles)

    def kept(text: str | None) -> bool:
        if not model.languages:
            return has_letter(text)
        lang, score = model.predict(text)
        return lang != UNDETERMINED and score >= least

    def run(batches):
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):  # so that few texts at a time stand in Python and in the output
                yield batch.slice(at, len(texts)).filter(pa.array([kept(t) for t in texts.to_pylist()], pa.bool_()))
                at += len(texts)

    return docs.mapInArrow(giving_back(run), docs.schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fit on the documents whose crc32(doc_id) mod 4 is not 2, predict all.

    Returns doc_id, held_out, lang_pred, score; see ``predict_language`` for
    nulls and empty texts.  An empty table gives an empty result.
    """
    held = crc_residue("doc_id", 4) == 2
    profiles = fit_profiles(docs.filter(~held))
    return predict_language(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")
