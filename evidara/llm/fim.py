"""Fill-in-middle transformation: cuts at token offsets that a Split pre-tokenizer supplies.

The pre-tokenizer isolates every match of a pattern and needs no training; the
number of offsets of a text is its number of tokens, and the offsets of the
drawn ranks are the places of the cuts.  All draws are hashed from the row's
key, so a row that is computed again gives the same output.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.runtime import runs

#: Tokens: runs of ASCII letters, and every other character.
TOKEN_PATTERN = "[A-Za-z]+|[^A-Za-z]"
#: Isolating the characters that are tokens of their own leaves the runs between them as the other tokens.
SINGLE_PATTERN = "[^A-Za-z]"
#: A text may be taken apart behind such a character.
SINGLE = re.compile(SINGLE_PATTERN)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are cut, and how many of those have their suffix first.
CUT_RATE, SUFFIX_FIRST_RATE = 90, 20
#: Characters that go to the pre-tokenizer at once.
PIECE_CHARS = 1 << 10


def token_starts(text: str, split, piece: int = PIECE_CHARS) -> np.ndarray:
    """Code-point offsets of a text's tokens; it goes to the pre-tokenizer in pieces that end behind a single."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > piece:
            found = SINGLE.search(text, at + piece)
            end = found.end() if found else end
        out.append(np.array([offsets[0] for _, offsets in split.pre_tokenize_str(text[at:end])], np.int64) + at)
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int64)


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of the SHA-256 of ``seed:key`` (null: an empty key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """Every whole text with its middle moved to the end: ``key``, n, form, output, prefix_chars, middle_chars.

    A text is plain, and its own output, if it is empty or null, holds one of
    the three marks, or is not drawn; prefix_chars and middle_chars are then
    null.  Rows with equal keys and texts get equal outputs; a null key draws
    like the empty one.  Other columns are not read.
    """
    kind = dict(docs.dtypes)[key]

    def transform(batches):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(SINGLE_PATTERN), behavior="isolated")
        for batch in batches:
            at = 0
            for texts in runs(batch.column(5)):
                h1, h2, h3, h4 = (batch.column(i).slice(at, len(texts)).to_pylist() for i in range(1, 5))
                rows = [_transformed(t, token_starts(t, split), *h) for t, *h in zip(texts, h1, h2, h3, h4, strict=True)]
                n, form, output, prefix, middle = zip(*rows, strict=True)
                values = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(output, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *values], [key, "n", "form", "output", "prefix_chars", "middle_chars"])
                at += len(texts)

    drawn = docs.select(key, *[h.alias(f"__h{i}") for i, h in enumerate(draws(F.col(key), seed))], F.coalesce("text", F.lit("")).alias("__text"))
    return drawn.mapInArrow(transform, f"`{key}` {kind}, n long, form string, output string, prefix_chars long, middle_chars long")


def _transformed(text: str, starts: np.ndarray, h1: int, h2: int, h3: int, h4: int) -> tuple:
    n = len(starts)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= CUT_RATE:
        return n, "plain", text, None, None
    low, high = (int(starts[i]) if i < n else len(text) for i in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SUFFIX_FIRST_RATE:
        return n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", low, high - low
    return n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", low, high - low


def restored(output: Column, form: Column) -> Column:
    """The text of an output: the parts between its marks in the order of the form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
