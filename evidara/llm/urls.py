"""URL filters: glob rules packed into multiword Shift-And masks.

All rules run at once over each canonical URL.  A rule is a row of positions;
a state word holds 64 of them.  ``*`` is a self-loop on any character, ``~`` a
self-loop that stays inside the host.  Reading one character shifts every
active position on, keeps the self-loops and masks with the positions that
accept the character, for a whole batch of URLs together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST_END = "\x01"
#: Characters that run together at most, and strings so few that they run one by one.
GROUP_CHARACTERS, FEW = 4_000_000, 8

# The rules of the contract as (name, glob over ".host" HOST_END "path", verdict).
SITE_RULES = [
    ("net/", "~.net" + HOST_END + "/*", "block"),
    ("example.net/en/", "~.example.net" + HOST_END + "/en/*", "allow"),
    ("example.com/de/", "~.example.com" + HOST_END + "/de/*", "block"),
    ("org/fr/", "~.org" + HOST_END + "/fr/*", "allow"),
]
# Globs of the method itself, for URLs that no site rule fits.
JUNK_GLOBS = [
    "*spam*" + HOST_END + "*",
    "*casino*" + HOST_END + "*",
    "*cheap-pills*" + HOST_END + "*",
    "*porn*" + HOST_END + "*",
    "~.ads." + "*" + HOST_END + "*",
    "~.doubleclick." + "*" + HOST_END + "*",
    "*" + HOST_END + "*/ads/*",
    "*" + HOST_END + "*/banner/*",
    "*" + HOST_END + "*.exe",
    "*" + HOST_END + "*.zip",
]


class ShiftAnd:
    """Glob patterns compiled to multiword masks; matches whole strings."""

    def __init__(self, patterns: list[str]):
        char_at: list[str] = []
        loops: list[str] = []
        start, final = [], []
        for pattern in patterns:
            start.append(len(char_at))
            loop = ""
            for c in pattern:
                if c in "*~":
                    loop = "*" if "*" in (c, loop) else "~"
                else:
                    loops.append(loop)
                    char_at.append(c)
                    loop = ""
            loops.append(loop)  # the position behind the last character, which only loops
            char_at.append("")
            final.append(len(char_at) - 1)
        n = len(char_at)
        self.words = max(1, -(-n // 64))
        self.alphabet = sorted({c for c in char_at if c})
        self.accept = np.zeros((len(self.alphabet) + 1, self.words), np.uint64)
        code = {c: i + 1 for i, c in enumerate(self.alphabet)}
        self.code = code
        self.loop_any, self.loop_host, self.starts = (np.zeros(self.words, np.uint64) for _ in range(3))
        for i in range(n):
            bit = np.uint64(1 << (i % 64))
            if char_at[i]:
                self.accept[code[char_at[i]], i // 64] |= bit
            if loops[i] == "*":
                self.loop_any[i // 64] |= bit
            if loops[i] == "~":
                self.loop_host[i // 64] |= bit
        for i in start:
            self.starts[i // 64] |= np.uint64(1 << (i % 64))
        self.final = [(i // 64, np.uint64(1 << (i % 64))) for i in final]

    def run(self, strings: list[str]) -> np.ndarray:
        """A row per string, a column per pattern: does it match?

        Strings run together in groups of like length, so that the characters
        held at once are bounded; a few very long ones run one by one.
        """
        out = np.zeros((len(strings), len(self.final)), bool)
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        at = 0
        while at < len(order):
            own = order[at : at + max(1, GROUP_CHARACTERS // max(1, len(strings[order[at]])))]
            if len(own) <= FEW:
                for i in own:
                    out[i] = self._one(strings[i])
            else:
                out[own] = self._group([strings[i] for i in own])
            at += len(own)
        return out

    def _one(self, string: str) -> list[bool]:
        """The same steps for one string, with all words of the state as one integer."""
        whole = lambda words: sum(int(w) << (64 * k) for k, w in enumerate(words))
        accept, loop_any, loop_host, state = [whole(row) for row in self.accept], whole(self.loop_any), whole(self.loop_host), whole(self.starts)
        for c in string:
            stay = loop_any if c == HOST_END else loop_any | loop_host
            state = ((state & accept[self.code.get(c, 0)]) << 1) | (state & stay)
        return [bool(state >> (64 * word) & int(bit)) for word, bit in self.final]

    def _group(self, strings: list[str]) -> np.ndarray:
        """Matches of strings that come longest first."""
        n, get = len(strings), self.code.get
        lengths = np.array([len(s) for s in strings])
        codes = np.zeros((n, max(1, int(lengths[0]))), np.int32)
        for row, s in enumerate(strings):
            codes[row, : len(s)] = [get(c, 0) for c in s]
        end = self.code.get(HOST_END, -1)
        state = np.tile(self.starts, (n, 1))
        for k in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -k, "left"))  # strings longer than k
            now, c = state[:live], codes[:live, k]
            moved = now & self.accept[c]
            carry = moved >> np.uint64(63)
            moved = moved << np.uint64(1)
            moved[:, 1:] |= carry[:, :-1]
            stay = now & self.loop_any
            stay |= np.where((c == end)[:, None], np.uint64(0), now & self.loop_host)
            state[:live] = moved | stay
        return np.stack([(state[:, word] & bit) != 0 for word, bit in self.final], axis=1) if self.final else np.zeros((n, 0), bool)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; '' without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#``; '' without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, site_rules=tuple(SITE_RULES), junk_globs=tuple(JUNK_GLOBS)) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict.

    The canonical URL is ``.host`` HOST_END ``path``.  Of the site rules that
    fit, the longest name decides; without one the verdict is block if a glob of
    the method matches, else allow.  A null url, or one without ``://``, has an
    empty host and path and is allowed.  Control characters stay as they are: one
    that equals HOST_END inside a host fits no rule, as no host of a rule has it.
    Repeated rows are judged each, an empty table gives none; other columns are
    not read.
    """
    names = [name for name, _, _ in site_rules]
    verdicts = [verdict for _, _, verdict in site_rules]
    by_length = sorted(range(len(names)), key=lambda i: (len(names[i]), names[i]))
    machine = ShiftAnd([glob for _, glob, _ in site_rules] + list(junk_globs))

    def judge(batches):
        for batch in batches:
            cols = {k: batch.column(k) for k in ("page_id", "host", "path")}
            urls = [f".{h}{HOST_END}{p}" for h, p in zip(cols["host"].to_pylist(), cols["path"].to_pylist(), strict=True)]
            hits = machine.run(urls)
            rule = np.full(len(urls), -1)
            for i in by_length:
                rule[hits[:, i]] = i
            junk = hits[:, len(names) :].any(axis=1) if len(junk_globs) else np.zeros(len(urls), bool)
            cols["rule"] = pa.array([names[i] if i >= 0 else None for i in rule], pa.string())
            cols["verdict"] = pa.array([verdicts[i] if i >= 0 else ("block" if j else "allow") for i, j in zip(rule, junk, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).mapInArrow(
        judge, f"page_id {kind}, host string, path string, rule string, verdict string"
    )
