"""Text column functions; native unless the name says ``_udf``."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}0-9]+"
ABSTENTION = "INSUFFICIENT EVIDENCE"
DIGEST = r"^[0-9a-f]{64}$"
_UNIT = re.compile(r"\r\n|.", re.S)
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def title_of(text: Column) -> Column:
    """The trimmed first line of a text that has several lines, else ''."""
    at = F.locate("\n", text)
    return F.when(at > 0, F.trim(F.substring_index(text, "\n", 1))).otherwise(F.lit(""))


def body_of(text: Column) -> Column:
    """What follows the first line; the whole text if it is the only one."""
    at = F.locate("\n", text)
    return F.when(at > 0, text.substr(at + 1, F.length(text))).otherwise(text)


def split_bucket(identifier: Column, buckets: int = 5) -> Column:
    """sha256(identifier) as a number, modulo 5: 16 is 1 modulo 5, so the hex digits are summed."""
    if buckets not in (3, 5, 15):
        raise ValueError("only divisors of 15 leave 16 congruent to 1")
    digest = F.sha2(identifier.cast("string").cast("binary"), 256)
    # The sum of digits from counts: 15 translations, no array of 64 strings.
    total = F.lit(0)
    for value, digit in enumerate("0123456789abcdef"):
        if value:
            total = total + F.lit(value) * (F.lit(64) - F.length(F.translate(digest, digit, "")))
    return F.pmod(total, F.lit(buckets))


def citations(answer: Column) -> Column:
    """Identifiers in square brackets, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]+)\]"), 1))


def verdict(answer: Column, options: tuple[str, ...] = ("SUPPORTED", "CONTRADICTED", "INSUFFICIENT")) -> Column:
    """The verdict named on the first line, or null."""
    found = F.regexp_extract(answer, rf"\AVERDICT: ({'|'.join(options)})(?:\r?\n|\z)", 1)
    return F.when(found != "", found)


def verdict_rest(answer: Column, options: tuple[str, ...] = ("SUPPORTED", "CONTRADICTED", "INSUFFICIENT")) -> Column:
    """What follows the verdict's line, trimmed; the trimmed whole without one."""
    return F.regexp_replace(F.regexp_replace(answer, rf"\AVERDICT: ({'|'.join(options)})(?:\r?\n|\z)", ""), r"\A\s+|\s+\z", "")


# The verdicts that an evaluated answer may begin with.
STANCES = ("SUPPORT", "CONTRADICT", "NOT_ENOUGH_INFO")
_ENDS = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def stripped(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, _ENDS, "")


def stance_verdict(answer: Column) -> Column:
    """The stance that a stripped answer names on its first line, or null."""
    return verdict(stripped(answer), STANCES)


def stance_rest(answer: Column) -> Column:
    """The stripped answer behind its stance; all of it where it names none."""
    return stripped(verdict_rest(stripped(answer), STANCES))


def occurrences(text: Column, quote: Column) -> Column:
    """How often ``quote`` stands in ``text``, overlaps included; 0 for an empty quote."""
    escaped = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.length(quote) > 0, F.regexp_count(text, escaped)).otherwise(F.lit(0))


def canonical_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def sanitised_error(message: Column, most: int = 240, kind: Column | None = None) -> Column:
    """White space collapsed, URLs redacted, at most ``most`` characters; behind the error's ``kind``, if it is given."""
    redacted = F.regexp_replace(F.trim(F.regexp_replace(message, r"\s+", " ")), r"https?://\S+", "<redacted-url>" if kind is not None else "[redacted-url]")
    short = F.left(F.trim(redacted), F.lit(most))
    return short if kind is None else F.concat(kind, F.lit(": "), short)


def plain_normalised(text: Column) -> Column:
    """White space collapsed, trimmed, lower-cased: equals ``normalised_udf`` on ASCII."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _each(text: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """The changed texts; of a batch one text at a time is a Python string."""
    return pa.array((change(t.as_py()) if t.is_valid else None for t in text), pa.string(), size=len(text))


@F.arrow_udf(T.StringType())
def normalised_udf(text: pa.Array) -> pa.Array:
    """NFKC, white space collapsed, case folded."""
    return _each(text, lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


@F.arrow_udf(T.StringType())
def nfkc_udf(text: pa.Array) -> pa.Array:
    """NFKC and nothing else."""
    return _each(text, lambda t: unicodedata.normalize("NFKC", t))


def canonical_key(text: Column) -> Column:
    """NFKC, lower case, white space collapsed, without punctuation at either end; only NFKC leaves the JVM."""
    folded = F.trim(F.regexp_replace(F.lower(nfkc_udf(text)), r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(folded, r"^\p{P}+|\p{P}+$", ""))


def canonical_key_udf(text: Column) -> Column:
    """As ``canonical_key``."""
    return canonical_key(text)


@F.pandas_udf(T.StringType())
def unescaped_udf(text: pd.Series) -> pd.Series:
    """HTML character references decoded."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def span_status(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """How a recorded half-open span relates to the text.

    ``exact``: the span holds the quote; ``inclusive``: it does with its end counted in;
    ``trimmed``: up to white space at the ends; ``elsewhere``: the quote stands
    once, but at another place; ``ambiguous``: several times; ``out-of-range``,
    ``missing`` (a null) and ``absent`` say the rest.
    """
    n = F.length(text)
    here = text.substr(start + 1, end - start)
    longer = text.substr(start + 1, end - start + 1)
    count = occurrences(text, quote)
    return (
        F.when(text.isNull() | quote.isNull() | start.isNull() | end.isNull(), F.lit("missing"))
        .when((start < 0) | (end < start) | (end > n), F.lit("out-of-range"))
        .when(here == quote, F.lit("exact"))
        .when(longer == quote, F.lit("inclusive"))
        .when(F.trim(here) == F.trim(quote), F.lit("trimmed"))
        .when(count == 1, F.lit("elsewhere"))
        .when(count > 1, F.lit("ambiguous"))
        .otherwise(F.lit("absent"))
    )


def rights_class(licence_text: Column) -> Column:
    """Rights named by a licence URL: public-domain, attribution, share-alike, non-commercial, no-derivatives, other, none."""
    path = F.regexp_extract(F.lower(F.coalesce(licence_text, F.lit(""))), r"creativecommons\.org/(licenses/[a-z-]+|publicdomain/[a-z]+)", 1)
    return (
        F.when(path.startswith("publicdomain"), F.lit("public-domain"))
        .when(path.contains("-nc"), F.lit("non-commercial"))
        .when(path.contains("-nd"), F.lit("no-derivatives"))
        .when(path.contains("-sa"), F.lit("share-alike"))
        .when(path == "licenses/by", F.lit("attribution"))
        .when(F.coalesce(licence_text, F.lit("")) == "", F.lit("none"))
        .otherwise(F.lit("other"))
    )


def parse_utc(value: Column) -> Column:
    """The timestamp of an ISO date and time that says UTC (``Z`` or ``+00:00``), else null."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|\+00:00)$"
    return F.when(value.rlike(shape), F.try_to_timestamp(value))


def seconds_between(started: Column, finished: Column) -> Column:
    """Seconds from one UTC text to another, null where one is no UTC time or the order is wrong."""
    a, b = parse_utc(started), parse_utc(finished)
    return F.when(b >= a, F.timestamp_diff("MICROSECOND", a, b) / 1e6)


def is_relative_path(path: Column) -> Column:
    """Whether a path stays inside its folder: not blank, not absolute, no ``..`` part, no backslash."""
    return (F.trim(path) != "") & ~path.startswith("/") & ~path.contains("\\") & ~F.array_contains(F.split(path, "/"), "..")


def canonical_object(**fields: Column) -> Column:
    """A flat JSON object with sorted keys, no spaces and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def identity(parent: Column, **fields: Column) -> Column:
    """A link of an identity chain: the digest of the canonical object with its parent's digest in it."""
    return F.sha2(canonical_object(parent=parent, **fields).cast("binary"), 256)


# The classes of rights that a text's Creative Commons links give it.
RIGHTS_NONE, RIGHTS_SEVERAL, RIGHTS_ND, RIGHTS_NC, RIGHTS_FREE, RIGHTS_SA = (
    "unresolved_custom_or_missing", "unresolved_conflicting_licenses", "unresolved_no_derivatives", "noncommercial_research_conditional", "attribution_research_candidate", "unresolved_sharealike",
)
# The Creative Commons licences and versions that count; of the public-domain tools only the dedication does.
CC_CODES = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def licence_links(text: Column) -> Column:
    """The distinct licences that a text links, as sorted ``code/version``.

    Addresses end at white space, quotes, brackets, commas and semicolons; a
    full stop and a slash at their end do not count.
    """
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\"'<>(),;]+")
    places = F.transform(words, lambda w: F.regexp_replace(F.regexp_extract(w, "https?://(?:www[.])?(.*)", 1), "/?[.]?$", ""))
    parts = F.transform(places, lambda p: F.split(p, "/"))

    def counts(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        licence = (at(1) == "licenses") & at(2).isin(*CC_CODES) & at(3).isin(*CC_VERSIONS)
        return (F.size(p) == 4) & (at(0) == "creativecommons.org") & (licence | ((at(1) == "publicdomain") & (at(2) == "zero") & (at(3) == "1.0")))

    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, counts), lambda p: F.concat_ws("/", F.get(p, F.lit(2)), F.get(p, F.lit(3))))))


def link_rights(text: Column) -> Column:
    """The class of rights of a text by its licence links; several different ones, or none, leave it unresolved."""
    found = licence_links(text)
    code = F.substring_index(F.get(found, F.lit(0)), "/", 1)
    return (
        F.when(F.size(found) == 0, RIGHTS_NONE).when(F.size(found) > 1, RIGHTS_SEVERAL).when(code.endswith("-nd"), RIGHTS_ND).when(code.contains("-nc"), RIGHTS_NC).when(code.isin("by", "zero"), RIGHTS_FREE).otherwise(RIGHTS_SA)
    )


@F.pandas_udf(T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("bytes", T.ArrayType(T.IntegerType()))]))
def newline_boundaries_udf(text: pd.Series) -> pd.DataFrame:
    """For every boundary of the text with one kind of line end: its place in the raw text, in characters and in UTF-8 bytes."""
    chars, octets = [], []
    for t in text:
        units = [] if t is None else _UNIT.findall(t)
        chars.append([0, *accumulate(map(len, units))])
        octets.append([0, *accumulate(len(u.encode("utf-8", "surrogatepass")) for u in units)])
    return pd.DataFrame({"chars": chars, "bytes": octets})
