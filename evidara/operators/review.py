"""Review worksheets: validation, projection, envelopes, inventories and completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions.text import DIGEST, SAFE_NAME, occurrences
from evidara.operators.checks import difference, violations

DISPOSITIONS = ("faithful", "unfaithful", "uncertain")
PHENOMENA = ("omission", "overclaim", "contradiction", "misattribution")


def review_violations(reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """Broken rules of each review; joined by response_id, only rows that break some.

    ``reviews``: response_id, disposition, phenomena (sorted, unique), quote
    (must stand exactly once in the answer), rationale.  ``sources``: response_id, answer.
    """
    joined = reviews.join(sources.select("response_id", "answer", F.lit(True).alias("known")), "response_id", "left")
    phenomena = F.coalesce("phenomena", F.array().cast("array<string>"))
    rules = violations(
        unknown_response=F.col("known").isNull(),
        unknown_disposition=~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)),
        unknown_phenomenon=F.size(F.array_except(phenomena, F.array(*[F.lit(p) for p in PHENOMENA]))) > 0,
        unsorted_phenomena=F.array_sort(F.array_distinct(phenomena)) != phenomena,
        faithful_with_phenomena=(F.col("disposition") == "faithful") & (F.size(phenomena) > 0),
        unfaithful_without_phenomena=(F.col("disposition") == "unfaithful") & (F.size(phenomena) == 0),
        quote_not_once=F.col("quote").isNotNull() & (occurrences(F.coalesce("answer", F.lit("")), F.col("quote")) != 1),
        blank_rationale=F.trim(F.coalesce("rationale", F.lit(""))) == "",
    )
    return joined.select("response_id", rules.alias("violations")).filter(F.size("violations") > 0)


def blank_worksheet(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected rows without any label and with an empty review to fill in."""
    review = F.struct(F.lit(None).cast("string").alias("disposition"), F.array().cast("array<string>").alias("phenomena"), F.lit(None).cast("string").alias("rationale"))
    kept = [c for c in rows.columns if c not in ("gold", "predicted", "policy", "review")]
    return rows.join(selected.select("response_id").distinct(), "response_id", "left_semi").select(*kept, review.alias("review"))


def changed_content(source: DataFrame, completed: DataFrame, *content: str) -> DataFrame:
    """Rows whose content other than the review differs between source and completed worksheet, either way."""
    a, b = source.select(*content), completed.select(*content)
    return a.exceptAll(b).withColumn("side", F.lit("source")).unionByName(b.exceptAll(a).withColumn("side", F.lit("completed")))


def envelope(judgments: DataFrame, sources: DataFrame, role: str, model: str, prompt: str) -> DataFrame:
    """Judgments bound to the digest of their source row and to a frozen identity."""
    row = F.sha2(F.to_json(F.struct("answer", "claim", "response_id")).cast("binary"), 256)
    bound = sources.select("response_id", row.alias("source_sha256"))
    identity = F.sha2(F.concat_ws("|", F.lit(role), F.lit(model), F.sha2(F.lit(prompt).cast("binary"), 256), "source_sha256", "judgment").cast("binary"), 256)
    return judgments.join(bound, "response_id").select("response_id", F.lit(role).alias("role"), F.lit(model).alias("model"), "judgment", "source_sha256", identity.alias("envelope_sha256"))


def stale_envelopes(envelopes: DataFrame, judgments: DataFrame, sources: DataFrame, role: str, model: str, prompt: str) -> DataFrame:
    """Envelopes that a rebuild from the sources does not give."""
    return envelopes.join(envelope(judgments, sources, role, model, prompt).select("response_id", "envelope_sha256"), ["response_id", "envelope_sha256"], "left_anti")


def inventory_mismatches(worksheet: DataFrame, mapping: DataFrame, results: DataFrame) -> DataFrame:
    """Responses that are not in all of: worksheet (response_id, answer_sha256), mapping (response_id, line), results (line, text)."""
    lines = mapping.join(results.select("line", F.sha2(F.col("text").cast("binary"), 256).alias("result_sha256")), "line", "left")
    both = worksheet.join(lines, "response_id", "full_outer")
    return both.filter(~F.col("answer_sha256").eqNullSafe(F.col("result_sha256"))).select("response_id", "answer_sha256", "result_sha256")


def manifest_violations(manifest: dict, required: dict[str, type], digests: list[str], names: list[str]) -> list[str]:
    """Broken rules of a run manifest, on the driver: fields, types, digests, safe names, time order."""
    import re

    out = [f"unknown field {k}" for k in sorted(set(manifest) - set(required))] + [f"missing field {k}" for k in sorted(set(required) - set(manifest))]
    for key, kind in required.items():
        value = manifest.get(key)
        if key in manifest and (not isinstance(value, kind) or (kind is int and isinstance(value, bool))):
            out.append(f"{key} is not a {kind.__name__}")
    out += [f"{k} is not a digest" for k in digests if isinstance(manifest.get(k), str) and not re.fullmatch(DIGEST.strip("^$"), manifest[k])]
    out += [f"{k} is not a safe name" for k in names if isinstance(manifest.get(k), str) and not re.fullmatch(SAFE_NAME.strip("^$"), manifest[k])]
    if {"started_at", "finished_at"} <= set(manifest) and str(manifest["finished_at"]) < str(manifest["started_at"]):
        out.append("finished_at is before started_at")
    return out


def same_members(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only."""
    return difference(left, right, key)
