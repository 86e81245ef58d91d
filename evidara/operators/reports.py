"""Run reports: generation, evidence, readers, audits, evaluation sets, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.numeric import round_to
from evidara.functions.strict_json import json_problem, nested_keys
from evidara.functions.text import plain_normalised
from evidara.operators.ranks import placed, with_medians


def _rate(condition: Column, within: Column | None = None) -> Column:
    """Share of rows where a condition holds among those where it is known (and ``within`` holds)."""
    value = condition.cast("int")
    if within is not None:
        value = F.when(within, value)
    return round_to(F.avg(value))


def generation_report(results: DataFrame) -> DataFrame:
    """Per context policy the rates and medians of generation results; nulls stay out of each denominator.

    ``results``: policy, error_type, relevant_retrieved, evidence_recall,
    citation_valid, answer, stance_correct, contexts, input_tokens,
    generated_tokens, generator_ms.
    """
    ok = F.col("error_type").isNull()
    sums = results.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        _rate(F.col("relevant_retrieved")).alias("relevant_rate"), round_to(F.avg("evidence_recall")).alias("evidence_recall"), _rate(F.col("citation_valid")).alias("citation_valid_rate"),
        _rate(F.col("answer") == "insufficient evidence", ok).alias("insufficient_rate"), F.count(F.when(ok, F.col("stance_correct"))).alias("stance_scored"),
        _rate(F.col("stance_correct"), ok).alias("stance_accuracy"),
    )
    numbers = ["contexts", "input_tokens", "generated_tokens", "generator_ms"]
    found = with_medians(sums, results, numbers, "policy")
    return found.select(*sums.columns, *[round_to(F.col(c), 4).alias(f"median_{c}") for c in numbers])


def evidence_sentence_recall(sentences: DataFrame, contexts: DataFrame, normalise=plain_normalised) -> DataFrame:
    """Per query: eligible gold sentences, those found in a context of their document, and their share (null: none eligible).

    ``sentences`` is (query_id, doc_id, sentence_index, sentence), ``contexts``
    (query_id, doc_id, text).  Documents without a context are not eligible.
    """
    held = contexts.select("query_id", "doc_id", normalise(F.col("text")).alias("c"))
    gold = sentences.select("query_id", "doc_id", "sentence_index", "sentence").distinct().withColumn("s", normalise(F.col("sentence")))
    met = gold.join(held, ["query_id", "doc_id"]).groupBy("query_id", "doc_id", "sentence_index", "sentence").agg(F.max(F.col("c").contains(F.col("s"))).alias("found"))
    counted = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("eligible"), F.count_if("found").alias("matched"))
    every = sentences.select("query_id").distinct().join(counted, "query_id", "left")
    return every.select(
        "query_id", F.coalesce("eligible", F.lit(0)).alias("eligible"), F.coalesce("matched", F.lit(0)).alias("matched"), round_to(F.try_divide(F.col("matched").cast("double"), F.col("eligible"))).alias("recall")
    )


def evidence_partitions(rationales: DataFrame, records: DataFrame) -> DataFrame:
    """Rationales by the coverage of their document's record, absent documents included."""
    joined = rationales.join(records.select("query_id", "doc_id", "coverage"), ["query_id", "doc_id"], "left")
    return joined.groupBy(F.coalesce("coverage", F.lit("absent")).alias("coverage")).agg(F.count(F.lit(1)).alias("rationales"), F.sum("sentences").alias("sentences"))


def reader_accounting(results: DataFrame, arms: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per arm counts of statuses, tokens and seconds, over all rows; and the prompts that all arms completed."""
    per = results.groupBy("arm").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") != "completed").alias("failed"),
        F.sum("tokens").alias("tokens"), round_to(F.sum("seconds"), 4).alias("seconds"),
    )
    paired = results.filter((F.col("status") == "completed") & F.col("arm").isin(arms)).groupBy("prompt_id").agg(F.count_distinct("arm").alias("n")).filter(F.col("n") == len(arms)).select("prompt_id")
    return per, paired


def outcome_partitions(rows: DataFrame, arms: tuple[str, str, str]) -> DataFrame:
    """Counts of prompts and articles for all eight triples of correctness, empty ones included."""
    grid = rows.sparkSession.range(8).select(*[(F.shiftright("id", 2 - i).bitwiseAND(F.lit(1)) == 1).alias(a) for i, a in enumerate(arms)])
    counts = rows.groupBy(*arms).agg(F.count(F.lit(1)).alias("prompts"), F.count_distinct("article_id").alias("articles"))
    return grid.join(counts, list(arms), "left").select(*arms, F.coalesce("prompts", F.lit(0)).alias("prompts"), F.coalesce("articles", F.lit(0)).alias("articles"))


def label_transitions(rows: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """Counts over the whole grid of two arms' labels."""
    every = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("from_label"))
    grid = every.crossJoin(every.withColumnRenamed("from_label", "to_label"))  # labels squared
    counts = rows.groupBy(F.col(a).alias("from_label"), F.col(b).alias("to_label")).agg(F.count(F.lit(1)).alias("prompts"), F.count_distinct("article_id").alias("articles"))
    return grid.join(counts, ["from_label", "to_label"], "left").select("from_label", "to_label", F.coalesce("prompts", F.lit(0)).alias("prompts"), F.coalesce("articles", F.lit(0)).alias("articles"))


def article_summary(rows: DataFrame, arms: list[str]) -> DataFrame:
    """Per article, under its 1-based ordinal in place of its id: prompts, correct answers of each arm, mean recall.

    The ordinal comes from ranked distinct ids, not from the rows, so no task sees more than the articles.
    """
    sums = rows.groupBy("article_id").agg(F.count(F.lit(1)).alias("prompts"), *[F.count_if(a).alias(f"{a}_correct") for a in arms], round_to(F.avg("recall")).alias("mean_recall"))
    return placed(sums, ["article_id"]).withColumn("article_ordinal", F.col("place") + 1).drop("article_id", "place", "placed_of")


def evaluation_set_summary(cases: DataFrame) -> DataFrame:
    """One row: cases by stance, rationale sets, sentences, and the digest of the ordered canonical lines."""
    line = F.to_json(F.struct("claim", "expected_stance", "query_id"))
    stances = {s: F.count_if(F.col("expected_stance") == s).alias(f"{s.lower()}_cases") for s in ("SUPPORT", "CONTRADICT", "NOT_ENOUGH_INFO")}
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_id", line.alias("l")))), lambda x: x["l"]), "\n")
    return cases.agg(F.count(F.lit(1)).alias("cases"), *stances.values(), F.sum("rationale_sets").alias("rationale_sets"), F.sum("sentences").alias("sentences"), F.sha2(ordered.cast("binary"), 256).alias("sha256"))


def failure_counters(rows: DataFrame, problems: str = "problems") -> DataFrame:
    """How many rows have each problem; a row may have several."""
    return rows.select(F.explode(F.array_distinct(problems)).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n_rows"))


def disputed(rows: DataFrame, identifier: str, label: str, verified: str) -> DataFrame:
    """Ids with more than one distinct verified label."""
    return rows.groupBy(identifier).agg(F.count_distinct(F.when(F.col(verified), F.col(label))).alias("labels")).filter("labels > 1")


def telemetry_retries(attempts: DataFrame, run: str = "run_id") -> DataFrame:
    """Retries of a run: the sum over revisions of the largest attempt less one."""
    top = attempts.groupBy(run, "revision").agg(F.greatest(F.lit(1), F.max("attempt")).alias("most"))
    return top.groupBy(run).agg(F.sum(F.col("most") - 1).alias("retries"))


def telemetry_aggregate(measurements: DataFrame) -> DataFrame:
    """Per metric and unit of (name, unit, value, origin, completeness): counts, sum, extremes, unavailable ones and origins; no run ids."""
    there = F.col("completeness") == "available"
    value = F.when(there, F.col("value"))
    return measurements.groupBy("name", "unit").agg(
        F.count(value).alias("n_available"), F.count_if(~there).alias("n_unavailable"), round_to(F.sum(value), 4).alias("total"), round_to(F.min(value), 4).alias("minimum"),
        round_to(F.max(value), 4).alias("maximum"), F.count_if(F.col("origin") == "locally-measured").alias("locally_measured"), F.count_if(F.col("origin") == "provided").alias("provided"),
    )


def forbidden_keys(documents: DataFrame, identifier: str, column: str, forbidden: list[str]) -> DataFrame:
    """(identifier, forbidden, problem): rows whose JSON has a forbidden key at any depth, and rows that are no strict JSON.

    ``identifier`` is unique.  A row with a problem has null ``forbidden``.
    """
    bad = documents.select(identifier, F.lit(None).cast("array<string>").alias("forbidden"), json_problem(F.col(column)).alias("problem")).filter("problem IS NOT NULL")
    keys = nested_keys(documents, column, identifier).filter(F.col("key").isin(forbidden))
    found = keys.groupBy(identifier).agg(F.array_sort(F.collect_set("key")).alias("forbidden"))
    return found.withColumn("problem", F.lit(None).cast("string")).unionByName(bad)


def provenance_validity(records: DataFrame) -> DataFrame:
    """Mean over bundled records of: own document, one representation, unique ordinals, digests that match.

    ``records``: doc_id, representation, selections array<struct<doc_id,representation,ordinal,text,sha256>>.
    """
    s = F.col("selections")
    same = F.forall(s, lambda x: (x["doc_id"] == F.col("doc_id")) & (x["representation"] == F.col("representation")) & (F.sha2(x["text"].cast("binary"), 256) == x["sha256"]))
    unique = F.size(F.array_distinct(F.transform(s, lambda x: x["ordinal"]))) == F.size(s)
    return records.filter(s.isNotNull()).agg(F.count(F.lit(1)).alias("records"), round_to(F.avg((same & unique).cast("int"))).alias("validity"))


def whitelisted(df: DataFrame, known: list[str]) -> DataFrame:
    """``df`` if all its columns are known and none but numbers and booleans leave, except group names in ``known``."""
    bad = [c for c, t in df.dtypes if c not in known or (t == "string" and not c.endswith(("_label", "name", "unit", "coverage")))]
    if bad:
        raise ValueError(f"columns that may not be published: {bad}")
    return df
