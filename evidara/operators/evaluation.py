"""Evaluation records: gold cases, paired policies, retained results, readers and sources.

Every check is a relation of violations or a column of them, so that a caller
can publish, count or refuse what is wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara.functions.numeric import finite
from evidara.functions.text import STANCES, canonical_newlines
from evidara.operators.checks import ContractError, broadcast_if_small, require_unique, violations

SUPPORT, CONTRADICT, UNDECIDED = STANCES
#: Canonical labels of a three-way classifier, in the order of its logits here.
LABELS = ("entailment", "contradiction", "neutral")


def gold_cases(claims: DataFrame, queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, expected_stance, rationales, sentences, problems) of every claim, from four sources that must agree.

    ``claims``: query_id, claim, cited array<doc_id>, evidence
    array<struct<doc_id, label, sentences array<int>>>; ``queries``: query_id,
    text; ``qrels``: query_id, doc_id; ``corpus``: doc_id, abstract array<string>.
    Problems are sorted names: claim-differs, not-a-query, citations-differ,
    document-missing, evidence-not-cited, sentence-outside, labels-conflict.
    """
    judged = qrels.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("judged"))
    known = corpus.select("doc_id", F.size("abstract").alias("length"))
    cited = claims.select("query_id", F.explode("cited").alias("doc_id")).join(known, "doc_id", "left")
    absent = cited.groupBy("query_id").agg(F.bool_or(F.col("length").isNull()).alias("absent"))
    told = claims.select("query_id", F.explode("evidence").alias("e")).select("query_id", "e.*").join(known, "doc_id", "left")
    told = told.groupBy("query_id").agg(
        F.array_sort(F.collect_set("label")).alias("labels"), F.count(F.lit(1)).alias("rationales"), F.sum(F.size("sentences")).alias("sentences"),
        F.bool_or((F.size("sentences") == 0) | F.exists("sentences", lambda i: (i < 0) | (i >= F.coalesce("length", F.lit(0))))).alias("outside"),
    )
    rows = claims.join(queries.select("query_id", F.col("text").alias("asked")), "query_id", "left").join(judged, "query_id", "left").join(absent, "query_id", "left").join(told, "query_id", "left")
    sources = F.transform("evidence", lambda e: e["doc_id"])
    problems = violations(
        not_a_query=F.col("asked").isNull(), claim_differs=F.col("asked") != F.col("claim"), citations_differ=~F.array_sort(F.array_distinct("cited")).eqNullSafe(F.col("judged")),
        document_missing=F.coalesce("absent", F.lit(True)), evidence_not_cited=F.size(F.array_except(sources, "cited")) > 0, sentence_outside=F.col("outside"), labels_conflict=F.size("labels") > 1,
    )
    stance = F.coalesce(F.get("labels", F.lit(0)), F.lit(UNDECIDED))
    return rows.select("query_id", stance.alias("expected_stance"), F.coalesce("rationales", F.lit(0)).alias("rationales"), F.coalesce("sentences", F.lit(0)).alias("sentences"), problems.alias("problems"))


def paired_policies(queries: DataFrame, contexts: DataFrame, policies: list[str], generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, policy, answer, error_type, shared) for every query and policy, failures included.

    ``contexts`` is (query_id, policy, context, error_type); a policy without a
    row failed as well.  Equal contexts of a query are generated once:
    ``generate`` maps (query_id, context_sha256, context) to those keys with
    answer and error_type.  ``shared`` tells that another policy had the same context.
    """
    grid = queries.select("query_id").withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    keyed = contexts.withColumn("context_sha256", F.sha2(F.col("context").cast("binary"), 256))
    held = grid.join(keyed, ["query_id", "policy"], "left")
    jobs = keyed.filter("error_type IS NULL AND context IS NOT NULL").groupBy("query_id", "context_sha256").agg(F.first("context").alias("context"), F.count(F.lit(1)).alias("uses"))
    made = generate(jobs.select("query_id", "context_sha256", "context")).select("query_id", "context_sha256", "answer", F.col("error_type").alias("generation_error"))
    done = held.join(jobs.select("query_id", "context_sha256", "uses"), ["query_id", "context_sha256"], "left").join(made, ["query_id", "context_sha256"], "left")
    error = F.coalesce("error_type", F.when(F.col("context").isNull(), F.lit("no-context")), "generation_error")
    return done.select("query_id", "policy", F.when(error.isNull(), F.col("answer")).alias("answer"), error.alias("error_type"), (F.coalesce("uses", F.lit(0)) > 1).alias("shared"))


def classify_pairs(pairs: DataFrame, backend: Callable[[str, str], tuple[int, list[float]]], index: dict[str, int], most_tokens: int) -> DataFrame:
    """(attempt_id, entailment, contradiction, neutral, problem) of premise and hypothesis by a classifier port.

    ``pairs``: attempt_id, premise, hypothesis, expected_tokens.  ``backend``
    gives a pair's token count and three logits; ``index`` maps the canonical
    labels to their places.  A pair is refused (null logits) that is too long, whose count
    differs from the expected one, or whose logits are not three finite numbers.
    """
    if set(index) != set(LABELS) or sorted(index.values()) != [0, 1, 2]:
        raise ValueError(f"the classifier's labels must be {LABELS} at the places 0 to 2")
    kind = dict(pairs.dtypes)["attempt_id"]

    def one(premise: str, hypothesis: str, expected: int) -> list:
        count, logits = backend(premise, hypothesis)
        problem = "too-long" if count > most_tokens else "token-count-differs" if count != expected else "not-three-finite-logits" if len(logits) != 3 or any(x != x or x in (float("inf"), float("-inf")) for x in logits) else None
        return [*(None if problem else float(logits[index[name]]) for name in LABELS), problem]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [one(p, h, int(n)) for p, h, n in zip(frame["premise"], frame["hypothesis"], frame["expected_tokens"], strict=True)]
            yield pd.concat([frame[["attempt_id"]].reset_index(drop=True), pd.DataFrame(told, columns=[*LABELS, "problem"])], axis=1)

    return pairs.select("attempt_id", "premise", "hypothesis", "expected_tokens").mapInPandas(run, f"attempt_id {kind}, entailment double, contradiction double, neutral double, problem string")


def unbound_prompts(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Roles whose prompt (role, prompt) differs between two runs or is missing in one, with both digests."""
    of = lambda df, name: df.select("role", F.sha2(F.col("prompt").cast("binary"), 256).alias(name))
    both = of(baseline, "baseline_sha256").join(of(candidate, "candidate_sha256"), "role", "full_outer")
    return both.filter(~F.col("baseline_sha256").eqNullSafe(F.col("candidate_sha256")))


def qualified(probes: DataFrame, results: DataFrame, needed: int = 4) -> DataFrame:
    """One row a subject: probes, those passed, and whether all of exactly ``needed`` did; an absent result fails."""
    met = probes.join(results, ["subject", "probe_id"], "left").withColumn("passed", F.coalesce(F.col("expected").eqNullSafe(F.col("answer")), F.lit(False)))
    per = met.groupBy("subject").agg(F.count(F.lit(1)).alias("probes"), F.count_if("passed").alias("passed"))
    return per.withColumn("qualified", (F.col("probes") == needed) & (F.col("passed") == needed))


def source_manifest(claims: DataFrame, documents: DataFrame, pool: DataFrame) -> DataFrame:
    """(kind, source_id, sha256): distinct claims (query_id, text) and the documents (doc_id, text) of a pool."""
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
    used = documents.join(pool.select("doc_id").distinct(), "doc_id", "left_semi")
    return claims.select(F.lit("claim").alias("kind"), F.col("query_id").cast("string").alias("source_id"), digest).distinct().unionByName(used.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("source_id"), digest).distinct())


def candidate_records(results: DataFrame, channels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Terminal results (candidate_id, channel, score) as one record each with all scores, and the ids that lack a finite one."""
    scores = F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "score"))))
    sound = results.filter(finite(F.col("score")) & F.col("channel").isin(channels)).groupBy("candidate_id").agg(scores.alias("scores"), F.count_distinct("channel").alias("n"))
    whole = sound.filter(F.col("n") == len(channels)).select("candidate_id", *[F.col("scores")[c].alias(c) for c in channels])
    return whole, results.select("candidate_id").distinct().join(whole.select("candidate_id"), "candidate_id", "left_anti")


def retained_mismatches(planned: DataFrame, recorded: DataFrame, key: str, *fields: str) -> DataFrame:
    """Journalled rows that a regenerated plan does not give: the key and the sorted names of fields that differ (``absent`` for a whole row)."""
    a = planned.select(key, *[F.col(f).alias(f"planned_{f}") for f in fields], F.lit(True).alias("is_planned"))
    b = recorded.select(key, *[F.col(f).alias(f"recorded_{f}") for f in fields], F.lit(True).alias("is_recorded"))
    both = b.join(a, key, "left")
    differ = [F.when(F.col("is_planned") & ~F.col(f"planned_{f}").eqNullSafe(F.col(f"recorded_{f}")), F.lit(f)) for f in sorted(fields)]
    names = F.array_compact(F.array(F.when(F.col("is_planned").isNull(), F.lit("absent")), *differ))
    return both.select(key, names.alias("mismatches")).filter(F.size("mismatches") > 0)


def baseline_ranking(records: DataFrame) -> DataFrame:
    """(query_id, ranking): document ids by (rank, numeric id), one array a query."""
    return records.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("long").alias("n")))), lambda x: x["n"]).alias("ranking"))


def failures(records: DataFrame) -> DataFrame:
    """Records (candidate_id, gold, predicted, error_type) that failed or were misclassified, with which of both."""
    kind = F.when(F.col("error_type").isNotNull(), "error").when(~F.col("gold").eqNullSafe(F.col("predicted")), "misclassified")
    return records.withColumn("failure", kind).filter("failure IS NOT NULL")


def record_violations(records: DataFrame) -> DataFrame:
    """Report records (query_id, doc_id, claim, gold, coverage, baseline_rank) that break a rule, with the rules' names.

    A rank that a query gives twice is broken on every row that has it.
    """
    twice = F.count(F.lit(1)).over(W.partitionBy("query_id", "baseline_rank")) > 1
    marked = records.withColumn("twice", F.col("baseline_rank").isNotNull() & twice)
    rules = violations(
        blank_claim=F.trim(F.coalesce("claim", F.lit(""))) == "", unknown_gold=~F.coalesce(F.col("gold").isin(*LABELS), F.lit(False)), coverage_outside=~F.coalesce(F.col("coverage").between(0, 1), F.lit(False)),
        bad_rank=F.coalesce("baseline_rank", F.lit(0)) < 1, doubled_rank=F.col("twice"),
    )
    return marked.select("query_id", "doc_id", rules.alias("violations")).filter(F.size("violations") > 0)


def qualified_inputs(prompts: DataFrame, annotations: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(prompt_id, label, spans) of prompts whose valid annotations agree.

    ``annotations``: prompt_id, row_id, label, valid; ``coordinates``: row_id,
    start, end.  Only valid annotations with coordinates count; prompts without
    any, or with several labels, are left out.  Spans are merged half-open intervals, sorted.
    """
    from evidara.operators.intervals import union_intervals

    used = annotations.filter("valid").join(coordinates, "row_id").join(prompts.select("prompt_id").distinct(), "prompt_id", "left_semi")
    agreed = used.groupBy("prompt_id").agg(F.min("label").alias("label"), F.count_distinct("label").alias("n")).filter("n = 1").select("prompt_id", "label")
    spans = union_intervals(used.select("prompt_id", "start", "end"), "prompt_id").groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return agreed.join(spans, "prompt_id")


def reader_payloads(inputs: DataFrame, most_tokens: int, count: Callable[[Column], Column]) -> DataFrame:
    """Adds for the whole text and for the spans' text (``oracle``) the payload as JSON, its tokens and whether it fits.

    ``inputs``: prompt_id, text, spans array<struct<start,end>>.
    """
    oracle = F.array_join(F.transform("spans", lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"])), "\n")
    out = inputs.select("prompt_id", F.col("text").alias("full"), oracle.alias("oracle"))
    for arm in ("full", "oracle"):
        out = out.withColumn(f"{arm}_tokens", count(F.col(arm))).withColumn(f"{arm}_fits", F.col(f"{arm}_tokens") <= most_tokens)
    return out.select("prompt_id", *[F.to_json(F.struct(F.col("prompt_id").cast("string").alias("prompt"), F.col(a).alias("text"))).alias(f"{a}_payload") for a in ("full", "oracle")], "full_tokens", "full_fits", "oracle_tokens", "oracle_fits")


def selector_windows(windows: DataFrame, scores: DataFrame, k: int = 2) -> DataFrame:
    """(prompt_id, starts, problem): the ``k`` windows of best score by (-score, start), in source order.

    ``windows``: prompt_id, at, start; ``scores``: prompt_id, at, score.  A prompt
    whose scores are not one finite number for each window has a problem instead.
    """
    grid = windows.join(scores.select("prompt_id", "at", "score", F.lit(1).alias("given")), ["prompt_id", "at"], "full_outer")
    sound = F.col("start").isNotNull() & finite(F.col("score"))
    best = F.slice(F.array_sort(F.collect_list(F.when(sound, F.struct((-F.col("score")).alias("s"), "start")))), 1, k)
    per = grid.groupBy("prompt_id").agg(F.bool_and(sound).alias("sound"), F.count(F.lit(1)).alias("n"), F.count_distinct("at").alias("places"), best.alias("best"))
    whole = F.col("sound") & (F.col("n") == F.col("places"))
    starts = F.array_sort(F.transform("best", lambda x: x["start"]))
    return per.select("prompt_id", F.when(whole, starts).alias("starts"), F.when(~whole, "scores-incomplete").alias("problem"))


def changed_selections(selected: DataFrame, recorded: DataFrame) -> DataFrame:
    """Prompts whose recorded starts are not those selected anew."""
    both = selected.select("prompt_id", "starts").join(recorded.select("prompt_id", F.col("starts").alias("recorded")), "prompt_id", "full_outer")
    return both.filter(~F.col("starts").eqNullSafe(F.col("recorded")))


def text_equality(pairs: DataFrame) -> DataFrame:
    """Adds whether two texts are equal as they stand and with one kind of line end."""
    return pairs.withColumns({"raw_equal": F.col("a").eqNullSafe(F.col("b")), "lf_equal": canonical_newlines(F.col("a")).eqNullSafe(canonical_newlines(F.col("b")))})


def status_counts(rows: DataFrame, status: str, size: str) -> DataFrame:
    """Rows and summed sizes of each status."""
    return rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("total"))


#: The most responses of the two parts of a pilot.
MOST_CLARIFICATION, MOST_ASSESSMENT = 12, 48


def split_report(members: DataFrame, requested: DataFrame, clarification: int = MOST_CLARIFICATION, assessment: int = MOST_ASSESSMENT) -> DataFrame:
    """(split, n_groups, n_responses, ceiling, refused) of the two parts that ``split_selection`` would make."""
    rows = _split(members, requested).groupBy("split").agg(F.count_distinct("group_id").alias("n_groups"), F.count(F.lit(1)).alias("n_responses"))
    ceiling = F.when(F.col("split") == "clarification", clarification).otherwise(assessment)
    return rows.withColumn("ceiling", ceiling).withColumn("refused", F.col("n_responses") > F.col("ceiling"))


def split_selection(members: DataFrame, requested: DataFrame, clarification: int = MOST_CLARIFICATION, assessment: int = MOST_ASSESSMENT) -> DataFrame:
    """(split, group_id, response_id): whole requested groups for clarification, all others for assessment.

    ``members`` is (group_id, response_id).  Refused are requests that repeat or
    name no group, and parts above their ceilings; nothing is left out to fit.
    """
    require_unique(requested, "group_id")
    if not requested.join(members, "group_id", "left_anti").isEmpty():
        raise ContractError("a requested group is not in the inventory")
    over = [r["split"] for r in split_report(members, requested, clarification, assessment).filter("refused").collect()]  # two rows at most
    if over:
        raise ContractError(f"above the ceiling: {', '.join(sorted(over))}")
    return _split(members, requested)


def _split(members: DataFrame, requested: DataFrame) -> DataFrame:
    named = broadcast_if_small(requested.select("group_id").distinct().withColumn("named", F.lit(True)))
    split = F.when(F.col("named"), "clarification").otherwise("assessment").alias("split")
    return members.join(named, "group_id", "left").select(split, "group_id", "response_id")
