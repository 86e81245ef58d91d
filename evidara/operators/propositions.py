"""Grounded propositions: validation, pairing and pair features.

A proposition is (proposition_id, candidate_id, side, subject, predicate, object,
polarity, qualifiers: array<struct<role,text>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.numeric import cosine, mapped_similarity, round_to
from evidara.operators import chunking
from evidara.operators.checks import violations

#: Closed classes of words that the extractor's automaton reads; all may be replaced.
VERBS = ("is", "are", "was", "were", "has", "have", "had", "can", "may", "will", "est", "sont", "ist", "sind", "war", "hat")
NEGATIONS = ("not", "never", "pas", "jamais", "nicht", "nie")
QUALIFIERS = {
    "time": ("during", "after", "before", "pendant", "nach", "vor"),
    "comparator": ("than", "versus", "que", "als"),
    "study-context": ("in", "at", "dans", "im"),
    "population": ("among", "for", "pour", "bei"),
    "intervention": ("with", "by", "avec", "mit"),
}
#: White space, and what an object's end is freed of.
BLANK, TAIL = r"[ \t\n\r\f]", " \t\n\r\f.!?"


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


def extract_propositions(documents: DataFrame, verbs=VERBS, negations=NEGATIONS, qualifiers=QUALIFIERS) -> DataFrame:
    """One proposition of every sentence of ``documents`` (doc_id, text) that has a subject, a verb and an object.

    A regular grammar reads the sentence from the left: the words before the first
    verb of the closed class are the subject, the verb with a negation behind it
    is the predicate, and the rest up to the first qualifying preposition, without
    blanks and full stops at its end, is the object; what follows that preposition
    qualifies it by the preposition's role.  Words match by case, between blanks.

    Returns proposition_id, doc_id, ordinal, sentence_start, sentence_end, the texts
    and starts of subject, predicate, object and qualifier, role (null without a
    qualifier) and polarity.  Texts are exact substrings: each end is its start and
    length.  The identity is a digest of doc_id, the sentence's digest, all spans
    and the polarity, so it is unique where doc_id is; a repeated row repeats it.
    Null and empty texts have no sentence.  Spans count code points.
    """
    blank = BLANK
    clause = rf"(?s)^([^ \t\n\r\f].*?)(?<!{blank})({blank}++)({_any(verbs)}(?:{blank}++{_any(negations)})?)({blank}++)([^ \t\n\r\f.!?].*)\z"
    split = rf"(?s)^(.*?)(?<!{blank})({blank}++)({_any([w for ws in qualifiers.values() for w in ws])})({blank}++)([^ \t\n\r\f].*)\z"
    part = lambda c, pattern, i: F.regexp_extract(c, pattern, i)
    found = chunking.sentence_spans(documents).filter(F.col("text").rlike(clause))
    found = found.withColumns({f"g{i}": part("text", clause, i) for i in range(1, 6)})
    found = found.withColumn("rest", F.rtrim("g5", F.lit(TAIL)))
    found = found.withColumns({f"q{i}": part("rest", split, i) for i in range(1, 6)})
    said = F.col("q1") != ""
    role = F.coalesce(*[F.when(F.col("q3").isin(*words), name) for name, words in qualifiers.items()])
    size = lambda *cs: sum((F.length(c) for c in cs), F.lit(0))
    start = F.col("start").cast("long")
    placed = found.select(
        "doc_id", "ordinal", start.alias("sentence_start"), F.col("end").cast("long").alias("sentence_end"), F.col("text").alias("sentence"),
        F.col("g1").alias("subject"), start.alias("subject_start"),
        F.col("g3").alias("predicate"), (start + size("g1", "g2")).alias("predicate_start"),
        F.when(said, F.col("q1")).otherwise(F.col("rest")).alias("object"), (start + size("g1", "g2", "g3", "g4")).alias("object_start"),
        F.when(said, F.col("q5")).alias("qualifier"), F.when(said, start + size("g1", "g2", "g3", "g4", "q1", "q2", "q3", "q4")).alias("qualifier_start"),
        F.when(said, role).alias("role"), F.when(F.col("g3").rlike(rf"{blank}{_any(negations)}\z"), "negative").otherwise("positive").alias("polarity"),
    )
    own = ["sentence_start", "sentence_end", *[c for p in ("subject", "predicate", "object", "qualifier") for c in (f"{p}_start", p)], "role", "polarity"]
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", *own)]
    identity = F.sha2(F.concat_ws("\x1f", *shown, F.sha2(F.col("sentence").cast("binary"), 256)).cast("binary"), 256)
    return placed.select(identity.alias("proposition_id"), "doc_id", "ordinal", *own)


def spans_of_propositions(propositions: DataFrame, documents: DataFrame) -> DataFrame:
    """Every span of extracted propositions beside its source, as ``span_violations`` takes them."""
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_start").alias("start"), F.col(p).alias("text")) for p in ("subject", "predicate", "object", "qualifier")])
    rows = propositions.select("proposition_id", "doc_id", "sentence_start", "sentence_end", F.explode(F.filter(parts, lambda x: x["text"].isNotNull())).alias("s"))
    rows = rows.select("proposition_id", "doc_id", "sentence_start", "sentence_end", "s.*").withColumn("end", F.col("start") + F.length("text"))
    return rows.join(documents.select("doc_id", F.col("text").alias("source")), "doc_id")


def span_violations(spans: DataFrame) -> DataFrame:
    """Spans (source, start, end, text, sentence_start, sentence_end) with the names of the rules they break."""
    inside = (F.col("start") >= F.col("sentence_start")) & (F.col("end") <= F.col("sentence_end"))
    return spans.withColumn(
        "violations",
        violations(
            blank_text=F.trim("text") == "",
            bad_range=(F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("source")),
            text_mismatch=F.col("source").substr(F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"),
            outside_sentence=~inside,
        ),
    ).filter(F.size("violations") > 0)


def surfaces(propositions: DataFrame) -> DataFrame:
    """Every distinct surface text once, so that each is embedded once."""
    own = F.concat(F.array("subject", "predicate", "object"), F.transform("qualifiers", lambda q: q["text"]))
    return propositions.select(F.explode(own).alias("surface")).distinct()


def pair_features(claims: DataFrame, documents: DataFrame, vectors: DataFrame, digits: int = 6) -> DataFrame:
    """The structurally best pair of a claim's and a document's propositions, per candidate.

    ``vectors`` is (surface, embedding).  Pairs meet by candidate_id only.  Ties
    go to the smaller claim, then document proposition id.
    """
    def embedded(df: DataFrame, prefix: str) -> DataFrame:
        for part in ("subject", "predicate", "object"):
            v = vectors.select(F.col("surface").alias(part), F.col("embedding").alias(f"{part}_v"))
            df = df.join(v, part)
        return df.select(
            "candidate_id", F.col("proposition_id").alias(f"{prefix}_id"), F.col("polarity").alias(f"{prefix}_polarity"),
            *[F.col(f"{p}_v").alias(f"{prefix}_{p}") for p in ("subject", "predicate", "object")],
        )

    c, d = embedded(claims, "c"), embedded(documents, "d")
    sim = lambda a, b: mapped_similarity(cosine(F.col(a), F.col(b)))
    pairs = c.join(d, "candidate_id").select(
        "candidate_id", "c_id", "d_id", F.when(F.col("c_polarity") == F.col("d_polarity"), 1.0).otherwise(-1.0).alias("polarity"),
        sim("c_subject", "d_subject").alias("ss"), sim("c_subject", "d_object").alias("so"), sim("c_object", "d_subject").alias("os"), sim("c_object", "d_object").alias("oo"),
        sim("c_predicate", "d_predicate").alias("predicate"),
    )
    pairs = pairs.join(qualifier_similarity(claims, documents, vectors), ["candidate_id", "c_id", "d_id"], "left")
    direction = (F.col("ss") + F.col("oo") - F.col("so") - F.col("os")) / 2.0
    pairs = pairs.withColumn("entity", F.greatest("ss", "so", "os", "oo")).withColumn("direction", direction).withColumn("qualifier", F.coalesce("qualifier", F.lit(0.0)))
    placed = (F.col("direction") + 1.0) / 2.0
    structural = round_to((F.col("entity") + F.col("predicate") + placed) / 3.0, 9)
    mean = (F.col("entity") + F.col("predicate") + placed + (F.col("polarity") + 1.0) / 2.0 + F.col("qualifier")) / 5.0
    best = F.min_by(
        F.struct("c_id", "d_id", "entity", "predicate", "direction", "polarity", "qualifier", mean.alias("pair_mean")), F.struct((-structural).alias("s"), "c_id", "d_id")
    )
    chosen = pairs.groupBy("candidate_id").agg(best.alias("b"))
    rounded = [round_to(F.col(f"b.{x}"), digits).alias(x) for x in ("entity", "predicate", "direction", "polarity", "qualifier", "pair_mean")]
    return chosen.select("candidate_id", F.col("b.c_id").alias("claim_proposition"), F.col("b.d_id").alias("document_proposition"), *rounded)


def qualifier_similarity(claims: DataFrame, documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean over a claim's qualifiers of the best similarity to a document qualifier of the same role (0 without one)."""

    def spread(df: DataFrame, prefix: str) -> DataFrame:
        q = df.select("candidate_id", F.col("proposition_id").alias(f"{prefix}_id"), F.posexplode("qualifiers").alias(f"{prefix}_at", "q"))
        q = q.select("candidate_id", f"{prefix}_id", f"{prefix}_at", F.col("q.role").alias("role"), F.col("q.text").alias("surface"))
        return q.join(vectors, "surface").select("candidate_id", f"{prefix}_id", f"{prefix}_at", "role", F.col("embedding").alias(f"{prefix}_v"))

    c, d = spread(claims, "c"), spread(documents, "d")
    ids = documents.select("candidate_id", F.col("proposition_id").alias("d_id"))
    grid = c.join(ids, "candidate_id").join(d.drop("d_at"), ["candidate_id", "d_id", "role"], "left")
    best = grid.groupBy("candidate_id", "c_id", "d_id", "c_at").agg(F.coalesce(F.max(mapped_similarity(cosine(F.col("c_v"), F.col("d_v")))), F.lit(0.0)).alias("s"))
    return best.groupBy("candidate_id", "c_id", "d_id").agg(F.avg("s").alias("qualifier"))


def grounded_label(cited: Column, label: Column) -> Column:
    """Gold label of a document: uncited is neutral, SUPPORT entailment, CONTRADICT contradiction."""
    return F.when(~F.coalesce(cited, F.lit(False)), "neutral").when(label == "SUPPORT", "entailment").when(label == "CONTRADICT", "contradiction").otherwise("neutral")
