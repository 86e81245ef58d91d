"""Registered queries: evaluation records, readers, sources, journals, reviews and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.functions.numeric import round_to
from evidara.operators import chunking, context, evaluation, graph, intervals, journal, propositions, reports, review, sampling
from evidara.plans import views
from evidara.plans.engine import Engine
from evidara.plans.views import query, table

_LABELS3 = "CASE WHEN toxic = 1 THEN 'contradiction' WHEN quality = 1 THEN 'entailment' ELSE 'neutral' END"
_GUESS3 = "CASE doc_id % 4 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' WHEN 2 THEN 'contradiction' ELSE 'entailment' END"


def _gold():
    return F.when(F.col("toxic") == 1, "contradiction").when(F.col("quality") == 1, "entailment").otherwise("neutral")


def _guess():
    r = F.pmod("doc_id", F.lit(4))
    return F.when(r == 1, "neutral").when(r == 2, "contradiction").otherwise("entailment")


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").distinct()


@query("""WITH l AS (SELECT DISTINCT doc_id, quality, toxic FROM labels),
d AS (SELECT doc_id, max(len(string_split(coalesce(text, ''), chr(10)))) AS n FROM documents GROUP BY 1),
c AS (SELECT doc_id AS q, quality, toxic, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS cited, doc_id % 3 AS sent, n FROM l LEFT JOIN d USING (doc_id))
SELECT c.q AS query_id, CASE WHEN quality = 1 THEN 'SUPPORT' WHEN toxic = 1 THEN 'CONTRADICT' ELSE 'NOT_ENOUGH_INFO' END AS expected_stance,
 CASE WHEN quality = 1 OR toxic = 1 THEN 1 ELSE 0 END AS rationales, CASE WHEN quality = 1 OR toxic = 1 THEN 1 ELSE 0 END AS sentences,
 coalesce(array_to_string([CASE WHEN cited <> c.q THEN 'citations-differ' END, CASE WHEN c.q % 11 = 0 THEN 'claim-differs' END, CASE WHEN dc.doc_id IS NULL THEN 'document-missing' END,
  CASE WHEN (quality = 1 OR toxic = 1) AND cited <> c.q THEN 'evidence-not-cited' END, CASE WHEN (quality = 1 OR toxic = 1) AND sent >= coalesce(c.n, 0) THEN 'sentence-outside' END], ','), '') AS problems
FROM c LEFT JOIN d dc ON dc.doc_id = c.cited""")
def gold_cases(spark, sf_dir):
    """A claim for every labelled document; some cite a wrong one, some have another text, some point outside."""
    rows = _labels(spark, sf_dir)
    label = F.when(F.col("quality") == 1, "SUPPORT").when(F.col("toxic") == 1, "CONTRADICT")
    proof = F.struct("doc_id", label.alias("label"), F.array(F.pmod("doc_id", F.lit(3)).cast("int")).alias("sentences"))
    cited = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    text = F.concat(F.lit("claim "), F.col("doc_id").cast("string"))
    claims = rows.select(F.col("doc_id").alias("query_id"), text.alias("claim"), F.array(cited).alias("cited"), F.filter(F.array(F.when(label.isNotNull(), proof)), lambda x: x.isNotNull()).alias("evidence"))
    asked = rows.select(F.col("doc_id").alias("query_id"), F.when(F.pmod("doc_id", F.lit(11)) == 0, F.upper(text)).otherwise(text).alias("text"))
    corpus = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max_by(F.split(F.coalesce("text", F.lit("")), "\n"), F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("abstract"))
    found = evaluation.gold_cases(claims, asked, rows.select(F.col("doc_id").alias("query_id"), "doc_id"), corpus)
    return found.withColumn("problems", F.array_join("problems", ","))


@query("""WITH c AS (SELECT conv_id, turn, turn % 4 AS r FROM conversations)
SELECT conv_id, turn, CASE r WHEN 0 THEN 'SUPPORT' WHEN 1 THEN 'NOT_ENOUGH_INFO' END AS verdict, CASE r WHEN 0 THEN 'as told' WHEN 1 THEN '' WHEN 2 THEN 'VERDICT: SUPPORTED' || chr(10) || 'no' ELSE 'so VERDICT: CONTRADICT' END AS rest FROM c""")
def stance_verdicts(spark, sf_dir):
    r = F.pmod("turn", F.lit(4))
    answer = F.when(r == 0, "  VERDICT: SUPPORT\r\n as told \n").when(r == 1, "VERDICT: NOT_ENOUGH_INFO").when(r == 2, "\nVERDICT: SUPPORTED\nno").otherwise("so VERDICT: CONTRADICT ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.stance_verdict(answer).alias("verdict"), T.stance_rest(answer).alias("rest"))


@query("""WITH d AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1)
SELECT doc_id, '[TITLE] T' || doc_id || chr(10) || CASE WHEN q = 1 THEN '[EVIDENCE ordinal=0] a' || chr(10) || '[OMITTED ordinals=1-2]' || chr(10) || '[EVIDENCE ordinal=3] b' ELSE '[OMITTED ordinals=0-3]' END AS premise FROM d""")
def premise_text(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    some = F.col("q") == 1
    part = lambda n, t: F.struct(F.lit(n).alias("ordinal"), F.lit(t).alias("text"))
    gap = lambda a, b: F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"))
    parts = F.when(some, F.array(part(3, "b"), part(0, "a"))).otherwise(F.array().cast("array<struct<ordinal:int,text:string>>"))
    return rows.select("doc_id", context.serialise_premise(F.concat(F.lit("T"), F.col("doc_id").cast("string")), parts, F.when(some, F.array(gap(1, 2))).otherwise(F.array(gap(0, 3)))).alias("premise"))


@query(r"""SELECT page_id, 'HTTPError: ' || left(regexp_replace(trim(regexp_replace('cannot  read ' || url || chr(10) || ' now', '\s+', ' ', 'g')), 'https?://\S+', '<redacted-url>', 'g'), 240) AS error FROM pages""")
def sanitised_errors(spark, sf_dir):
    message = F.concat(F.lit("cannot  read "), "url", F.lit("\n now"))
    return table(spark, sf_dir, "pages").select("page_id", T.sanitised_error(message, kind=F.lit("HTTPError")).alias("error"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'attribution_research_candidate' WHEN 1 THEN 'noncommercial_research_conditional' WHEN 2 THEN 'unresolved_conflicting_licenses' WHEN 3 THEN 'unresolved_no_derivatives' WHEN 4 THEN 'unresolved_custom_or_missing' ELSE 'unresolved_sharealike' END AS rights,
 CASE doc_id % 6 WHEN 0 THEN 'by/4.0' WHEN 1 THEN 'by-nc-sa/3.0' WHEN 2 THEN 'by/4.0,zero/1.0' WHEN 3 THEN 'by-nd/2.5' WHEN 4 THEN '' ELSE 'by-sa/4.0' END AS links,
 CASE doc_id % 6 WHEN 1 THEN 'non-commercial' WHEN 3 THEN 'no-derivatives' WHEN 4 THEN 'other' WHEN 5 THEN 'share-alike' ELSE 'attribution' END AS rights_class FROM labels""")
def rights_of_links(spark, sf_dir):
    r, at = F.pmod("doc_id", F.lit(6)), "see http://creativecommons.org/licenses/"
    text = (
        F.when(r == 0, f"{at}by/4.0/. Also {at.upper().replace('SEE HTTP', 'SEE https').replace('CREATIVECOMMONS.ORG/LICENSES', 'creativecommons.org/licenses')}BY/4.0")
        .when(r == 1, f"{at}by-nc-sa/3.0, as said").when(r == 2, f"{at}by/4.0/ and https://www.creativecommons.org/publicdomain/zero/1.0/").when(r == 3, f"{at}by-nd/2.5>").when(r == 4, f"{at}by/9.9/ (no such one)").otherwise(f"{at}by-sa/4.0")
    )
    text = F.when(r == 4, "all of it may be read").otherwise(text)
    return table(spark, sf_dir, "labels").select("doc_id", T.link_rights(text).alias("rights"), F.array_join(T.licence_links(text), ",").alias("links"), T.rights_class(text).alias("rights_class"))


@query(r"""WITH t AS (SELECT conv_id, turn, replace(coalesce(text, ''), ' ', CASE WHEN turn % 2 = 0 THEN chr(13) || chr(10) ELSE chr(13) END) AS raw FROM conversations),
u AS (SELECT conv_id, turn, raw, len(regexp_extract_all(raw, '(?s)\r\n|.')) AS n FROM t)
SELECT conv_id, turn, n + 1 AS boundaries, length(raw) AS last_char, strlen(raw) AS last_byte, length(regexp_replace(raw, '\r\n?', chr(10), 'g')) = n AS agrees FROM u""")
def newline_maps(spark, sf_dir):
    raw = F.regexp_replace(F.coalesce("text", F.lit("")), " ", F.when(F.pmod("turn", F.lit(2)) == 0, F.lit("\r\n")).otherwise(F.lit("\r")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw")).withColumn("m", T.newline_boundaries_udf("raw"))
    return rows.select("conv_id", "turn", F.size("m.chars").alias("boundaries"), F.element_at("m.chars", -1).alias("last_char"), F.element_at("m.bytes", -1).alias("last_byte"), (F.length(T.canonical_newlines(F.col("raw"))) + 1 == F.size("m.chars")).alias("agrees"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE (event_id % 97) + 0.25 END AS seconds FROM events""")
def utc_durations(spark, sf_dir):
    """Starts and ends as text; some are not in UTC, some end before they start."""
    r = F.pmod("event_id", F.lit(5))
    begin = F.lit("2024-02-28T23:59:00Z")
    moment = F.date_format(F.timestamp_add("SECOND", F.pmod("event_id", F.lit(97)).cast("int"), F.lit("2024-02-28 23:59:00").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")
    end = F.when(r == 0, F.concat(moment, F.lit("+02:00"))).when(r == 1, F.lit("2024-02-28T23:58:59.5Z")).otherwise(F.concat(moment, F.lit(".25+00:00")))
    return table(spark, sf_dir, "events").select("event_id", T.seconds_between(begin, end).alias("seconds"))


@query("""SELECT doc_id, doc_id % 4 = 0 AS relative_path, doc_id % 3 <> 1 AS safe_name, source IS NOT NULL AND trim(source) <> '' AS there,
 sha256('{"doc_id":' || doc_id || ',"parent":"' || sha256(coalesce(text, '')) || '","source":' || CASE WHEN source IS NULL THEN 'null' ELSE '"' || source || '"' END || '}') AS identity FROM documents WHERE doc_id IS NOT NULL""")
def text_rules_and_identity(spark, sf_dir):
    r, s = F.pmod("doc_id", F.lit(4)), F.pmod("doc_id", F.lit(3))
    path = F.when(r == 0, "a/b.c").when(r == 1, "/a").when(r == 2, "a/../b").otherwise("a\\b")
    name = F.when(s == 0, "run-1.x").when(s == 1, "-x y").otherwise("A")
    rows = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    chain = T.identity(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), doc_id=F.col("doc_id"), source=F.col("source"))
    return rows.select("doc_id", T.is_relative_path(path).alias("relative_path"), name.rlike(T.SAFE_NAME).alias("safe_name"), F.coalesce(F.trim("source") != "", F.lit(False)).alias("there"), chain.alias("identity"))


_ESCAPED = "us\\u0065r_id"


@query("""SELECT conv_id || '-' || turn AS record_id, CASE conv_id % 5 WHEN 0 THEN 'user_id' WHEN 1 THEN 'secret,user_id' END AS forbidden, CASE conv_id % 5 WHEN 3 THEN 'duplicate-key' WHEN 4 THEN 'malformed' END AS problem
FROM conversations WHERE conv_id % 5 <> 2""")
def forbidden_keys(spark, sf_dir):
    """Turns as nested JSON whose texts are values: keys spelt in escapes count, quoted ones in a text do not, repeated ones are refused."""
    r = F.pmod("conv_id", F.lit(5))
    text = F.concat(F.lit('"user_id": '), "text")
    inner = F.to_json(F.struct("role", text.alias("text")))
    escaped = F.concat(F.lit('{"turns": [[7, {"' + _ESCAPED + '": '), inner, F.lit("}]]}"))
    deep = F.concat(F.lit('{"user_id": {"x": {"secret": '), inner, F.lit("}}}"))
    twice = F.concat(F.lit('{"a": {"b": '), inner, F.lit(', "\\u0062": 1}}'))
    behind = F.when(F.pmod("turn", F.lit(2)) == 0, F.concat(inner, F.lit(", "), inner)).otherwise(F.concat(inner, F.lit(" user_id")))
    rows = table(spark, sf_dir, "conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("record_id"), F.when(r == 0, escaped).when(r == 1, deep).when(r == 2, inner).when(r == 3, twice).otherwise(behind).alias("j")
    )
    found = reports.forbidden_keys(rows, "record_id", "j", ["user_id", "secret"])
    return found.select("record_id", F.array_join("forbidden", ",").alias("forbidden"), "problem")


@query(f"""WITH r AS (SELECT doc_id, {_LABELS3} AS gold, {_GUESS3} AS predicted, CASE WHEN doc_id % 13 = 0 THEN 'timeout' END AS error_type FROM (SELECT DISTINCT doc_id, quality, toxic FROM labels))
SELECT doc_id AS candidate_id, CASE WHEN error_type IS NOT NULL THEN 'error' ELSE 'misclassified' END AS failure FROM r WHERE error_type IS NOT NULL OR gold <> predicted""")
def failure_export(spark, sf_dir):
    rows = _labels(spark, sf_dir).select(F.col("doc_id").alias("candidate_id"), _gold().alias("gold"), _guess().alias("predicted"), F.when(F.pmod("doc_id", F.lit(13)) == 0, "timeout").alias("error_type"))
    return evaluation.failures(rows).select("candidate_id", "failure")


@query("""WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'absent' WHEN doc_id % 10 = 1 THEN 'digest,gold' WHEN doc_id % 10 = 2 THEN 'digest' END AS mismatches FROM l WHERE doc_id % 10 < 3""")
def retained_results(spark, sf_dir):
    """A journal in which some rows were not planned and some differ from the plan."""
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    r = F.pmod("doc_id", F.lit(10))
    plan = rows.filter(r != 0).select("doc_id", F.col("q").cast("string").alias("gold"), F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("digest"))
    held = rows.select("doc_id", F.when(r == 1, F.lit(None)).otherwise(F.col("q").cast("string")).alias("gold"), F.sha2(F.when(r.isin(1, 2), F.lit("x")).otherwise(F.col("doc_id").cast("string")).cast("binary"), 256).alias("digest"))
    return evaluation.retained_mismatches(plan, held, "doc_id", "gold", "digest").withColumn("mismatches", F.array_join("mismatches", ","))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 3 AS rank FROM events)
SELECT user_id AS query_id, string_agg(event_id::VARCHAR, ',' ORDER BY rank, event_id) AS ranking FROM r GROUP BY 1""")
def baseline_rankings(spark, sf_dir):
    from pyspark.sql import Window as W

    place = F.pmod(F.row_number().over(W.partitionBy("user_id").orderBy("event_id")), F.lit(3))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").cast("string").alias("doc_id"), place.alias("rank"))
    return evaluation.baseline_ranking(rows).select("query_id", F.array_join(F.transform("ranking", lambda x: x.cast("string")), ",").alias("ranking"))


@query(f"""WITH r AS (SELECT doc_id // 10 AS query_id, doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'c' END AS claim, CASE WHEN doc_id % 8 = 0 THEN 'x' ELSE {_LABELS3} END AS gold, (doc_id % 12) / 10.0 AS coverage, doc_id % 6 AS rank
 FROM (SELECT DISTINCT doc_id, quality, toxic FROM labels)),
v AS (SELECT query_id, doc_id, coalesce(array_to_string([CASE WHEN rank < 1 THEN 'bad-rank' END, CASE WHEN claim = ' ' THEN 'blank-claim' END, CASE WHEN coverage > 1 THEN 'coverage-outside' END, CASE WHEN count(*) OVER (PARTITION BY query_id, rank) > 1 THEN 'doubled-rank' END, CASE WHEN gold = 'x' THEN 'unknown-gold' END], ','), '') AS violations FROM r)
SELECT * FROM v WHERE violations <> ''""")
def report_records(spark, sf_dir):
    rows = _labels(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 10).alias("query_id"), "doc_id", F.when(F.pmod("doc_id", F.lit(9)) == 0, " ").otherwise("c").alias("claim"), F.when(F.pmod("doc_id", F.lit(8)) == 0, "x").otherwise(_gold()).alias("gold"),
        (F.pmod("doc_id", F.lit(12)) / 10.0).alias("coverage"), F.pmod("doc_id", F.lit(6)).alias("baseline_rank"),
    )
    return evaluation.record_violations(rows).withColumn("violations", F.array_join("violations", ","))


@query("""WITH r AS (SELECT DISTINCT user_id % 50 AS candidate_id, event_type AS channel FROM events WHERE NOT (user_id % 50 = 7 AND event_type = 'view'))
SELECT candidate_id, count(*) = (SELECT count(DISTINCT event_type) FROM events) AS whole FROM r GROUP BY 1""")
def candidate_records(spark, sf_dir):
    """Scores by event type as channels; a candidate that lacks a channel has no record."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.pmod("user_id", F.lit(50)).alias("candidate_id"), F.col("event_type").alias("channel")).distinct().withColumn("score", F.col("candidate_id") / 2.0)
    rows = rows.filter(~((F.col("candidate_id") == 7) & (F.col("channel") == "view")))
    channels = sorted(r["event_type"] for r in events.select("event_type").distinct().limit(100).collect())  # a handful of names
    whole, rest = evaluation.candidate_records(rows, channels)
    return whole.select("candidate_id", F.lit(True).alias("whole")).unionByName(rest.select("candidate_id", F.lit(False).alias("whole")))


@query("""SELECT 'claim' AS kind, item_id::VARCHAR AS source_id, sha256(text) AS sha256 FROM benchmark UNION SELECT 'document', doc_id::VARCHAR, sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND text IS NOT NULL""")
def source_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    return evaluation.source_manifest(views.queries(spark, sf_dir), docs, table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"))


@query("""SELECT n_nationkey % 5 AS subject, count(*) AS probes, count(*) FILTER (n_nationkey % 7 <> 0) AS passed, count(*) = 5 AND count(*) FILTER (n_nationkey % 7 <> 0) = 5 AS qualified FROM nation GROUP BY 1""")
def probe_qualification(spark, sf_dir):
    """Nations as probes of five subjects; those of numbers divisible by seven fail or have no result."""
    n = table(spark, sf_dir, "nation").select(F.pmod("n_nationkey", F.lit(5)).alias("subject"), F.col("n_nationkey").alias("probe_id"), F.col("n_name").alias("expected"))
    results = n.filter("probe_id % 14 <> 0").select("subject", "probe_id", F.when(F.col("probe_id") % 7 == 0, "other").otherwise(F.col("expected")).alias("answer"))
    return evaluation.qualified(n, results, 5)


@query("""SELECT n_name AS role, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE sha256(n_name || n_regionkey) END AS baseline_sha256, CASE WHEN n_nationkey % 4 = 2 THEN NULL ELSE sha256(CASE WHEN n_nationkey % 4 = 0 THEN upper(n_name || n_regionkey) || '!' ELSE n_name || n_regionkey END) END AS candidate_sha256 FROM nation WHERE n_nationkey % 4 < 3""")
def unbound_prompts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("said", F.concat("n_name", F.col("n_regionkey").cast("string")))
    a = n.filter("n_nationkey % 4 <> 1").select(F.col("n_name").alias("role"), F.col("said").alias("prompt"))
    b = n.filter("n_nationkey % 4 <> 2").select(F.col("n_name").alias("role"), F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.upper("said"), F.lit("!"))).otherwise(F.col("said")).alias("prompt"))
    return evaluation.unbound_prompts(a, b)


@query("""WITH a AS (SELECT doc_id % 40 AS prompt_id, doc_id AS row_id, CASE WHEN doc_id % 40 < 30 THEN 'up' WHEN doc_id % 2 = 0 THEN 'up' ELSE 'down' END AS label FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id % 3 > 0),
p AS (SELECT prompt_id, min(label) AS label FROM a GROUP BY 1 HAVING count(DISTINCT label) = 1),
pt AS (SELECT prompt_id, unnest(range(row_id % 20, row_id % 20 + 3)) AS c FROM a)
SELECT prompt_id, label, count(DISTINCT c) AS covered FROM p JOIN pt USING (prompt_id) GROUP BY 1, 2""")
def qualified_inputs(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select("doc_id").distinct()
    p = F.pmod("doc_id", F.lit(40))
    label = F.when(p < 30, "up").when(F.pmod("doc_id", F.lit(2)) == 0, "up").otherwise("down")
    notes = ids.select(p.alias("prompt_id"), F.col("doc_id").alias("row_id"), label.alias("label"), (F.pmod("doc_id", F.lit(3)) > 0).alias("valid"))
    places = ids.select(F.col("doc_id").alias("row_id"), F.pmod("doc_id", F.lit(20)).alias("start"), (F.pmod("doc_id", F.lit(20)) + 3).alias("end"))
    found = evaluation.qualified_inputs(notes, notes, places)
    return found.select("prompt_id", "label", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("covered"))


@query("""WITH d AS (SELECT item_id, text FROM benchmark WHERE text IS NOT NULL)
SELECT item_id AS prompt_id, '{"prompt":"' || item_id || '","text":"' || replace(substr(text, 1, 5) || chr(10) || substr(text, 9, 4), chr(10), '\\n') || '"}' AS oracle_payload, len(regexp_extract_all(lower(text), '[\\p{L}0-9]+')) AS full_tokens, len(regexp_extract_all(lower(text), '[\\p{L}0-9]+')) <= 20 AS full_fits FROM d""")
def reader_payloads(spark, sf_dir):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    rows = table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").select(F.col("item_id").alias("prompt_id"), "text", F.array(span(0, 5), span(8, 12)).alias("spans"))
    return evaluation.reader_payloads(rows, 20, lambda c: F.size(T.tokens(c))).select("prompt_id", "oracle_payload", "full_tokens", "full_fits")


@query("""WITH s AS (SELECT event_id // 8 AS prompt_id, event_id % 8 AS at, event_id * 10 AS start, CASE WHEN event_id % 61 = 0 THEN NULL ELSE value END AS score FROM events),
ok AS (SELECT prompt_id, count(score) = count(*) AS ok FROM s GROUP BY 1),
b AS (SELECT prompt_id, start, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, start) AS r FROM s)
SELECT prompt_id, CASE WHEN ok THEN (SELECT string_agg(start::VARCHAR, ',' ORDER BY start) FROM b WHERE b.prompt_id = ok.prompt_id AND r <= 2) END AS starts, CASE WHEN NOT ok THEN 'scores-incomplete' END AS problem FROM ok""")
def selector_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 8).alias("prompt_id"), F.pmod("event_id", F.lit(8)).alias("at"), (F.col("event_id") * 10).alias("start"), F.when(F.pmod("event_id", F.lit(61)) != 0, F.col("value")).alias("score"))
    found = evaluation.selector_windows(rows.select("prompt_id", "at", "start"), rows.select("prompt_id", "at", "score"))
    return found.select("prompt_id", F.array_join(F.transform("starts", lambda x: x.cast("string")), ",").alias("starts"), "problem")


@query("""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS position FROM events WHERE event_id % 50 = 0)
SELECT position, event_id AS expected_event_id, CASE WHEN position % 10 = 0 THEN event_id + 1 ELSE event_id END AS recorded_event_id FROM e WHERE position % 10 = 0 AND position % 20 <> 0 UNION ALL SELECT position, event_id, NULL FROM e WHERE position % 20 = 0""")
def schedule_mismatches(spark, sf_dir):
    from pyspark.sql import Window as W

    planned = table(spark, sf_dir, "events").filter("event_id % 50 = 0").select("event_id", F.row_number().over(W.orderBy("event_id")).alias("position"))
    done = planned.filter("position % 20 <> 0").withColumn("event_id", F.when(F.col("position") % 10 == 0, F.col("event_id") + 1).otherwise(F.col("event_id")))
    return journal.schedule_mismatches(planned, done, "event_id")


@query("""WITH w AS (SELECT user_id, event_id, event_id % 40 AS s, event_id % 40 + event_id % 4 AS e FROM events WHERE event_id % 100 < 30),
b AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w)
SELECT user_id, count(*) AS n FROM b WHERE e <= s OR e > 41 OR s < reach GROUP BY 1""")
def invalid_windows(spark, sf_dir):
    s = F.pmod("event_id", F.lit(40))
    rows = table(spark, sf_dir, "events").filter("event_id % 100 < 30").select("user_id", s.alias("start"), (s + F.pmod("event_id", F.lit(4))).alias("end"), F.lit(41).alias("length"))
    return intervals.invalid_windows(rows, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT 'raw' AS status, count(*) AS n_rows, sum(length(text)) AS total FROM conversations WHERE text IS NOT NULL AND strpos(text, ' ') = 0 HAVING count(*) > 0
UNION ALL SELECT 'lines', count(*), sum(length(text)) FROM conversations WHERE strpos(text, ' ') > 0 AND turn % 2 = 0 HAVING count(*) > 0
UNION ALL SELECT 'differs', count(*), sum(length(text)) FROM conversations WHERE strpos(text, ' ') > 0 AND turn % 2 = 1 HAVING count(*) > 0""")
def text_equality(spark, sf_dir):
    """Each turn with line feeds against the same with other line ends, or with one more letter."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    odd = F.pmod("turn", F.lit(2)) == 1
    pairs = rows.select("text", F.replace("text", F.lit(" "), F.lit("\n")).alias("a"), F.when(odd & F.contains("text", F.lit(" ")), F.concat(F.replace("text", F.lit(" "), F.lit("\r\n")), F.lit("x"))).otherwise(F.replace("text", F.lit(" "), F.lit("\r\n"))).alias("b"))
    told = evaluation.text_equality(pairs).withColumn("status", F.when(F.col("raw_equal"), "raw").when(F.col("lf_equal"), "lines").otherwise("differs")).withColumn("size", F.length("text"))
    return evaluation.status_counts(told, "status", "size")


@query("""WITH c AS (SELECT conv_id, turn FROM conversations)
SELECT conv_id, turn, p.policy, CASE WHEN p.policy = 'gap' OR turn % 5 = 0 THEN NULL ELSE 're ' || CASE WHEN turn % 2 = 0 OR p.policy = 'whole' THEN 'w' ELSE 'a' END || turn END AS answer,
 CASE WHEN p.policy = 'gap' THEN 'no-context' WHEN turn % 5 = 0 THEN 'timeout' END AS error_type, p.policy <> 'gap' AND turn % 2 = 0 AND turn % 5 > 0 AS shared FROM c, (VALUES ('whole'), ('adaptive'), ('gap')) p(policy)""")
def paired_policies(spark, sf_dir):
    """Three policies of each turn: even turns share a context, one policy never has any, some runs time out."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("query_id"))
    t = F.col("query_id.turn")
    rows = turns.withColumn("policy", F.explode(F.array(F.lit("whole"), F.lit("adaptive"))))
    rows = rows.select("query_id", "policy", F.concat(F.when((t % 2 == 0) | (F.col("policy") == "whole"), "w").otherwise("a"), t.cast("string")).alias("context"), F.when(t % 5 == 0, "timeout").alias("error_type"))
    told = evaluation.paired_policies(turns, rows, ["whole", "adaptive", "gap"], lambda jobs: jobs.select("query_id", "context_sha256", F.concat(F.lit("re "), "context").alias("answer"), F.lit(None).cast("string").alias("error_type")))
    return told.select("query_id.*", "policy", "answer", "error_type", "shared")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) / 10.0 END AS entailment, CASE WHEN turn % 3 = 0 THEN NULL ELSE -1.0 END AS contradiction, CASE WHEN turn % 3 = 0 THEN NULL ELSE 0.5 END AS neutral, CASE WHEN turn % 3 = 0 THEN 'token-count-differs' END AS problem FROM conversations WHERE text IS NOT NULL""")
def pair_classification(spark, sf_dir):
    """A stand-in classifier whose logits come in another order than the canonical labels; some counts are wrong."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    n = F.length("text") + 1 + F.when(F.pmod("turn", F.lit(3)) == 0, 1).otherwise(0)
    pairs = rows.select(F.concat_ws("|", "conv_id", "turn").alias("attempt_id"), "conv_id", "turn", F.col("text").alias("premise"), F.lit("h").alias("hypothesis"), n.alias("expected_tokens"))
    told = evaluation.classify_pairs(pairs, lambda p, h: (len(p) + len(h), [-1.0, len(p) / 10.0, 0.5]), {"contradiction": 0, "entailment": 1, "neutral": 2}, 1 << 20)
    return pairs.select("attempt_id", "conv_id", "turn").join(told, "attempt_id").drop("attempt_id")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT s_suppkey AS id, s_nationkey * 10 + s_suppkey % 3 AS v, s_suppkey // 7 AS w FROM supplier),
e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.v = b.v UNION SELECT a.id, b.id FROM n a JOIN n b ON a.w = b.w AND a.w % 5 = 0),
r AS (SELECT id AS node, id AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def shared_value_components(spark, sf_dir):
    """Suppliers tied by a shared nation and residue, or by a shared run of numbers."""
    s = table(spark, sf_dir, "supplier")
    run = F.floor(F.col("s_suppkey") / 7)
    rows = s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * 10 + F.pmod("s_suppkey", F.lit(3))).alias("v"), F.when(F.pmod(run, F.lit(5)) == 0, run).alias("w"))
    return graph.shared_value_components(rows, "id", "v", "w")


_MEMBERS = "m AS (SELECT conv_id AS group_id, conv_id || '-' || turn AS response_id, conv_id % 10 = 3 AS named FROM conversations)"


def _members(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), F.concat("conv_id", F.lit("-"), "turn").alias("response_id"))
    return rows, rows.filter("group_id % 10 = 3").select("group_id").distinct()


@query(f"WITH {_MEMBERS} SELECT CASE WHEN named THEN 'clarification' ELSE 'assessment' END AS split, group_id, response_id FROM m")
def split_selection(spark, sf_dir):
    """Conversations whose id ends in 3 for clarification, under ceilings that the tables keep."""
    rows, requested = _members(spark, sf_dir)
    most = rows.count()
    return evaluation.split_selection(rows, requested, most, most)


@query(f"WITH {_MEMBERS} SELECT CASE WHEN named THEN 'clarification' ELSE 'assessment' END AS split, count(DISTINCT group_id) AS n_groups, count(*) AS n_responses, CASE WHEN named THEN 12 ELSE 48 END AS ceiling, count(*) > CASE WHEN named THEN 12 ELSE 48 END AS refused FROM m GROUP BY named")
def split_report(spark, sf_dir):
    """The same split against the pilot's own ceilings."""
    return evaluation.split_report(*_members(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'contradiction' WHEN quality = 1 AND doc_id % 2 = 0 THEN 'entailment' ELSE 'neutral' END AS label FROM (SELECT DISTINCT doc_id, quality, toxic FROM labels)""")
def grounded_labels(spark, sf_dir):
    cited = F.when(F.col("quality") == 1, F.pmod("doc_id", F.lit(2)) == 0).when(F.col("toxic") == 1, True)
    label = F.when(F.col("quality") == 1, "SUPPORT").when(F.col("toxic") == 1, "CONTRADICT")
    return _labels(spark, sf_dir).select("doc_id", propositions.grounded_label(cited, label).alias("label"))


@query("""WITH r AS (SELECT DISTINCT doc_id, quality FROM labels WHERE doc_id % 3 > 0) SELECT CASE WHEN doc_id % 2 = 0 THEN CASE WHEN quality = 1 THEN 'full' ELSE 'partial' END ELSE 'absent' END AS coverage, count(*) AS rationales, sum(doc_id % 4) AS sentences FROM r GROUP BY 1""")
def evidence_partitions(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").filter("doc_id % 3 > 0").select("doc_id", "quality").distinct()
    rationales = rows.select(F.col("doc_id").alias("query_id"), "doc_id", F.pmod("doc_id", F.lit(4)).alias("sentences"))
    records = rows.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"), "doc_id", F.when(F.col("quality") == 1, "full").otherwise("partial").alias("coverage"))
    return reports.evidence_partitions(rationales, records)


@query("""WITH o AS (SELECT c_custkey, c_name, c_nationkey * 100 + c_custkey % 7 AS size, row_number() OVER (ORDER BY c_nationkey * 100 + c_custkey % 7, c_custkey) AS "at", count(*) OVER () AS n FROM customer) SELECT c_custkey, size, "at" FROM o WHERE "at" IN (1, (n - 1) // 2 + 1, n)""")
def preflight_pick(spark, sf_dir):
    return sampling.preflight(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 100 + F.pmod("c_custkey", F.lit(7))).alias("size")), "size", "c_custkey")


@query("""WITH r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id FROM labels) GROUP BY 1) SELECT count(*) AS records, round(avg(CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 0 ELSE 1 END), 6) AS validity FROM r WHERE doc_id % 4 > 0""")
def provenance_validity(spark, sf_dir):
    """Bundles of two chunks; some name a foreign document, some repeat an ordinal, some records have none."""
    d = F.col("doc_id")
    chunk = lambda n, owner: F.struct(owner.alias("doc_id"), F.lit("w").alias("representation"), n.alias("ordinal"), F.lit("t").alias("text"), F.sha2(F.lit("t").cast("binary"), 256).alias("sha256"))
    bundle = F.array(chunk(F.lit(0), d), chunk(F.when(d % 7 == 0, 0).otherwise(1), F.when(d % 5 == 0, d + 1).otherwise(d)))
    rows = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return reports.provenance_validity(rows.select("doc_id", F.lit("w").alias("representation"), F.when(d % 4 > 0, bundle).alias("selections")))


@query("""WITH r AS (SELECT conv_id, turn, conv_id || '-' || turn AS response_id, text FROM conversations WHERE role = 'user')
SELECT response_id, 'source' AS side FROM r WHERE turn % 3 = 0 UNION ALL SELECT response_id, 'completed' FROM r WHERE turn % 3 = 0""")
def worksheet_changes(spark, sf_dir):
    """Blank worksheets of the users' turns against completed ones in which some texts were changed."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), "turn", F.coalesce("text", F.lit("")).alias("text"), F.lit("x").alias("gold"))
    blank = review.blank_worksheet(rows, rows)
    done = blank.withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return review.changed_content(blank, done, "response_id", "text").select("response_id", "side")


@query("""SELECT conv_id || '-' || turn AS response_id, CASE WHEN turn % 4 = 0 THEN NULL ELSE sha256(coalesce(text, '')) END AS answer_sha256, CASE WHEN turn % 4 = 1 THEN NULL ELSE sha256(coalesce(text, '') || CASE WHEN turn % 4 = 2 THEN '!' ELSE '' END) END AS result_sha256 FROM conversations WHERE turn % 4 < 3""")
def inventory_mismatches(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    sheet = rows.filter("turn % 4 <> 0").select("response_id", F.sha2(F.col("text").cast("binary"), 256).alias("answer_sha256"))
    mapping = rows.filter("turn % 4 <> 1").select("response_id", F.col("response_id").alias("line"))
    results = rows.select(F.col("response_id").alias("line"), F.concat("text", F.when(F.col("turn") % 4 == 2, "!").otherwise("")).alias("text"))
    return review.inventory_mismatches(sheet, mapping, results)


@query("""SELECT doc_id FROM (SELECT DISTINCT doc_id, quality FROM labels) WHERE doc_id % 6 = 0""")
def stale_envelopes(spark, sf_dir):
    """Envelopes of judgments, rebuilt from sources of which some have changed since."""
    rows = table(spark, sf_dir, "labels").select("doc_id").distinct()
    sources = rows.select(F.col("doc_id").cast("string").alias("response_id"), F.lit("c").alias("claim"), F.lit("a").alias("answer"))
    changed = sources.withColumn("answer", F.when(F.col("response_id").cast("long") % 6 == 0, "b").otherwise("a"))
    judged = sources.select("response_id", F.lit("faithful").alias("judgment"))
    made = review.envelope(judged, sources, "reviewer", "m-1", "judge it")
    return review.stale_envelopes(made, judged, changed, "reviewer", "m-1", "judge it").select(F.col("response_id").cast("long").alias("doc_id"))


@query(r"""WITH t AS (SELECT item_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\p{L}0-9]+[^\p{L}0-9]*') AS p, length(regexp_extract(coalesce(text, ''), '^[^\p{L}0-9]*')) AS lead FROM benchmark),
u AS (SELECT item_id, text, len(p) AS n, generate_subscripts(p, 1) AS i, unnest(p) AS piece, lead FROM t),
v AS (SELECT *, lead + coalesce(sum(length(piece)) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u)
SELECT item_id AS doc_id, (i - 1) // 12 AS ordinal, min(s)::BIGINT AS start, max(s + length(regexp_replace(piece, '[^\p{L}0-9]+$', '')))::BIGINT AS "end" FROM v GROUP BY 1, 2""")
def source_windows(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return chunking.source_windows(items, 12).select("doc_id", "ordinal", "start", "end")


@query("""SELECT doc_id, length(coalesce(text, '')) AS n_chars, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE 1 END > 0 AS some FROM documents""")
def reader_window_cover(spark, sf_dir):
    """Gap-free windows of each document: together they have every character once."""
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    w = chunking.reader_windows(docs.select(F.struct("row", "doc_id").alias("doc_id"), "text"), 40)
    sums = w.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.max("end").alias("last"), F.min("start").alias("first"))
    whole = docs.select(F.struct("row", "doc_id").alias("doc_id"), F.col("doc_id").alias("id")).join(sums, "doc_id", "left")
    return whole.select(F.col("id").alias("doc_id"), F.when(F.col("first") == 0, F.least("n", "last")).otherwise(F.lit(0)).alias("n_chars"), F.col("n").isNotNull().alias("some")).fillna({"n_chars": 0})


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'too-long' ELSE 'blank' END AS reason FROM conversations WHERE turn % 4 < 3""")
def rejected_queries(spark, sf_dir):
    r = F.pmod("turn", F.lit(4))
    said = F.when(r == 0, "  ").when(r == 1, F.repeat(F.lit("ab "), 2000)).when(r == 3, "a question")
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), said.alias("text"))
    return Engine(views.documents(spark, sf_dir)).rejected(rows).select("query_id.*", "reason")


@query("""WITH c AS (SELECT n_regionkey AS r, count(*) AS cases, sum(n_nationkey) AS s FROM nation GROUP BY 1) SELECT r AS subject, cases, round(s / cases, 6) AS mean FROM c""")
def published_counts(spark, sf_dir):
    """A table of numbers only, passed by the publication filter."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("subject")).agg(F.count(F.lit(1)).alias("cases"), round_to(F.avg("n_nationkey")).alias("mean"))
    return reports.whitelisted(n, ["subject", "cases", "mean"])
