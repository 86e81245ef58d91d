"""Registered queries: scans and sinks by a round trip through files, sessions, journals and proposition spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import journal, propositions
from evidara.plans import views
from evidara.plans.views import query, scratch, table
from evidara.sources import archives, readers, sinks
from evidara.streaming import machine, windows


@query(f"""WITH {views.DOCS} SELECT doc_id::VARCHAR AS doc_id, title, sha256(text) AS digest FROM docs""")
def corpus_scan(spark, sf_dir):
    """Documents written as JSON lines and scanned again; a missing title is empty."""
    path = scratch(spark)
    views.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("_id"), F.nullif("title", F.lit("")).alias("title"), "text").write.json(path)
    return readers.corpus(spark, path).select("doc_id", "title", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("""SELECT item_id::VARCHAR AS query_id, CASE WHEN item_id % 3 = 0 THEN 'again' ELSE text END AS text FROM benchmark""")
def query_scan(spark, sf_dir):
    """Items as JSON lines of which some ids come twice: the last line stands."""
    path = scratch(spark)
    rows = views.queries(spark, sf_dir).select(F.col("query_id").cast("string").alias("_id"), "text")
    twice = rows.select("_id", "text", F.explode(F.when(F.col("_id").cast("long") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n"))
    twice.select("_id", F.when(F.col("n") == 1, "again").otherwise(F.col("text")).alias("text"), "n").coalesce(1).sortWithinPartitions("n").drop("n").write.json(path)
    return readers.queries(spark, path)


@query("""SELECT doc_id::VARCHAR AS query_id, 'd' || doc_id AS doc_id, quality::INT AS grade FROM (SELECT DISTINCT doc_id, quality FROM labels)""")
def qrels_scan(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    rows.select(F.col("doc_id").cast("string").alias("query-id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("corpus-id"), F.col("quality").alias("score")).write.csv(path, sep="\t", header=True)
    return readers.qrels(spark, path)


@query("""SELECT c_custkey::VARCHAR AS key, c_name AS name, c_nationkey::INT AS nation FROM customer""")
def unique_record_scan(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("nation")).write.json(path)
    return readers.unique_records(spark, path, "key string, name string, nation int", "key")


@query("""SELECT event_id::VARCHAR AS candidate_id, 'r1' AS run_id, event_type AS event, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events""")
def journal_round_trip(spark, sf_dir):
    """Events appended in two steps to a journal of canonical lines and read strictly, as records of one run."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("candidate_id"), F.lit("r1").alias("run_id"), F.col("event_type").alias("event"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"))
    for part in (0, 1):
        sinks.append_journal(rows.filter(F.col("candidate_id").cast("long") % 2 == part), path)
    return readers.strict_records(spark, path, "candidate_id string, event string, run_id string, value double", "r1")


@query("""SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations""")
def csv_scan(spark, sf_dir):
    """Turns as quoted fields, some over several lines."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("said, \"so\"\n"), F.coalesce("text", F.lit(""))).alias("text"))
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    kinds = dict(rows.dtypes)
    got = readers.csv_table(spark, path, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, text string")
    return got.select("conv_id", "turn", F.substring("text", 12, 1 << 30).alias("text"))


@query("""SELECT page_id, 'T' || page_id AS title, 'PMC' || page_id AS ids, 'by' AS licences, 'A,B' AS contributors FROM pages""")
def xml_scan(spark, sf_dir):
    n = F.col("page_id").cast("string")
    xml = F.concat(F.lit("<a><front><article-title>T"), n, F.lit("</article-title><article-id>PMC"), n, F.lit("</article-id><license href='by'/><contrib><name><surname>A</surname></name></contrib><contrib><surname>B</surname></contrib></front></a>"))
    rows = readers.xml_metadata(table(spark, sf_dir, "pages").select("page_id", xml.alias("xml")))
    joined = lambda c: F.array_join(c, ",")
    return rows.select("page_id", "title", joined("article_ids").alias("ids"), joined("licences").alias("licences"), joined("contributors").alias("contributors"))


@query("""WITH l AS (SELECT user_id, ts, ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""")
def event_sessions(spark, sf_dir):
    found = windows.sessions(table(spark, sf_dir, "events"))
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("""SELECT DISTINCT user_id AS candidate_id, event_type AS event FROM events""")
def journal_once(spark, sf_dir):
    return windows.journal_once(table(spark, sf_dir, "events").select(F.col("user_id").alias("candidate_id"), F.col("event_type").alias("event"), "ts")).select("candidate_id", "event")


@query("""WITH e AS (SELECT event_id // 3 AS candidate_id, CASE WHEN event_type = 'view' THEN 'started' ELSE 'result' END AS event FROM events), c AS (SELECT candidate_id, count(*) FILTER (event = 'started') AS starts, count(*) FILTER (event <> 'started') AS ends FROM e GROUP BY 1)
SELECT candidate_id, starts, ends, CASE WHEN starts > 1 OR ends > 1 OR starts = 0 THEN 'invalid' WHEN ends = 1 THEN 'completed' ELSE 'outcome-unknown' END AS state FROM c""")
def journal_stream(spark, sf_dir):
    """The journal's machine over events that come in two files, with a restart between them."""
    events = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 3).alias("candidate_id"), F.when(F.col("event_type") == "view", "started").otherwise("result").alias("event"))
    path = scratch(spark)
    for part in (0, 1):
        events.filter(F.pmod("event_id", F.lit(2)) == part).select("candidate_id", "event").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("candidate_id long, event string").parquet(f"{path}/in")
        machine.follow(machine.journal_states(stream), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return machine.latest(spark, f"{path}/out").select("candidate_id", "starts", "ends", "state")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def journal_to_run(spark, sf_dir):
    planned = table(spark, sf_dir, "customer").select("c_custkey")
    states = journal.journal_state(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("started").alias("event")), "c_custkey")
    return journal.to_run(planned, states, "c_custkey")


@query("""WITH d AS (SELECT doc_id, text, doc_id % 5 AS r FROM documents WHERE length(text) > 30)
SELECT doc_id, CASE r WHEN 1 THEN 'bad-range,text-mismatch' WHEN 2 THEN 'text-mismatch' WHEN 3 THEN 'outside-sentence' END AS violations FROM d WHERE r IN (1, 2, 3)""")
def proposition_span_rules(spark, sf_dir):
    """Spans of documents: some end before they begin, some have another text, some leave their sentence."""
    docs = table(spark, sf_dir, "documents").filter("length(text) > 30")
    r = F.pmod("doc_id", F.lit(5))
    end = F.when(r == 1, 4).otherwise(20)
    said = F.when(r == 2, F.lit("\x01")).otherwise(F.concat(F.lit("") , F.substring("text", 6, 15)))
    spans = docs.select("doc_id", F.col("text").alias("source"), F.lit(5).alias("start"), end.alias("end"), F.when(F.trim(said) == "", "x").otherwise(said).alias("text"), F.lit(0).alias("sentence_start"), F.when(r == 3, 18).when(r == 1, 4).otherwise(30).alias("sentence_end"))
    return propositions.span_violations(spans).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("""SELECT DISTINCT unnest([n_name, 'is in', 'region ' || n_regionkey, 'q' || (n_nationkey % 3)]) AS surface FROM nation""")
def proposition_surfaces(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    quality = F.array(F.struct(F.lit("time").alias("role"), F.concat(F.lit("q"), (F.col("n_nationkey") % 3).cast("string")).alias("text")))
    return propositions.surfaces(n.select(F.col("n_name").alias("subject"), F.lit("is in").alias("predicate"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("object"), quality.alias("qualifiers")))


#: Names of an annotation's label codes.
LABEL_NAMES = {"-1": "significantly decreased", "0": "no significant difference", "1": "significantly increased"}


@query("""WITH r AS (SELECT doc_id, quality - toxic AS code, doc_id % 7 AS k FROM labels),
e AS (SELECT r.*, coalesce(d.text, '') AS text, coalesce(d.lang, '') AS outcome, substr(coalesce(d.text, ''), 3, 40) AS said FROM r JOIN documents d USING (doc_id)),
f AS (SELECT *, CASE k WHEN 1 THEN 'zz' || said WHEN 2 THEN '' ELSE said END AS evidence FROM e)
SELECT doc_id::VARCHAR AS prompt_id, outcome, evidence, CASE code WHEN -1 THEN 'significantly decreased' WHEN 0 THEN 'no significant difference' WHEN 1 THEN 'significantly increased' END AS label,
CASE WHEN k = 4 THEN 'invalid_offset' WHEN k = 3 THEN 'publisher_unavailable' WHEN length(text) <= 41 THEN 'out_of_bounds' WHEN evidence = '' THEN 'empty_evidence' WHEN evidence = said THEN 'exact' ELSE 'mismatch' END AS status FROM f""")
def archived_annotations(spark, sf_dir):
    """Documents, prompts and annotations packed into archives and merged again from their members, each evidence judged by its offsets."""
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, sf_dir, "labels")
    k, said = F.pmod("doc_id", F.lit(7)), F.substring("text", 3, 40)
    rows = labels.join(docs, "doc_id")
    evidence = F.when(k == 1, F.concat(F.lit("zz"), said)).when(k == 2, "").otherwise(said)
    start = F.when(k == 3, "-1").when(k == 4, "none").otherwise("2")
    end = F.when(k == 3, "-1").otherwise("41")
    code = (F.col("quality") - F.col("toxic")).cast("string")
    own = F.col("doc_id").alias("PMCID"), F.col("doc_id").alias("PromptID")
    texts = docs.select(F.concat(F.lit("txt_files/PMC"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    prompts = archives.csv_members(rows.select(*own, F.col("lang").alias("Outcome")), "prompts")
    said_so = archives.csv_members(rows.select(*own, code.alias("Label Code"), evidence.alias("Annotations"), start.alias("Evidence Start"), end.alias("Evidence End")), "annotations")
    archives.pack(texts.unionByName(prompts).unionByName(said_so), path)

    found = archives.members(spark, path)
    article = F.regexp_extract("name", r"^txt_files/PMC(.*)\.txt$", 1)
    texts = found.filter(F.col("name").startswith("txt_files/")).select(article.alias("PMCID"), F.decode("content", "UTF-8").alias("text"))
    prompts = archives.csv_rows(found.filter(F.col("name").startswith("prompts/")), ["PromptID", "Outcome"])
    notes = archives.csv_rows(found.filter(F.col("name").startswith("annotations/")), ["PMCID", "PromptID", "Label Code", "Annotations", "Evidence Start", "Evidence End"])
    label = F.create_map(*[F.lit(x) for pair in LABEL_NAMES.items() for x in pair])[F.col("Label Code")]
    merged = notes.join(prompts, "PromptID").join(texts, "PMCID")
    status = archives.evidence_status(F.col("text"), F.col("Annotations"), F.col("Evidence Start"), F.col("Evidence End"))
    return merged.select(F.col("PromptID").alias("prompt_id"), F.col("Outcome").alias("outcome"), F.col("Annotations").alias("evidence"), label.alias("label"), status.alias("status"))


_W = r"[ \t\n\r\f]"
_CLAUSE = rf"(?s)^([^ \t\n\r\f].*?)({_W}+)((?:is|are|was|were|has|have|had|can|may|will|est|sont|ist|sind|war|hat)(?:{_W}+(?:not|never|pas|jamais|nicht|nie))?)({_W}+)([^ \t\n\r\f.!?].*)\z"
_SPLIT = rf"(?s)^(.*?[^ \t\n\r\f])({_W}+)(during|after|before|pendant|nach|vor|than|versus|que|als|in|at|dans|im|among|for|pour|bei|with|by|avec|mit)({_W}+)([^ \t\n\r\f].*)\z"


@query(rf"""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+$') AS p FROM documents), e AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM p),
f AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, regexp_replace(piece, '^\s+', '') AS led FROM e),
g AS (SELECT doc_id, i, (base + length(piece) - length(led))::BIGINT AS start, regexp_replace(led, '\s+$', '') AS text FROM f),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, start, text FROM g WHERE length(text) > 0),
c AS (SELECT *, regexp_extract(text, '{_CLAUSE}', ['g1', 'g2', 'g3', 'g4', 'g5']) AS m FROM s WHERE regexp_matches(text, '{_CLAUSE}')),
r AS (SELECT *, rtrim(m.g5, E' \t\n\r\f.!?') AS rest, start + length(m.g1) + length(m.g2) AS ps, start + length(m.g1) + length(m.g2) + length(m.g3) + length(m.g4) AS os FROM c),
q AS (SELECT *, regexp_extract(rest, '{_SPLIT}', ['q1', 'q2', 'q3', 'q4', 'q5']) AS k FROM r)
SELECT doc_id, ordinal::BIGINT AS ordinal, start AS sentence_start, start + length(text) AS sentence_end, m.g1 AS subject, start AS subject_start, m.g3 AS predicate, ps AS predicate_start,
CASE WHEN k.q1 <> '' THEN k.q1 ELSE rest END AS object, os AS object_start, CASE WHEN k.q1 <> '' THEN k.q5 END AS qualifier, CASE WHEN k.q1 <> '' THEN os + length(k.q1) + length(k.q2) + length(k.q3) + length(k.q4) END AS qualifier_start,
CASE WHEN k.q1 = '' THEN NULL WHEN k.q3 IN ('during', 'after', 'before', 'pendant', 'nach', 'vor') THEN 'time' WHEN k.q3 IN ('than', 'versus', 'que', 'als') THEN 'comparator' WHEN k.q3 IN ('in', 'at', 'dans', 'im') THEN 'study-context' WHEN k.q3 IN ('among', 'for', 'pour', 'bei') THEN 'population' ELSE 'intervention' END AS role,
CASE WHEN regexp_matches(m.g3, '{_W}') THEN 'negative' ELSE 'positive' END AS polarity FROM q""")
def extracted_propositions(spark, sf_dir):
    """Propositions of all sentences of all documents, with their exact spans."""
    found = propositions.extract_propositions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("proposition_id").withColumn("ordinal", F.col("ordinal").cast("long"))
