"""Registered queries: storage, journals, contexts, reports and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions.numeric import round_to
from evidara.operators import checks, context, journal, reports, review, sampling, store
from evidara.plans import views
from evidara.plans.views import DOCS, query


def _versions(spark, sf_dir):
    """A stored state of the documents and a batch that changes, adds and repeats some."""
    docs = views.documents(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    stored = docs.filter("doc_id % 4 <> 3")
    incoming = docs.filter("doc_id % 3 <> 1").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    return stored, incoming


@query(f"""WITH {DOCS}, s AS (SELECT * FROM docs WHERE doc_id % 4 <> 3), n AS (SELECT doc_id, title, CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END AS text FROM docs WHERE doc_id % 3 <> 1)
SELECT doc_id, CASE WHEN n.doc_id IS NULL THEN s.title ELSE n.title END AS title, sha256(CASE WHEN n.doc_id IS NULL THEN s.text ELSE n.text END) AS digest,
 CASE WHEN n.doc_id IS NULL THEN 'kept' WHEN s.doc_id IS NULL THEN 'inserted' WHEN s.text <> n.text OR s.title <> n.title THEN 'updated' ELSE 'unchanged' END AS action FROM s FULL JOIN n USING (doc_id)""")
def upsert_merge(spark, sf_dir):
    out = store.upsert(*_versions(spark, sf_dir))
    return out.select("doc_id", "title", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "action")


@query(f"""WITH {DOCS}, n AS (SELECT doc_id, {views.WORDS.format("title || chr(10) || text || CASE WHEN doc_id % 5 = 0 THEN ' changed' ELSE '' END")} AS w FROM docs) SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM n) GROUP BY 1, 2""")
def lexical_refresh(spark, sf_dir):
    """Postings after every fifth document changed: only those are computed anew."""
    from evidara.operators.lexical import postings

    docs = views.documents(spark, sf_dir)
    now = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    return store.refresh_postings(postings(docs), now, now.filter("doc_id % 5 = 0")).select("doc_id", "term", "tf")


_CHUNKS = "c AS (SELECT vec_id // 4 AS doc_id, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS representation, vec_id % 4 AS ordinal FROM embeddings)"


@query(f"WITH {_CHUNKS} SELECT doc_id, representation, ordinal FROM c WHERE representation <> 'even' OR doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'even', ordinal + 10 FROM c WHERE doc_id % 3 = 0")
def replace_representation(spark, sf_dir):
    chunks = views.chunks(spark, sf_dir).select("doc_id", "representation", "ordinal")
    touched = chunks.filter("doc_id % 3 = 0")
    incoming = touched.select("doc_id", F.lit("even").alias("representation"), (F.col("ordinal") + 10).alias("ordinal"))
    return store.replace_representations(chunks, incoming, touched, ["even"])


@query(f"WITH {_CHUNKS} SELECT doc_id, representation, ordinal FROM c WHERE representation = 'odd' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def chunk_lookup(spark, sf_dir):
    wanted = views.table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id")
    return store.load_chunks(views.chunks(spark, sf_dir), wanted, ["odd"]).select("doc_id", "representation", "ordinal")


@query("SELECT DISTINCT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = e.event_type AND f.value > 95)")
def resume_missing(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return journal.missing_runs(e.select("user_id", "event_type").distinct(), e.filter("value > 95"), "user_id", "event_type")


@query("""WITH e AS (SELECT event_id // 3 AS candidate_id, CASE WHEN event_type = 'view' THEN 'started' ELSE 'result' END AS event FROM events), c AS (SELECT candidate_id, count(*) FILTER (event = 'started') AS starts, count(*) FILTER (event <> 'started') AS ends FROM e GROUP BY 1)
SELECT candidate_id, starts, ends, CASE WHEN starts > 1 OR ends > 1 OR starts = 0 THEN 'invalid' WHEN ends = 1 THEN 'completed' ELSE 'outcome-unknown' END AS state FROM c""")
def journal_state(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("candidate_id"), F.when(F.col("event_type") == "view", "started").otherwise("result").alias("event"))
    return journal.journal_state(e)


@query("""WITH r AS (SELECT user_id, event_id, event_id % 60 AS seconds, event_type = 'error' AND event_id % 5 = 0 AS failed FROM events), w AS (SELECT *, coalesce(sum(seconds) OVER o, 0) AS spent, coalesce(max(failed::INT) OVER o, 0) AS halted FROM r WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, spent < 900 AND halted = 0 AS dispatched FROM w""")
def budgeted_dispatch(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("user_id", "event_id", F.pmod("event_id", F.lit(60)).alias("seconds"), ((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).alias("failed"))
    return journal.budgeted_dispatch(e, 900, "event_id", group="user_id").select("user_id", "event_id", "dispatched")


@query("""WITH v AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations WHERE text IS NOT NULL), n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1)
SELECT conv_id AS doc_id, turn AS ordinal FROM v JOIN n USING (conv_id) WHERE r <= 2""")
def adaptive_context(spark, sf_dir):
    """Every conversation as a document whose turns are its views, scored by their length."""
    c = views.table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    views_ = c.select(F.lit(0).alias("query_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), "text", F.length("text").alias("view_score"))
    hits = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("rank")).select(F.lit(0).alias("query_id"), "doc_id", "rank", F.lit(1.0).alias("score"), F.lit("").alias("text"))
    return context.adaptive_context(hits, views_).select("doc_id", "ordinal")


@query("""WITH RECURSIVE c AS (SELECT conv_id AS k, turn AS ordinal, len(string_split(coalesce(text, ''), ' ')) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3 DESC, turn) AS i FROM conversations),
 r(k, i, ordinal, used, ok) AS (SELECT k, i, ordinal, CASE WHEN tokens <= 60 THEN tokens ELSE 0 END, tokens <= 60 FROM c WHERE i = 1 UNION ALL SELECT c.k, c.i, c.ordinal, CASE WHEN used + tokens <= 60 THEN used + tokens ELSE used END, used + tokens <= 60 FROM r JOIN c ON c.k = r.k AND c.i = r.i + 1)
SELECT k AS candidate_id, ordinal, ok AS admitted FROM r""")
def budgeted_admission(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    tokens = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    chunks = c.select(F.col("conv_id").alias("candidate_id"), F.col("turn").alias("ordinal"), F.pmod("turn", F.lit(3)).alias("score"), tokens.alias("tokens"))
    return context.admit_within_budget(chunks, 60)


@query("""WITH a AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Insufficient Evidence' WHEN 1 THEN 'said [' || conv_id || ']' WHEN 2 THEN 'said [x' || conv_id || '] and [' || conv_id || ']' ELSE 'nothing cited' END AS answer FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN answer ELSE 'insufficient evidence' END AS final, CASE WHEN turn % 4 = 1 THEN conv_id::VARCHAR ELSE '' END AS citations, turn % 4 IN (0, 1) AS valid FROM a""")
def citation_gate(spark, sf_dir):
    r = F.pmod("turn", F.lit(4))
    answer = F.when(r == 0, "Insufficient Evidence").when(r == 1, F.concat(F.lit("said ["), "conv_id", F.lit("]"))).when(r == 2, F.concat(F.lit("said [x"), "conv_id", F.lit("] and ["), "conv_id", F.lit("]"))).otherwise("nothing cited")
    rows = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"), F.array("conv_id").alias("allowed"))
    return context.gate_answers(rows).select("conv_id", "turn", "final", F.array_join("citations", ",").alias("citations"), "valid")


@query("""WITH g AS (SELECT event_type AS policy, CASE WHEN user_id % 10 = 0 THEN 'timeout' END AS error_type, value > 50 AS relevant, CASE WHEN user_id % 3 > 0 THEN (event_id % 11) / 10.0 END AS recall, CASE WHEN user_id % 4 > 0 THEN event_id % 2 = 0 END AS cit,
 CASE WHEN event_id % 9 = 0 THEN 'insufficient evidence' ELSE 'x' END AS answer, CASE WHEN user_id % 5 > 0 THEN event_id % 3 = 0 END AS stance, event_id % 50 AS tokens, user_id % 7 AS contexts, event_id % 13 AS made, value AS ms FROM events)
SELECT policy, count(*) AS n_rows, count(*) FILTER (error_type IS NULL) AS successful, count(*) FILTER (error_type IS NOT NULL) AS failed, round(avg(relevant::INT), 6) AS relevant_rate, round(avg(recall), 6) AS evidence_recall, round(avg(cit::INT), 6) AS citation_valid_rate,
 round(avg(CASE WHEN error_type IS NULL THEN (answer = 'insufficient evidence')::INT END), 6) AS insufficient_rate, count(CASE WHEN error_type IS NULL THEN stance END) AS stance_scored, round(avg(CASE WHEN error_type IS NULL THEN stance::INT END), 6) AS stance_accuracy, round(median(tokens), 4) AS median_input_tokens, round(median(contexts), 4) AS median_contexts, round(median(made), 4) AS median_generated_tokens, round(median(ms), 4) AS median_generator_ms FROM g GROUP BY 1""")
def generation_report(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    rows = views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("policy"), F.when(u % 10 == 0, "timeout").alias("error_type"), (F.col("value") > 50).alias("relevant_retrieved"), F.when(u % 3 > 0, (e % 11) / 10.0).alias("evidence_recall"), F.when(u % 4 > 0, e % 2 == 0).alias("citation_valid"),
        F.when(e % 9 == 0, "insufficient evidence").otherwise("x").alias("answer"), F.when(u % 5 > 0, e % 3 == 0).alias("stance_correct"), (u % 7).alias("contexts"), (e % 50).alias("input_tokens"), (e % 13).alias("generated_tokens"), F.col("value").alias("generator_ms"),
    )
    return reports.generation_report(rows)


@query("""WITH s AS (SELECT item_id AS query_id, i AS sentence_index, trim(string_split(text, '.')[i]) AS sentence FROM (SELECT item_id, text, unnest(generate_series(1, len(string_split(text, '.')))) AS i FROM benchmark)), g AS (SELECT query_id, sentence_index, lower(trim(regexp_replace(sentence, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS s FROM s WHERE length(sentence) > 0),
 c AS (SELECT item_id AS query_id, lower(trim(regexp_replace(substr(text, 1, 150), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS c FROM benchmark)
SELECT query_id, count(*) AS eligible, count(*) FILTER (contains(c, s)) AS matched, round(count(*) FILTER (contains(c, s)) / count(*), 6) AS recall FROM g JOIN c USING (query_id) GROUP BY 1""")
def evidence_sentence_recall(spark, sf_dir):
    b = views.table(spark, sf_dir, "benchmark")
    parts = b.select(F.col("item_id").alias("query_id"), F.posexplode(F.split("text", r"\.")).alias("i", "s")).select("query_id", F.col("query_id").alias("doc_id"), (F.col("i") + 1).alias("sentence_index"), F.trim("s").alias("sentence")).filter("length(sentence) > 0")
    contexts = b.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("doc_id"), F.substring("text", 1, 150).alias("text"))
    return reports.evidence_sentence_recall(parts, contexts)


@query("SELECT event_type AS arm, count(*) AS requests, count(*) FILTER (user_id % 6 > 0) AS completed, count(*) FILTER (user_id % 6 = 0) AS failed, sum(event_id % 40)::BIGINT AS tokens, round(sum(value), 2) AS seconds FROM events GROUP BY 1")
def reader_accounting(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.when(F.col("user_id") % 6 > 0, "completed").otherwise("failed").alias("status"), (F.col("event_id") % 40).alias("tokens"), F.col("value").alias("seconds"), F.col("user_id").alias("prompt_id"))
    return reports.reader_accounting(e, ["view", "click"])[0].withColumn("seconds", round_to(F.col("seconds"), 2))


@query("""WITH p AS (SELECT unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_tax > 0.07 THEN 'tax' END], lambda x: x IS NOT NULL)) AS problem FROM lineitem) SELECT problem, count(*) AS n_rows FROM p GROUP BY 1""")
def qualification_counters(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(checks.violations(discount=F.col("l_discount") > 0.08, quantity=F.col("l_quantity") > 45, tax=F.col("l_tax") > 0.07).alias("problems"))
    return reports.failure_counters(rows)


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS labels FROM lineitem WHERE l_discount < 0.05 GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def disputed_labels(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").withColumn("verified", F.col("l_discount") < 0.05)
    return reports.disputed(rows, "l_orderkey", "l_returnflag", "verified")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def membership_reconcile(spark, sf_dir):
    return checks.difference(views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels").filter("doc_id % 2 = 0"), "doc_id")


@query("SELECT text, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return checks.duplicates(views.table(spark, sf_dir, "documents"), "text")


@query("SELECT item_id, array_to_string(CASE (row_number() OVER (ORDER BY item_id) - 1) % 3 WHEN 0 THEN ['full', 'selected', 'oracle'] WHEN 1 THEN ['selected', 'oracle', 'full'] ELSE ['oracle', 'full', 'selected'] END, ',') AS arms FROM benchmark")
def rotating_arms(spark, sf_dir):
    return sampling.rotating_arms(views.table(spark, sf_dir, "benchmark"), "item_id", ["full", "selected", "oracle"]).select("item_id", F.array_join("arms", ",").alias("arms"))


@query("""WITH r AS (SELECT doc_id AS response_id, CASE doc_id % 4 WHEN 0 THEN 'faithful' WHEN 1 THEN 'unfaithful' WHEN 2 THEN 'uncertain' ELSE 'other' END AS d, CASE WHEN doc_id % 3 = 0 THEN ['omission'] ELSE [] END AS p, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'why' END AS why FROM labels),
v AS (SELECT response_id, list_filter([CASE WHEN why = '' THEN 'blank-rationale' END, CASE WHEN d = 'faithful' AND len(p) > 0 THEN 'faithful-with-phenomena' END, CASE WHEN d = 'unfaithful' AND len(p) = 0 THEN 'unfaithful-without-phenomena' END, CASE WHEN d = 'other' THEN 'unknown-disposition' END], lambda x: x IS NOT NULL) AS v FROM r)
SELECT response_id, array_to_string(v, ',') AS violations FROM v WHERE len(v) > 0""")
def review_validation(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels")
    r = F.pmod("doc_id", F.lit(4))
    reviews = labels.select(
        F.col("doc_id").alias("response_id"), F.when(r == 0, "faithful").when(r == 1, "unfaithful").when(r == 2, "uncertain").otherwise("other").alias("disposition"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("omission"))).otherwise(F.array().cast("array<string>")).alias("phenomena"), F.lit(None).cast("string").alias("quote"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("why").alias("rationale"),
    )
    sources = labels.select(F.col("doc_id").alias("response_id"), F.lit("an answer").alias("answer"))
    return review.review_violations(reviews, sources).select("response_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    """An extension beyond retrieval: tumbling windows over the event table."""
    from evidara.streaming.windows import hourly

    return hourly(views.table(spark, sf_dir, "events")).select("event_type", "hour", "n", "total")
