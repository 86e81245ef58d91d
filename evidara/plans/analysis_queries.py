"""Registered queries: statistics, audits, intervals, text functions, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import text as T
from evidara.functions.numeric import evidence_margin, logistic, polarity_margin, predicted_label, round_to
from evidara.operators import graph, intervals, propositions, reports, sampling, statistics
from evidara.plans import views
from evidara.plans.views import query

# Gold and predicted labels of a document: from its label row, and from its own id.
_LABELLED = """lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'contradiction' WHEN quality = 1 THEN 'entailment' ELSE 'neutral' END AS gold,
  CASE doc_id % 4 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' WHEN 2 THEN 'contradiction' ELSE 'entailment' END AS predicted, quality, toxic, doc_id % 97 AS score FROM labels)"""


def _labelled(spark, sf_dir):
    r = F.pmod("doc_id", F.lit(4))
    return views.table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "contradiction").when(F.col("quality") == 1, "entailment").otherwise("neutral").alias("gold"),
        F.when(r == 1, "neutral").when(r == 2, "contradiction").otherwise("entailment").alias("predicted"), "quality", "toxic", F.pmod("doc_id", F.lit(97)).alias("score"),
    )


_GRID = "grid AS (SELECT g.l AS gold, p.l AS predicted FROM (VALUES ('entailment'), ('neutral'), ('contradiction')) g(l), (VALUES ('entailment'), ('neutral'), ('contradiction')) p(l))"


@query(f"WITH {_LABELLED}, {_GRID} SELECT gold, predicted, count(doc_id) AS n FROM grid LEFT JOIN lab USING (gold, predicted) GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return statistics.confusion(_labelled(spark, sf_dir))


@query(f"""WITH {_LABELLED}, l AS (SELECT unnest(['entailment', 'neutral', 'contradiction']) AS label),
c AS (SELECT label, (SELECT count(*) FROM lab WHERE gold = label) AS support, (SELECT count(*) FROM lab WHERE predicted = label) AS told, (SELECT count(*) FROM lab WHERE gold = label AND predicted = label) AS tp FROM l),
m AS (SELECT label, support, tp, coalesce(tp / nullif(told, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS r FROM c), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM m)
SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(coalesce(sum(tp) OVER () / nullif(sum(support) OVER (), 0), 0.0), 6) AS accuracy, round(avg(f1) OVER (), 6) AS macro_f1 FROM f""")
def class_metrics(spark, sf_dir):
    return statistics.class_metrics(_labelled(spark, sf_dir))


@query(f"""WITH {_LABELLED}, c AS (SELECT gold, count(*) AS n FROM lab GROUP BY 1), t AS (SELECT *, sum(n) OVER ()::BIGINT AS total FROM c)
SELECT gold AS majority, n AS correct, total, round(n / total, 6) AS accuracy, round(2 * (n / total) / (1 + n / total) / 3, 6) AS macro_f1 FROM t ORDER BY n DESC, list_position(['entailment', 'neutral', 'contradiction'], gold) LIMIT 1""")
def label_prior(spark, sf_dir):
    return statistics.label_prior(_labelled(spark, sf_dir))


@query(f"""WITH {_LABELLED}, r AS (SELECT quality = 1 AS pos, score, doc_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid, row_number() OVER (ORDER BY score DESC, doc_id) AS i FROM lab),
h AS (SELECT *, sum(pos::INT) OVER (ORDER BY i) AS hits FROM r), s AS (SELECT count(*) AS n, count(*) FILTER (pos) AS p, sum(mid) FILTER (pos) AS ranks, sum(hits / i) FILTER (pos) AS precs FROM h)
SELECT n, p AS positives, round((ranks - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS roc_auc, round(precs / p, 6) AS average_precision, round(p / n, 6) AS prevalence,
 CASE WHEN round((ranks - p * (p + 1) / 2.0) / (p * (n - p)), 6) >= 0.65 AND round(precs / p, 6) >= 2 * round(p / n, 6) THEN 'graph-next' ELSE 'stop' END AS decision FROM s""")
def binary_separation(spark, sf_dir):
    rows = _labelled(spark, sf_dir).select((F.col("quality") == 1).alias("positive"), "score", F.col("doc_id").alias("position"))
    return statistics.graph_decision(statistics.binary_separation(rows))


@query("SELECT c_mktsegment AS segment, count(*) AS n, CASE WHEN count(*) > 1 THEN round(corr(c_acctbal, (c_custkey % 50)::DOUBLE), 6) END AS correlation FROM customer GROUP BY 1")
def pearson(spark, sf_dir):
    rows = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal", F.pmod("c_custkey", F.lit(50)).alias("k"))
    return statistics.pearson(rows, "c_acctbal", "k", "segment")


@query("""WITH r AS (SELECT c_mktsegment AS segment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey % 50) + (count(*) OVER (PARTITION BY c_mktsegment, c_custkey % 50) - 1) / 2.0 AS ry FROM customer) SELECT segment, count(*) AS n, round(corr(rx, ry), 6) AS correlation FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    rows = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal", F.pmod("c_custkey", F.lit(50)).alias("k"))
    return statistics.spearman(rows, "c_acctbal", "k", "segment")


@query("""WITH r AS (SELECT CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'uncertain' ELSE CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END END AS a, CASE WHEN doc_id % 7 = 3 THEN 'uncertain' WHEN toxic = 1 THEN 'no' ELSE 'yes' END AS b FROM labels),
c AS (SELECT count(*) AS pairs, count(*) FILTER (a IS NOT NULL) AS labelled, count(*) FILTER (a = b AND a <> 'uncertain') AS exact, count(*) FILTER (a IN ('yes', 'no') AND b IN ('yes', 'no')) AS resolved,
 count(*) FILTER (a = 'yes' AND b = 'yes') AS pp, count(*) FILTER (a = 'no' AND b = 'no') AS nn, count(*) FILTER (a IN ('yes', 'no') AND b IN ('yes', 'no') AND a <> b) AS mixed FROM r)
SELECT pairs, labelled, resolved, round(exact / nullif(labelled, 0), 6) AS exact_agreement, round((pp + nn) / nullif(resolved, 0), 6) AS resolved_agreement, round(2 * pp / nullif(2 * pp + mixed, 0), 6) AS positive_agreement, round(2 * nn / nullif(2 * nn + mixed, 0), 6) AS negative_agreement FROM c""")
def agreement(spark, sf_dir):
    r = F.pmod("doc_id", F.lit(5))
    a = F.when(r == 0, None).when(r == 1, "uncertain").when(F.col("quality") == 1, "yes").otherwise("no")
    b = F.when(F.pmod("doc_id", F.lit(7)) == 3, "uncertain").when(F.col("toxic") == 1, "no").otherwise("yes")
    return statistics.agreement(views.table(spark, sf_dir, "labels").select(a.alias("a"), b.alias("b")), "yes", "no")


@query("""WITH l AS (SELECT unnest([{'d': 'returnflag', 'v': l_returnflag}, {'d': 'linestatus', 'v': l_linestatus}]) AS g, unnest([{'f': 'quantity', 'x': l_quantity}, {'f': 'discount', 'x': l_discount}]) AS f FROM lineitem),
 m AS (SELECT d AS dimension, v AS value, f AS feature, x FROM (SELECT l_returnflag AS v, 'returnflag' AS d, 'quantity' AS f, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'returnflag', 'discount', l_discount FROM lineitem
 UNION ALL SELECT l_linestatus, 'linestatus', 'quantity', l_quantity FROM lineitem UNION ALL SELECT l_linestatus, 'linestatus', 'discount', l_discount FROM lineitem))
SELECT dimension, value, feature, count(x) AS n, round(min(x), 6) AS minimum, round(median(x), 6) AS median, round(avg(x), 6) AS mean, round(max(x), 6) AS maximum FROM m GROUP BY 1, 2, 3""")
def grouped_distributions(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return statistics.grouped_distributions(rows, ["returnflag", "linestatus"], ["quantity", "discount"])


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1) AS a, count(*) AS t, count(*) FILTER (toxic = 0) AS b FROM labels), f AS (SELECT *, list_filter([CASE WHEN a / t < 0.99 THEN 'quality' END, CASE WHEN b / t < 0.5 THEN 'toxic' END], lambda x: x IS NOT NULL) AS failed FROM c)
SELECT array_to_string(failed, ',') AS failed_conditions, len(failed) = 0 AS passed FROM f""")
def coverage_gate(spark, sf_dir):
    counts = views.table(spark, sf_dir, "labels").agg(
        F.count_if(F.col("quality") == 1).alias("quality_covered"), F.count(F.lit(1)).alias("quality_total"), F.count_if(F.col("toxic") == 0).alias("toxic_covered"), F.count(F.lit(1)).alias("toxic_total")
    )
    gate = statistics.coverage_gate(counts, {"quality": 0.99, "toxic": 0.5})
    return gate.select(F.array_join("failed_conditions", ",").alias("failed_conditions"), "passed")


def _arm_rows(spark, sf_dir):
    return _labelled(spark, sf_dir).select(F.pmod("doc_id", F.lit(40)).alias("article"), (F.col("quality") == 1).alias("selected"), (F.col("toxic") == 0).alias("full"))


@query()
def cluster_bootstrap(spark, sf_dir):
    """The draws are those of a generator that SQL does not have; a test replays them, and bootstrap_point has the estimate."""
    return statistics.cluster_bootstrap(_arm_rows(spark, sf_dir), "article", ("selected", "full"))


@query(f"""WITH {_LABELLED}, c AS (SELECT doc_id % 40 AS article, count(*) AS n, sum((quality = 1)::INT - (toxic = 0)::INT) AS d FROM lab GROUP BY 1) SELECT count(*) AS clusters, round(sum(d) / sum(n), 6) AS delta FROM c""")
def bootstrap_point(spark, sf_dir):
    return statistics.point_difference(statistics.cluster_sums(_arm_rows(spark, sf_dir), "article", ("selected", "full")))


@query(f"""WITH {_LABELLED}, n AS (SELECT doc_id AS candidate_id, gold, predicted, score AS margin FROM lab), d AS (SELECT candidate_id, gold || '-to-' || predicted AS stratum, 0 AS band FROM n WHERE gold <> 'neutral' AND gold <> predicted),
b AS (SELECT *, least(5, (row_number() OVER (PARTITION BY predicted ORDER BY margin, candidate_id) - 1) * 5 // count(*) OVER (PARTITION BY predicted) + 1) AS band FROM n WHERE gold = 'neutral' AND predicted <> 'neutral'),
p AS (SELECT *, row_number() OVER (PARTITION BY predicted, band ORDER BY candidate_id) AS i FROM b) SELECT * FROM d UNION ALL SELECT candidate_id, gold || '-to-' || predicted, band FROM p WHERE i <= 5""")
def stratified_audit(spark, sf_dir):
    return sampling.stratified_audit(_labelled(spark, sf_dir).select(F.col("doc_id").alias("candidate_id"), "gold", "predicted", F.col("score").alias("margin")))


@query("SELECT doc_id, sha256('audit:' || doc_id) AS digest FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY digest, doc_id LIMIT 64")
def hash_sample(spark, sf_dir):
    return sampling.hash_sample(views.table(spark, sf_dir, "documents"), "doc_id", "audit")


@query("""SELECT item_id, list_sum(list_transform(string_split(sha256(item_id::VARCHAR), ''), lambda c: strpos('0123456789abcdef', c) - 1))::BIGINT % 5 AS bucket FROM benchmark""")
def split_filter(spark, sf_dir):
    return views.table(spark, sf_dir, "benchmark").select("item_id", T.split_bucket(F.col("item_id")).alias("bucket"))


_SPANS = """a AS (SELECT l_orderkey AS k, (l_partkey % 400)::BIGINT AS s, (l_partkey % 400 + 5 + l_linenumber * 3)::BIGINT AS e FROM lineitem), b AS (SELECT l_orderkey AS k, (l_suppkey % 300)::BIGINT AS s, (l_suppkey % 300 + 40)::BIGINT AS e FROM lineitem)"""


def _merged(x: str) -> str:
    return f"""{x}1 AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {x}), {x}2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM {x}1),
{x}m AS (SELECT k, min(s) AS s, max(e) AS e FROM {x}2 GROUP BY k, i)"""


def _spans(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem")
    p, s = F.pmod("l_partkey", F.lit(400)), F.pmod("l_suppkey", F.lit(300))
    a = rows.select(F.col("l_orderkey").alias("k"), p.alias("start"), (p + 5 + F.col("l_linenumber") * 3).alias("end"))
    return a, rows.select(F.col("l_orderkey").alias("k"), s.alias("start"), (s + 40).alias("end"))


@query(f'WITH {_SPANS}, {_merged("a")} SELECT k, s AS start, e AS "end" FROM am')
def interval_union(spark, sf_dir):
    return intervals.union_intervals(_spans(spark, sf_dir)[0], "k")


@query(f"""WITH {_SPANS}, {_merged("a")}, {_merged("b")}, x AS (SELECT k, sum(least(am.e, bm.e) - greatest(am.s, bm.s))::BIGINT AS shared FROM am JOIN bm USING (k) WHERE am.s < bm.e AND bm.s < am.e GROUP BY 1),
t AS (SELECT k, sum(e - s)::BIGINT AS n FROM am GROUP BY 1), u AS (SELECT k, sum(e - s)::BIGINT AS n FROM bm GROUP BY 1)
SELECT k, t.n AS selected, u.n AS reference, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / t.n, 6) AS precision, round(coalesce(shared, 0) / u.n, 6) AS recall FROM t JOIN u USING (k) LEFT JOIN x USING (k)""")
def span_coverage(spark, sf_dir):
    return intervals.span_coverage(*_spans(spark, sf_dir), "k")


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS ordinal FROM lineitem WHERE l_returnflag <> 'N'), r AS (SELECT k, ordinal, ordinal - row_number() OVER (PARTITION BY k ORDER BY ordinal) AS i FROM o) SELECT k, min(ordinal) AS first, max(ordinal) AS last FROM r GROUP BY k, i""")
def omitted_ranges(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ordinal"), "l_returnflag")
    # A line that stands twice in an order is admitted only if none of them was returned.
    returned = rows.filter("l_returnflag <> 'N'").select("k", "ordinal").distinct()
    admitted = rows.select("k", "ordinal").distinct().join(returned, ["k", "ordinal"], "left_anti")
    return intervals.omitted_ranges(rows.select("k", "ordinal"), admitted, "k")


@query("""WITH w AS (SELECT l_orderkey AS k, l_linenumber * 50 AS s, l_linenumber * 50 + 40 AS e FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), r AS (SELECT DISTINCT l_orderkey AS k, 30 + l_orderkey % 100 AS s, 130 + l_orderkey % 200 AS e FROM lineitem),
c AS (SELECT k, w.s, w.e, greatest(0, least(w.e, r.e) - greatest(w.s, r.s)) AS n FROM w JOIN r USING (k)), p AS (SELECT k, [s] AS starts, n FROM c UNION ALL SELECT x.k, [x.s, y.s], x.n + y.n FROM c x JOIN c y ON x.k = y.k AND x.s < y.s),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, len(starts) DESC, starts) AS i FROM p) SELECT k, n::BIGINT AS covered FROM b WHERE i = 1""")
def best_pair(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem")
    windows = rows.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 50).alias("start"), (F.col("l_linenumber") * 50 + 40).alias("end"))
    reference = rows.select(F.col("l_orderkey").alias("k"), (30 + F.pmod("l_orderkey", F.lit(100))).alias("start"), (130 + F.pmod("l_orderkey", F.lit(200))).alias("end"))
    return intervals.best_pair(windows, reference, "k").select("k", "covered")


@query("""WITH c AS (SELECT o_custkey, least(min(o_orderkey) * 2, o_custkey * 2 + 1) AS component FROM orders GROUP BY 1)
SELECT DISTINCT o_orderkey * 2 AS node, component FROM orders JOIN c USING (o_custkey) UNION SELECT o_custkey * 2 + 1, component FROM c""")
def connected_components(spark, sf_dir):
    """Orders that share a customer nation and segment key; components over customers and orders."""
    orders = views.table(spark, sf_dir, "orders")
    ties = orders.select((F.col("o_orderkey") * 2).alias("a"), (F.col("o_custkey") * 2 + 1).alias("b"))
    return graph.components(ties)


_ARMS = "arms AS (SELECT doc_id % 50 AS article_id, quality = 1 AS full_ok, toxic = 0 AS selected_ok, doc_id % 3 > 0 AS oracle_ok, (doc_id % 11) / 10.0 AS recall FROM labels)"


def _arms(spark, sf_dir):
    return views.table(spark, sf_dir, "labels").select(
        F.pmod("doc_id", F.lit(50)).alias("article_id"), (F.col("quality") == 1).alias("full_ok"), (F.col("toxic") == 0).alias("selected_ok"), (F.pmod("doc_id", F.lit(3)) > 0).alias("oracle_ok"), (F.pmod("doc_id", F.lit(11)) / 10.0).alias("recall")
    )


@query(f"""WITH {_ARMS}, g AS (SELECT a, b, c FROM (VALUES (true), (false)) x(a), (VALUES (true), (false)) y(b), (VALUES (true), (false)) z(c))
SELECT a AS full_ok, b AS selected_ok, c AS oracle_ok, count(article_id) AS prompts, count(DISTINCT article_id) AS articles FROM g LEFT JOIN arms ON full_ok = a AND selected_ok = b AND oracle_ok = c GROUP BY 1, 2, 3""")
def contingency_partitions(spark, sf_dir):
    return reports.outcome_partitions(_arms(spark, sf_dir), ("full_ok", "selected_ok", "oracle_ok"))


@query(f"""WITH {_ARMS} SELECT count(*) AS prompts, count(*) FILTER (full_ok) AS full_ok_correct, count(*) FILTER (oracle_ok) AS oracle_ok_correct, round(avg(recall), 6) AS mean_recall, row_number() OVER (ORDER BY article_id) AS article_ordinal FROM arms GROUP BY article_id""")
def article_summary(spark, sf_dir):
    return reports.article_summary(_arms(spark, sf_dir), ["full_ok", "oracle_ok"])


@query(f"""WITH {_LABELLED}, l AS (SELECT unnest(['entailment', 'neutral', 'contradiction', 'insufficient_evidence']) AS l) SELECT x.l AS from_label, y.l AS to_label, count(doc_id) AS prompts, count(DISTINCT doc_id % 50) FILTER (doc_id IS NOT NULL) AS articles
FROM l x CROSS JOIN l y LEFT JOIN lab ON gold = x.l AND predicted = y.l GROUP BY 1, 2""")
def label_transitions(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("article_id", F.pmod("doc_id", F.lit(50)))
    return reports.label_transitions(rows, "gold", "predicted", ["entailment", "neutral", "contradiction", "insufficient_evidence"])


@query(r"""SELECT conv_id, turn, array_to_string(list_distinct_ordered, ',') AS citations, n_colons FROM (SELECT conv_id, turn, regexp_extract_all('see [' || conv_id || '] and [' || turn || '] or [' || conv_id || ']', '\[([^\[\]]+)\]', 1) AS c,
 CASE WHEN conv_id = turn THEN [conv_id::VARCHAR] ELSE [conv_id::VARCHAR, turn::VARCHAR] END AS list_distinct_ordered, length(text) - length(replace(text, 'e', '')) AS n_colons FROM conversations)""")
def citation_extract(spark, sf_dir):
    said = F.concat(F.lit("see ["), F.col("conv_id"), F.lit("] and ["), F.col("turn"), F.lit("] or ["), F.col("conv_id"), F.lit("]"))
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.citations(said), ",").alias("citations"), T.occurrences(F.col("text"), F.lit("e")).alias("n_colons"))


@query(r"""SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')))) AS normalised, length(regexp_replace(text, '\r\n?', chr(10), 'g')) AS n FROM documents WHERE text IS NOT NULL""")
def normalise_text(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.sha2(T.plain_normalised(F.col("text")).cast("binary"), 256).alias("normalised"), F.length(T.canonical_newlines(F.col("text"))).alias("n"))


@query()
def normalise_unicode(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(T.normalised_udf(F.col("text")).cast("binary"), 256).alias("normalised"), F.length(T.canonical_key_udf(F.col("text"))).alias("n_key"))


@query("""WITH s AS (SELECT doc_id, text, substr(text, 1, 20) AS quote, (doc_id % 3)::INT AS s, (doc_id % 3 + 20)::INT AS e FROM documents WHERE length(text) > 60),
 c AS (SELECT *, len(list_filter(generate_series(1, length(text)), lambda i: substr(text, i, length(quote)) = quote)) AS n FROM s)
SELECT doc_id, CASE WHEN substr(text, s + 1, e - s) = quote THEN 'exact' WHEN substr(text, s + 1, e - s + 1) = quote THEN 'inclusive' WHEN trim(substr(text, s + 1, e - s)) = trim(quote) THEN 'trimmed' WHEN n = 1 THEN 'elsewhere' WHEN n > 1 THEN 'ambiguous' ELSE 'absent' END AS status FROM c""")
def span_qualification(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").filter("length(text) > 60")
    start = F.pmod("doc_id", F.lit(3)).cast("int")
    return docs.select("doc_id", T.span_status(F.col("text"), F.substring("text", 1, 20), start, start + 20).alias("status"))


@query("""WITH x AS (SELECT doc_id, (doc_id % 7 - 3)::DOUBLE AS e, (doc_id % 5 - 2)::DOUBLE AS c, (doc_id % 3 - 1)::DOUBLE AS n FROM documents)
SELECT doc_id, CASE WHEN e >= c AND e >= n THEN 'entailment' WHEN c >= n THEN 'contradiction' ELSE 'neutral' END AS label, round(ln(exp(e) + exp(c)) - n, 6) AS evidence, e - c AS polarity, round(1 / (1 + exp(-e)), 6) AS squashed FROM x""")
def inference_margins(spark, sf_dir):
    e, c, n = ((F.pmod("doc_id", F.lit(m)) - k).cast("double") for m, k in ((7, 3), (5, 2), (3, 1)))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", predicted_label(e, c, n).alias("label"), round_to(evidence_margin(e, c, n)).alias("evidence"), (polarity_margin(e, c) + F.lit(0.0)).alias("polarity"), round_to(logistic(e)).alias("squashed")
    )


@query("""SELECT event_type AS name, 'usd' AS unit, count(value) FILTER (user_id % 4 > 0) AS n_available, count(*) FILTER (user_id % 4 = 0) AS n_unavailable, round(sum(value) FILTER (user_id % 4 > 0), 2) AS total, round(min(value) FILTER (user_id % 4 > 0), 4) AS minimum,
 round(max(value) FILTER (user_id % 4 > 0), 4) AS maximum, count(*) FILTER (user_id % 2 = 0) AS locally_measured, count(*) FILTER (user_id % 2 = 1) AS provided FROM events GROUP BY 1""")
def telemetry_aggregate(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"), F.lit("usd").alias("unit"), "value", F.when(F.col("user_id") % 2 == 0, "locally-measured").otherwise("provided").alias("origin"), F.when(F.col("user_id") % 4 > 0, "available").otherwise("unavailable").alias("completeness")
    )
    return reports.telemetry_aggregate(e).withColumn("total", round_to(F.col("total"), 2))


@query("SELECT run_id, sum(m - 1)::BIGINT AS retries FROM (SELECT user_id AS run_id, event_type, greatest(1, max(event_id % 6)) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def telemetry_retries(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("revision"), F.pmod("event_id", F.lit(6)).alias("attempt"))
    return reports.telemetry_retries(e)


@query("""WITH e AS (SELECT vec_id AS id, vec_id // 8 AS g, label % 2 AS pol, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.id, a.g, a.pol, a.v AS s, b.v AS r, c.v AS o, d.v AS q FROM e a JOIN e b ON b.id = a.g * 8 + (a.id + 1) % 8 JOIN e c ON c.id = a.g * 8 + (a.id + 2) % 8 LEFT JOIN e d ON d.id = a.g * 8 + (a.id + 3) % 8),
x AS (SELECT c.g AS candidate_id, c.id AS ci, d.id AS di, CASE WHEN c.pol = d.pol THEN 1.0::DOUBLE ELSE -1.0 END AS polarity,
 (list_cosine_similarity(c.s, d.s) + 1) / 2 AS ss, (list_cosine_similarity(c.s, d.o) + 1) / 2 AS so, (list_cosine_similarity(c.o, d.s) + 1) / 2 AS os, (list_cosine_similarity(c.o, d.o) + 1) / 2 AS oo,
 (list_cosine_similarity(c.r, d.r) + 1) / 2 AS predicate, CASE WHEN c.q IS NULL OR d.q IS NULL THEN 0.0 ELSE (list_cosine_similarity(c.q, d.q) + 1) / 2 END AS qualifier FROM p c JOIN p d ON c.g = d.g AND c.id % 2 = 0 AND d.id % 2 = 1),
y AS (SELECT *, greatest(ss, so, os, oo) AS entity, (ss + oo - so - os) / 2 AS direction FROM x),
z AS (SELECT *, (entity + predicate + (direction + 1) / 2 + (polarity + 1) / 2 + qualifier) / 5 AS pair_mean, row_number() OVER (PARTITION BY candidate_id ORDER BY round((entity + predicate + (direction + 1) / 2) / 3, 9) DESC, ci::VARCHAR, di::VARCHAR) AS i FROM y)
SELECT candidate_id, ci::VARCHAR AS claim_proposition, di::VARCHAR AS document_proposition, round(entity, 6) AS entity, round(predicate, 6) AS predicate, round(direction, 6) AS direction, polarity, round(qualifier, 6) AS qualifier, round(pair_mean, 6) AS pair_mean FROM z WHERE i = 1""")
def proposition_pairs(spark, sf_dir):
    """Best pairs of propositions over vectors as surfaces, one candidate a label and eight-vector group."""
    e = views.table(spark, sf_dir, "embeddings")
    vectors = e.select(F.col("vec_id").cast("string").alias("surface"), "embedding")
    group = F.floor(F.col("vec_id") / 8)
    s = lambda k: (group * 8 + F.pmod(F.col("vec_id") + k, F.lit(8))).cast("string")
    props = e.select(
        group.alias("candidate_id"), F.col("vec_id").cast("string").alias("proposition_id"), s(0).alias("subject"), s(1).alias("predicate"), s(2).alias("object"), (F.col("label") % 2 == 0).cast("string").alias("polarity"),
        F.array(F.struct(F.lit("time").alias("role"), s(3).alias("text"))).alias("qualifiers"), (F.col("vec_id") % 2 == 0).alias("claim"),
    )
    known = vectors.select("surface")
    for part in ("subject", "predicate", "object"):
        props = props.join(known.withColumnRenamed("surface", part), part, "left_semi")
    return propositions.pair_features(props.filter("claim"), props.filter("NOT claim"), vectors)
