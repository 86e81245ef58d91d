"""Registered queries: search, fusion, metrics, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions.numeric import finite, round_to
from evidara.operators import chunking, dense, fusion, late_interaction, lexical, metrics
from evidara.operators.checks import kept
from evidara.plans import views
from evidara.operators.index import LexicalIndex
from evidara.operators.vector_index import VectorIndex
from evidara.plans.engine import Engine
from evidara.plans.strategies import CATALOGUE, DEFAULT, dependencies
from evidara.plans.views import BM25, DOCS, KEYWORD, POOL, QRELS, SIMS, TOP, WORDS, query, scratch, top


def _lists(spark, sf_dir, depth=POOL, weights=None):
    docs, asked = views.documents(spark, sf_dir), views.queries(spark, sf_dir)
    return fusion.lists({"bm25": lexical.bm25_search(asked, docs, depth, weights=weights), "keyword": lexical.keyword_search(asked, docs, depth)})


_LISTS = f"""WITH {BM25}, {KEYWORD}, {top('bm25', POOL, 'bm25_50')}, {top('keyword', POOL, 'keyword_50')},
lists AS (SELECT query_id, doc_id, rank, score, 0 AS list, 'bm25' AS channel FROM bm25_50 WHERE score > 0 UNION ALL SELECT query_id, doc_id, rank, score, 1, 'keyword' FROM keyword_50 WHERE score > 0)"""


@query(f"WITH {BM25}, {top('bm25')} SELECT query_id, doc_id, score, rank FROM ranked WHERE score > 0")
def bm25_topk(spark, sf_dir):
    return lexical.bm25_search(views.queries(spark, sf_dir), views.documents(spark, sf_dir), TOP).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {BM25}, {top('bm25')} SELECT query_id, doc_id, score, rank FROM ranked WHERE score > 0")
def bm25_indexed_topk(spark, sf_dir):
    """Top k from a stored index: built with other texts for a third of the documents, which a second batch corrects."""
    docs = views.documents(spark, sf_dir)
    stored = LexicalIndex(spark, scratch(spark))
    stored.refresh(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("replaced "), F.col("title"))).otherwise(F.col("text"))))
    stored.refresh(docs)
    return stored.search(views.queries(spark, sf_dir), TOP).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {BM25}, {KEYWORD}, {top('keyword')} SELECT query_id, doc_id, score, rank FROM ranked WHERE score > 0")
def keyword_topk(spark, sf_dir):
    return lexical.keyword_search(views.queries(spark, sf_dir), views.documents(spark, sf_dir), TOP).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {BM25}, {KEYWORD}, {top('keyword', POOL)} SELECT r.query_id, r.doc_id, coalesce(b.score, 0.0) AS score FROM ranked r LEFT JOIN bm25 b USING (query_id, doc_id) WHERE r.score > 0")
def bm25_pool_rescore(spark, sf_dir):
    docs, asked = views.documents(spark, sf_dir), views.queries(spark, sf_dir)
    return lexical.bm25_rescore(asked, docs, kept(lexical.keyword_search(asked, docs, POOL).select("query_id", "doc_id")))


@query(f"WITH {DOCS} SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, {WORDS.format('title || chr(10) || text')} AS w FROM docs)) GROUP BY 1, 2")
def postings(spark, sf_dir):
    return lexical.postings(views.documents(spark, sf_dir)).select("doc_id", "term", "tf", "dl")


@query(f"WITH {SIMS}, docs AS (SELECT query_id, doc_id, max(score) AS score FROM sims GROUP BY 1, 2), {top('docs')} SELECT query_id, doc_id, score, rank FROM ranked")
def vector_topk(spark, sf_dir):
    return dense.vector_search(views.vector_queries(spark, sf_dir), views.chunks(spark, sf_dir), TOP).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {SIMS}, docs AS (SELECT query_id, doc_id, max(score) AS score FROM sims GROUP BY 1, 2), {top('docs')} SELECT query_id, doc_id, score, rank FROM ranked")
def vector_pruned_topk(spark, sf_dir):
    """The nearest documents from a stored index, of which only cells that may hold one are read."""
    stored = VectorIndex(spark, scratch(spark))
    stored.build(views.chunks(spark, sf_dir))
    return stored.search(views.vector_queries(spark, sf_dir), TOP).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {SIMS} SELECT query_id, doc_id, representation, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, representation, ordinal) AS r FROM sims) WHERE r = 1")
def vector_best_chunk(spark, sf_dir):
    return dense.best_chunks(views.vector_queries(spark, sf_dir), views.chunks(spark, sf_dir))


# The stand-in model of token vectors: 32 bytes of hash of each character trigram, summed and set to length 1.
_WORD_VECTORS = """grams AS (SELECT word, sha256(substr('^' || word || '$', i, 3)) AS h FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
bytes AS (SELECT word, d, sum(('0x' || substr(h, 2 * d + 1, 2))::INT - 127.5) AS v FROM grams, range(0, 32) t(d) GROUP BY 1, 2),
vectors AS (SELECT word, list(v / n ORDER BY d)::DOUBLE[32] AS v FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY word)) AS n FROM bytes) GROUP BY 1)"""


def _maxsim(whole: str) -> str:
    return f"""WITH {BM25}, {KEYWORD}, {top('keyword')}, pool AS (SELECT query_id, doc_id FROM ranked WHERE score > 0),
views AS (SELECT doc_id, {WORDS.format(whole)} AS w FROM docs WHERE doc_id IN (SELECT doc_id FROM pool)),
dw AS (SELECT DISTINCT doc_id, unnest(w) AS word FROM views), words AS (SELECT word FROM dw UNION SELECT term FROM terms), {_WORD_VECTORS},
best AS (SELECT p.query_id, p.doc_id, term, max(array_inner_product(a.v, b.v)) AS s FROM pool p JOIN terms USING (query_id) JOIN dw USING (doc_id) JOIN vectors a ON a.word = term JOIN vectors b ON b.word = dw.word GROUP BY 1, 2, 3)
SELECT query_id, doc_id, round(sum(s), 6) AS score FROM best GROUP BY 1, 2"""


@query(_maxsim("title || chr(10) || text"))
def maxsim_rescore(spark, sf_dir):
    """Late interaction of every item with the documents that a keyword search gives it; each document's words become vectors once."""
    docs, asked = views.documents(spark, sf_dir), views.queries(spark, sf_dir)
    pool = kept(lexical.keyword_search(asked, docs, TOP))
    whole = docs.select("doc_id", F.lit(0).alias("ordinal"), F.concat_ws("\n", "title", "text").alias("text"))
    return late_interaction.late_interaction_scores(asked, whole, pool).select("query_id", "doc_id", "score")


@query(_maxsim("text"))
def maxsim_stored_rescore(spark, sf_dir):
    """The same over the bodies, from a stored relation of token vectors."""
    docs, asked = views.documents(spark, sf_dir), views.queries(spark, sf_dir)
    pool = kept(lexical.keyword_search(asked, docs, TOP).select("query_id", "doc_id"))
    path = scratch(spark)
    body = docs.select("doc_id", F.lit(0).alias("ordinal"), "text").join(pool.select("doc_id").distinct(), "doc_id", "left_semi")
    late_interaction.token_blocks(body).write.parquet(path)
    return late_interaction.stored_scores(asked, spark.read.parquet(path), pool).select("query_id", "doc_id", "score")


_POOL = f"WITH {SIMS}, docs AS (SELECT query_id, doc_id, max(score) AS score FROM sims GROUP BY 1, 2), {top('docs', POOL)}"


def _vector_pool(spark, sf_dir):
    return dense.vector_search(views.vector_queries(spark, sf_dir), views.chunks(spark, sf_dir), POOL)


@query(f"{_POOL} SELECT s.query_id, s.doc_id, max(s.score) AS score FROM sims s JOIN ranked r USING (query_id, doc_id) WHERE s.representation = 'even' GROUP BY 1, 2")
def vector_pool_rescore(spark, sf_dir):
    return dense.vector_rescore(views.vector_queries(spark, sf_dir), views.chunks(spark, sf_dir), _vector_pool(spark, sf_dir), ["even"])


@query(f"""{_LISTS}, fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2), {top('fused')} SELECT query_id, doc_id, score, rank FROM ranked""")
def rrf_fusion(spark, sf_dir):
    return fusion.reciprocal_rank_fusion(_lists(spark, sf_dir), TOP).select("query_id", "doc_id", "score", "rank")


@query(f"""{_LISTS}, firsts AS (SELECT query_id, doc_id, list, rank AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY list, rank) AS r FROM lists) WHERE r = 1),
scored AS (SELECT f.query_id, f.doc_id, coalesce(b.score, 0.0) AS score FROM firsts f LEFT JOIN bm25 b USING (query_id, doc_id)), {top('scored')} SELECT query_id, doc_id, score, rank FROM ranked""")
def union_rerank(spark, sf_dir):
    docs, asked = views.documents(spark, sf_dir), views.queries(spark, sf_dir)
    weights = lexical.corpus_weights(asked, docs)
    pool = kept(fusion.union_of_lists(_lists(spark, sf_dir, weights=weights)))
    return fusion.rerank(pool, lexical.bm25_rescore(asked, docs, pool, weights=weights), TOP).select("query_id", "doc_id", "score", "rank")


def _features(spark, sf_dir):
    docs, asked = views.documents(spark, sf_dir), views.queries(spark, sf_dir)
    weights = lexical.corpus_weights(asked, docs)
    pool = kept(fusion.pool(_lists(spark, sf_dir, weights=weights)))
    bm25 = lexical.bm25_rescore(asked, docs, pool, weights=weights).withColumn("channel", F.lit("bm25"))
    keyword = lexical.keyword_rescore(asked, docs, pool).withColumn("channel", F.lit("keyword"))
    return pool, bm25.unionByName(keyword)


_FEATURES = f"""{_LISTS}, pool AS (SELECT DISTINCT query_id, doc_id FROM lists),
raw AS (SELECT p.query_id, p.doc_id, 'bm25' AS channel, coalesce(b.score, 0.0) AS score FROM pool p LEFT JOIN bm25 b USING (query_id, doc_id)
  UNION ALL SELECT p.query_id, p.doc_id, 'keyword', coalesce(k.score, 0.0) FROM pool p LEFT JOIN keyword k USING (query_id, doc_id)),
features AS (SELECT *, rank() OVER (PARTITION BY query_id, channel ORDER BY score DESC) AS rank FROM raw)"""
_ROBUST = f"""{_FEATURES}, a AS (SELECT *, median(score) OVER (PARTITION BY query_id, channel) AS med, count(*) OVER (PARTITION BY query_id, channel) AS n, min(score) OVER (PARTITION BY query_id, channel) AS lo,
  max(score) OVER (PARTITION BY query_id, channel) AS hi, rank() OVER (PARTITION BY query_id, channel ORDER BY score) - 1 + (count(*) OVER (PARTITION BY query_id, channel, score) - 1) / 2.0 AS place FROM features),
b AS (SELECT *, median(abs(score - med)) OVER (PARTITION BY query_id, channel) AS mad FROM a),
robust AS (SELECT query_id, doc_id, channel, score, rank, round(CASE WHEN lo = hi THEN 0.5 WHEN mad = 0 THEN place / greatest(n - 1, 1) ELSE 1 / (1 + exp(-(0.6744897501960817 * (score - med) / mad))) END, 6) AS normalised FROM b)"""


@query(f"{_FEATURES} SELECT query_id, doc_id, channel, score, rank FROM features")
def competition_rank(spark, sf_dir):
    return fusion.feature_matrix(*_features(spark, sf_dir), ["bm25", "keyword"]).select("query_id", "doc_id", "channel", "score", "rank")


@query(f"{_LISTS} SELECT query_id, doc_id, string_agg(channel || ':' || rank, ' ' ORDER BY list, rank) AS signals FROM lists GROUP BY 1, 2")
def pool_signals(spark, sf_dir):
    said = F.transform("signals", lambda s: F.concat(s["channel"], F.lit(":"), s["rank"].cast("string")))
    return fusion.pool(_lists(spark, sf_dir)).select("query_id", "doc_id", F.array_join(said, " ").alias("signals"))


@query(f"{_FEATURES}, fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM features GROUP BY 1, 2), {top('fused')} SELECT query_id, doc_id, score, rank FROM ranked")
def pooled_rrf(spark, sf_dir):
    features = fusion.feature_matrix(*_features(spark, sf_dir), ["bm25", "keyword"])
    return fusion.rank_aggregation(features, TOP).select("query_id", "doc_id", "score", "rank")


@query(f"{_ROBUST} SELECT query_id, doc_id, channel, score, normalised FROM robust")
def robust_normalise(spark, sf_dir):
    features = fusion.feature_matrix(*_features(spark, sf_dir), ["bm25", "keyword"])
    return fusion.robust_normalised(features).select("query_id", "doc_id", "channel", "score", "normalised")


@query(f"{_ROBUST}, fused AS (SELECT query_id, doc_id, round(avg(normalised), 7) AS score FROM robust GROUP BY 1, 2), {top('fused')} SELECT query_id, doc_id, score, rank FROM ranked")
def pooled_robust_mean(spark, sf_dir):
    features = fusion.feature_matrix(*_features(spark, sf_dir), ["bm25", "keyword"])
    return fusion.equal_mean(fusion.robust_normalised(features), TOP, digits=7).select("query_id", "doc_id", "score", "rank")


@query(f"{_FEATURES}, fused AS (SELECT query_id, doc_id, round(avg(score), 7) AS score FROM features GROUP BY 1, 2), {top('fused')} SELECT query_id, doc_id, score, rank FROM ranked")
def pooled_raw_mean(spark, sf_dir):
    features = fusion.feature_matrix(*_features(spark, sf_dir), ["bm25", "keyword"])
    return fusion.equal_mean(fusion.identity_normalised(features), TOP, digits=7).select("query_id", "doc_id", "score", "rank")


_NDCG = """rel AS (SELECT query_id, doc_id, grade FROM qrels WHERE grade > 0), ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN pos <= 10 THEN (2.0 ** grade - 1) / log2(pos + 1) ELSE 0 END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS pos FROM rel) GROUP BY 1)"""


def _per(ranking: str, name: str = "per", hits: str = "hits", found: str = "found") -> str:
    return f"""{hits} AS (SELECT r.query_id, r.doc_id, r.rank, l.grade, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS nth FROM {ranking} r JOIN rel l USING (query_id, doc_id) WHERE r.rank <= 10),
{found} AS (SELECT query_id, sum((2.0 ** grade - 1) / log2(rank + 1)) AS dcg, sum(nth / rank) AS precisions, count(*) AS n, min(rank) AS first FROM {hits} GROUP BY 1),
{name} AS (SELECT q.query_id, coalesce(dcg / nullif(idcg, 0), 0.0) AS ndcg, coalesce(precisions / nullif(relevant, 0), 0.0) AS ap, coalesce(n / nullif(relevant, 0), 0.0) AS recall, coalesce(n / 10.0, 0.0) AS prec, coalesce(1.0 / first, 0.0) AS rr
  FROM (SELECT DISTINCT query_id FROM qrels) q LEFT JOIN ideal USING (query_id) LEFT JOIN {found} USING (query_id))"""


@query(f"WITH {BM25}, {top('bm25')}, {QRELS}, {_NDCG}, {_per('ranked')} SELECT count(*) AS queries, 10 AS cutoff, round(avg(ndcg), 6) AS ndcg, round(avg(ap), 6) AS map, round(avg(recall), 6) AS recall, round(avg(prec), 6) AS precision, round(avg(rr), 6) AS mrr FROM per")
def retrieval_metrics(spark, sf_dir):
    ranking = lexical.bm25_search(views.queries(spark, sf_dir), views.documents(spark, sf_dir), TOP)
    return metrics.ranking_metrics(views.qrels(spark, sf_dir), ranking, TOP)


@query(f"""WITH {BM25}, {KEYWORD}, {top('bm25', TOP, 'ra')}, {top('keyword', TOP, 'rb')}, {QRELS}, {_NDCG}, {_per('ra', 'pa', 'ha', 'fa')}, {_per('rb', 'pb', 'hb', 'fb')},
ta AS (SELECT query_id, doc_id FROM ra WHERE rank = 1), tb AS (SELECT query_id, doc_id FROM rb WHERE rank = 1)
SELECT pa.query_id, (SELECT count(*) FROM hb h WHERE h.query_id = pa.query_id AND h.doc_id NOT IN (SELECT doc_id FROM ha WHERE ha.query_id = pa.query_id)) AS n_gained,
  (SELECT count(*) FROM ha h WHERE h.query_id = pa.query_id AND h.doc_id NOT IN (SELECT doc_id FROM hb WHERE hb.query_id = pa.query_id)) AS n_lost,
  ta.doc_id IS DISTINCT FROM tb.doc_id AS top_changed, round(pb.ndcg - pa.ndcg, 6) + 0.0 AS ndcg_delta, CASE WHEN abs(pb.ndcg - pa.ndcg) <= 1e-12 THEN 'tie' WHEN pb.ndcg > pa.ndcg THEN 'win' ELSE 'loss' END AS outcome
FROM pa JOIN pb USING (query_id) LEFT JOIN ta USING (query_id) LEFT JOIN tb USING (query_id)""")
def strategy_transitions(spark, sf_dir):
    docs, asked = views.documents(spark, sf_dir), views.queries(spark, sf_dir)
    out = metrics.transitions(views.qrels(spark, sf_dir), lexical.bm25_search(asked, docs, TOP), lexical.keyword_search(asked, docs, TOP), TOP)
    return out.select("query_id", F.size("gained").alias("n_gained"), F.size("lost").alias("n_lost"), "top_changed", "ndcg_delta", "outcome")


@query(f"""WITH {BM25}, {KEYWORD}, {top('bm25', TOP, 'ra')}, {top('keyword', TOP, 'rb')}, {QRELS}, {_NDCG},
rec AS (SELECT 'bm25' AS strategy, item_id AS query_id, (item_id * 7 % 13)::DOUBLE AS latency_ms, item_id % 9 = 8 AS failed FROM benchmark WHERE item_id % 11 <> 10
  UNION ALL SELECT 'keyword', item_id, (item_id * 5 % 17)::DOUBLE, item_id % 9 = 8 FROM benchmark WHERE item_id % 11 <> 10),
planned AS (SELECT s AS strategy, item_id AS query_id FROM benchmark, (VALUES ('bm25'), ('keyword')) t(s)),
ga AS (SELECT ra.* FROM ra JOIN rec ON rec.strategy = 'bm25' AND rec.query_id = ra.query_id AND NOT failed), gb AS (SELECT rb.* FROM rb JOIN rec ON rec.strategy = 'keyword' AND rec.query_id = rb.query_id AND NOT failed),
{_per('ga', 'pa', 'ha', 'fa')}, {_per('gb', 'pb', 'hb', 'fb')}, means AS (SELECT 'bm25' AS strategy, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall FROM pa UNION ALL SELECT 'keyword', round(avg(ndcg), 6), round(avg(recall), 6) FROM pb)
SELECT strategy, count(*) AS planned, count(failed) AS completed, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed, round(avg(latency_ms), 4) AS mean_latency, round(median(latency_ms), 4) AS median_latency, any_value(ndcg) AS ndcg, any_value(recall) AS recall
FROM planned LEFT JOIN rec USING (strategy, query_id) JOIN means USING (strategy) GROUP BY strategy""")
def strategy_summary(spark, sf_dir):
    """Runs of two strategies, some of them missing or failed by a rule on their id."""
    docs, asked = views.documents(spark, sf_dir), views.queries(spark, sf_dir)
    ran = {"bm25": (lexical.bm25_search(asked, docs, TOP), 7, 13), "keyword": (lexical.keyword_search(asked, docs, TOP), 5, 17)}
    records, planned = None, None
    for name, (ranking, a, m) in ran.items():
        hits = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("h"))
        own = asked.select("query_id").filter("query_id % 11 <> 10").join(hits, "query_id", "left").select(
            F.lit(name).alias("strategy"), "query_id", (F.col("query_id") * a % m).cast("double").alias("latency_ms"), (F.col("query_id") % 9 == 8).alias("failed"),
            F.coalesce(F.transform("h", lambda x: x["doc_id"]), F.array().cast("array<bigint>")).alias("hits"),
        )
        plan = asked.select(F.lit(name).alias("strategy"), "query_id")
        records, planned = (own, plan) if records is None else (records.unionByName(own), planned.unionByName(plan))
    out = metrics.strategy_summary(records, planned, views.qrels(spark, sf_dir), TOP)
    return out.select("strategy", "planned", "completed", "succeeded", "failed", "mean_latency", "median_latency", "ndcg", "recall")


@query(f"""{_LISTS}, {QRELS}, {_NDCG}, held AS (SELECT DISTINCT query_id, doc_id, channel FROM lists UNION SELECT DISTINCT query_id, doc_id, '*' FROM lists),
g AS (SELECT h.query_id, h.channel, h.doc_id, r.grade, row_number() OVER (PARTITION BY h.query_id, h.channel ORDER BY coalesce(r.grade, 0) DESC, h.doc_id) AS pos FROM held h LEFT JOIN rel r USING (query_id, doc_id)),
f AS (SELECT query_id, channel, count(*) AS size, count(grade) AS hits, sum(CASE WHEN pos <= 10 THEN (2.0 ** coalesce(grade, 0) - 1) / log2(pos + 1) ELSE 0 END) AS dcg FROM g GROUP BY 1, 2)
SELECT c.channel, round(avg(coalesce(size, 0)), 6) AS mean_size, round(avg(coalesce(hits / nullif(relevant, 0), 0)), 6) AS recall, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(dcg / nullif(idcg, 0), 0)), 6) AS oracle_ndcg
FROM (SELECT DISTINCT query_id FROM qrels) q CROSS JOIN (SELECT DISTINCT channel FROM held) c LEFT JOIN f ON f.query_id = q.query_id AND f.channel = c.channel LEFT JOIN ideal i ON i.query_id = q.query_id GROUP BY 1""")
def candidate_diagnostics(spark, sf_dir):
    return fusion.pool_diagnostics(_lists(spark, sf_dir), views.qrels(spark, sf_dir), TOP)


@query(f"WITH {DOCS} SELECT doc_id, 'title' AS representation, 0 AS ordinal, title AS text FROM docs WHERE length(title) > 0")
def title_chunks(spark, sf_dir):
    return chunking.title_chunks(views.documents(spark, sf_dir))


@query(f"""WITH {DOCS}, w AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}0-9]+') AS w FROM docs), n AS (SELECT *, len(w) AS n FROM w),
s AS (SELECT *, unnest(CASE WHEN n <= 126 THEN [0] ELSE generate_series(0, (ceil((n - 126) / 94.0) * 94)::INT, 94) END) AS start FROM n)
SELECT doc_id, 'token-window' AS representation, start // 94 AS ordinal, CASE WHEN n = 0 THEN text ELSE array_to_string(w[start + 1:start + 126], ' ') END AS text FROM s""")
def token_windows(spark, sf_dir):
    return chunking.token_windows(views.documents(spark, sf_dir))


@query()
def decoded_windows(spark, sf_dir):
    """Windows bounded by a count over their decoded text; SQL has no such count, so a test holds them against a linear search."""
    return chunking.decoded_windows(views.documents(spark, sf_dir), most=1024, overlap=32)


@query(r"""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+$') AS p FROM documents), e AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM p),
f AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, regexp_replace(piece, '^\s+', '') AS led FROM e),
g AS (SELECT doc_id, i, base + length(piece) - length(led) AS start, regexp_replace(led, '\s+$', '') AS text FROM f)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, start::BIGINT AS start, (start + length(text))::BIGINT AS "end", text FROM g WHERE length(text) > 0""")
def sentence_spans(spark, sf_dir):
    return chunking.sentence_spans(views.table(spark, sf_dir, "documents"))


@query()
def greedy_sentence_pack(spark, sf_dir):
    return chunking.sentence_packs(views.documents(spark, sf_dir))


@query()
def coref_aware_pack(spark, sf_dir):
    return chunking.sentence_packs(views.documents(spark, sf_dir), aware=True)


@query()
def interval_dp_pack(spark, sf_dir):
    return chunking.interval_packs(views.documents(spark, sf_dir))


@query()
def nominal_dp_profiles(spark, sf_dir):
    return chunking.nominal_profiles(views.documents(spark, sf_dir))


@query()
def coref_sentences(spark, sf_dir):
    return chunking.coreference_sentences(views.documents(spark, sf_dir), None)


@query()
def default_strategy_search(spark, sf_dir):
    """The default strategy for all benchmark items over all documents."""
    return Engine(views.documents(spark, sf_dir)).search(views.queries(spark, sf_dir), DEFAULT, TOP).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {views.BM25}, {views.top("bm25", 5)}, h AS (SELECT query_id, doc_id, text FROM ranked JOIN docs USING (doc_id) WHERE rank = 1 AND score > 0),
a AS (SELECT query_id, doc_id, regexp_replace(regexp_extract(text, '^[^.!?\\n]+[.!?]?'), '^\\s+|\\s+$', '', 'g') AS said, regexp_extract(text, '^[^.!?\\n]+[.!?]?') <> '' AS told FROM h)
SELECT item_id AS query_id, CASE WHEN told THEN said || ' [' || doc_id || ']' ELSE 'insufficient evidence' END AS answer, CASE WHEN told THEN doc_id::VARCHAR ELSE '' END AS citations, true AS valid FROM benchmark LEFT JOIN a ON query_id = item_id""")
def ask_bm25(spark, sf_dir):
    out = Engine(views.documents(spark, sf_dir)).ask(views.queries(spark, sf_dir), "bm25", 5)
    return out.select("query_id", F.col("final").alias("answer"), F.array_join("citations", ",").alias("citations"), "valid")


# Every strategy with its kind and the services it needs, as the catalogue must give them.
@query("""SELECT * FROM (VALUES ('bm25', 'list', 'store'),
 ('bm25-coref-aware-pack-rrf', 'rrf', 'coreference,embedder,store'),
 ('bm25-coref-interval-pack-rrf', 'rrf', 'coreference,embedder,store'),
 ('bm25-coref-max-rrf', 'rrf', 'coreference,embedder,store'),
 ('bm25-coref-nominal-rrf', 'rrf', 'coreference,embedder,store'),
 ('bm25-coref-propn-rrf', 'rrf', 'coreference,embedder,store'),
 ('bm25-sentence-pack-rrf', 'rrf', 'embedder,store'),
 ('bm25-token-window-rrf', 'rrf', 'embedder,store'),
 ('coref-aware-pack', 'list', 'coreference,embedder,store'),
 ('coref-interval-pack', 'list', 'coreference,embedder,store'),
 ('coref-max', 'list', 'coreference,embedder,store'),
 ('coref-nominal', 'list', 'coreference,embedder,store'),
 ('coref-propn', 'list', 'coreference,embedder,store'),
 ('hybrid-rrf', 'rrf', 'coreference,embedder,store'),
 ('keyword', 'list', 'store'),
 ('pooled-colbert', 'pool', 'colbert,coreference,embedder,store'),
 ('pooled-coref-aware-pack-rrf', 'pool', 'coreference,embedder,store'),
 ('pooled-coref-interval-colbert', 'pool', 'colbert,coreference,embedder,store'),
 ('pooled-coref-interval-content-max-colbert', 'pool', 'colbert,coreference,embedder,store'),
 ('pooled-coref-interval-msmarco', 'pool', 'coreference,embedder,msmarco,store'),
 ('pooled-coref-interval-multiview-colbert', 'pool', 'colbert,coreference,embedder,store'),
 ('pooled-coref-interval-pack-rrf', 'pool', 'coreference,embedder,store'),
 ('pooled-coref-interval-rankzephyr', 'pool', 'coreference,embedder,rankzephyr,store'),
 ('pooled-coref-interval-raw-mean-colbert', 'pool', 'colbert,coreference,embedder,store'),
 ('pooled-coref-nominal-dp-colbert', 'pool', 'colbert,coreference,embedder,store'),
 ('pooled-four-channel-robust-sum', 'pool', 'coreference,embedder,store'),
 ('pooled-four-channel-rrf', 'pool', 'coreference,embedder,store'),
 ('pooled-msmarco-rrf', 'pool', 'coreference,embedder,msmarco,store'),
 ('pooled-sentence-pack-rrf', 'pool', 'coreference,embedder,store'),
 ('rerank-msmarco', 'rerank', 'coreference,embedder,msmarco,store'),
 ('sentence-pack', 'list', 'embedder,store'),
 ('title-token-window-rrf', 'rrf', 'embedder,store'),
 ('token-window', 'list', 'embedder,store')) t(strategy, kind, services)""")
def capabilities(spark, sf_dir):
    """Strategies and the services that they need."""
    rows = [(n, s.kind, ",".join(sorted(dependencies(s)))) for n, s in sorted(CATALOGUE.items())]
    return spark.createDataFrame(rows, "strategy string, kind string, services string")


@query("SELECT count(*) AS n_rows, count(*) FILTER (l_extendedprice IS NULL OR NOT isfinite(l_extendedprice)) AS not_finite, round(max(l_extendedprice), 2) AS largest FROM lineitem")
def finite_check(spark, sf_dir):
    x = F.col("l_extendedprice")
    return views.table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~finite(x)).alias("not_finite"), round_to(F.max(x), 2).alias("largest"))
