"""The engine's relations as views of the given tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidara.functions.text import WORD, body_of, title_of
from evidara.operators.checks import broadcast_if_small, shared_folder, small
from evidara.operators.lexical import dealt, document_frequencies, met_terms, word_lists

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, tuple[Query, str | None]] = {}
TOP, POOL = 10, 50
#: Items that may travel to every task with their texts.
MOST_ITEMS = 20_000


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same result where there is one."""

    def add(f: Query) -> Query:
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Integers as long, so that both sides name the same types."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/evidara-{uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", title_of(text).alias("title"), body_of(text).alias("text"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is relevant to an item whose text it has, and more so with a good label.

    A document that has an item's text has all the item's inner words as words.
    So the documents meet each item's rarest inner word first, and only those
    are searched for the text; items without an inner word are few or none and meet all.  An item without a
    document stays as a query with a null document of grade 0.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    asked = queries(spark, sf_dir)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0)
    inner = asked.select("query_id", "text", F.when(F.size(words) > 2, F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))).alias("w"))
    if small(asked, MOST_ITEMS):
        hits = _holders(docs, inner)
    else:
        hits = _joined_holders(docs, inner)
    short = inner.filter("w IS NULL AND text IS NOT NULL").select("query_id", "text")
    if not short.isEmpty():
        hits = hits.union(docs.join(broadcast_if_small(short, 10_000), F.col("t").contains(F.col("text"))).select("query_id", "doc_id"))
    graded = hits.join(good, "doc_id", "left").select("query_id", "doc_id", (1 + F.coalesce("quality", F.lit(0))).cast("int").alias("grade"))
    return asked.select("query_id").join(graded, "query_id", "left").select("query_id", "doc_id", F.coalesce("grade", F.lit(0)).alias("grade"))


def _holders(docs: DataFrame, inner: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the documents with an item's text; the items travel, each under its rarest inner word."""
    items = [(r["query_id"], r["text"], r["w"]) for r in inner.filter("w IS NOT NULL").collect()]  # at most MOST_ITEMS
    docs = dealt(docs)
    terms = sorted({w for _, _, own in items for w in own})
    df = dict(zip(terms, document_frequencies(docs.select("t"), pa.array(terms, pa.string()), lower=False)[0].tolist(), strict=True))
    under: dict[str, list] = {}
    for query_id, text, own in items:
        under.setdefault(min(own, key=lambda w: (df[w], w)), []).append((query_id, text))
    rarest = pa.array(sorted(under), pa.string())
    asked = [under[w] for w in rarest.to_pylist()]
    kinds = dict(docs.dtypes)["doc_id"], dict(inner.dtypes)["query_id"]

    def find(batches):
        for batch in batches:
            rows, found, _, _ = met_terms(word_lists(batch.column(1), lower=False), rarest)
            texts = dict(zip(np.unique(rows).tolist(), batch.column(1).take(pa.array(np.unique(rows))).to_pylist(), strict=True))
            hits = [(q, r) for r, w in zip(rows.tolist(), found.tolist(), strict=True) for q, text in asked[w] if text in texts[r]]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in hits], query_type), batch.column(0).take(pa.array([r for _, r in hits], pa.int64()))], ["query_id", "doc_id"])

    query_type = to_arrow_type(inner.schema["query_id"].dataType)
    return docs.mapInArrow(find, f"query_id {kinds[1]}, doc_id {kinds[0]}")


def _joined_holders(docs: DataFrame, inner: DataFrame) -> DataFrame:
    """The same by joins, where the items are too many to travel."""
    tokens = broadcast_if_small(inner.select(F.explode("w").alias("word")).distinct())
    held = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(WORD), 0))).alias("word")).join(tokens, "word")
    frequency = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    each = inner.select("query_id", "text", F.explode("w").alias("word")).join(frequency, "word", "left")
    rarest = each.groupBy("query_id", "text").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("first")).filter("first.df > 0")
    rarest = broadcast_if_small(rarest.select("query_id", "text", F.col("first.word").alias("word")))
    spread = docs.select("doc_id", "t", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(WORD), 0))).alias("word"))
    return spread.join(rarest, "word").filter(F.col("t").contains(F.col("text"))).select("query_id", "doc_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors to a document, under two representations."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 4).alias("doc_id"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("representation"), F.pmod("vec_id", F.lit(4)).cast("int").alias("ordinal"), "embedding"
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


# --- The same views in SQL -----------------------------------------------------

DOCS = """docs AS (SELECT doc_id, CASE WHEN strpos(text, chr(10)) > 0 THEN trim(substr(text, 1, strpos(text, chr(10)) - 1)) ELSE '' END AS title,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}0-9]+')"
TERMS = f"terms AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark)"
BM25 = f"""{DOCS}, {TERMS},
ft AS (SELECT doc_id, {WORDS.format("title || chr(10) || text")} AS w FROM docs),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM ft),
post AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM ft) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
bm25 AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN dfs USING (term) JOIN terms USING (term), stats GROUP BY 1, 2)"""
KEYWORD = f"""kt AS (SELECT doc_id, len({WORDS.format('title')}) + len({WORDS.format('text')}) AS n, unnest({WORDS.format('title')}) AS term, 1.0::DOUBLE AS weight FROM docs
  UNION ALL SELECT doc_id, len({WORDS.format('title')}) + len({WORDS.format('text')}), unnest({WORDS.format('text')}), 0.4::DOUBLE FROM docs),
keyword AS (SELECT query_id, doc_id, round(sum(weight) / (1 + ln(n)), 6) AS score FROM kt JOIN terms USING (term) GROUP BY query_id, doc_id, n)"""
QRELS = """qrels AS (SELECT b.item_id AS query_id, d.doc_id, CASE WHEN d.doc_id IS NULL THEN 0 ELSE 1 + coalesce(l.quality, 0) END AS grade
  FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)"""
CHUNKS = "chunks AS (SELECT vec_id // 4 AS doc_id, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS representation, vec_id % 4 AS ordinal, embedding::DOUBLE[] AS e FROM embeddings)"
SIMS = f"""{CHUNKS}, vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
sims AS (SELECT query_id, doc_id, representation, ordinal, round(greatest(-1, least(1, list_cosine_similarity(e, q))), 6) AS score FROM chunks, vq)"""


def top(relation: str, k: int = TOP, name: str = "ranked") -> str:
    """A CTE of the k best of each query."""
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {relation}) WHERE rank <= {k})"
