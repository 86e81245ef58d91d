"""A stored inverted index: postings in blocks with their maxima, refreshed a batch at a time, searched with exact pruning.

A batch becomes a segment: blocks of postings, best first within a term, in
folders by a hash of the term; the lengths of its documents; the change of
every term's document frequency; and the ids whose earlier postings it voids.
A search reads the folders of its terms only and no text.  For each query a
first pass over every term's best block gives a score that the k-th document
reaches at least.  Terms that together stay below it cannot make a document by
themselves: candidates come from the lists of the other, essential terms, and
there from blocks whose best posting, with the best of all other terms of the
query, reaches that score.  All blocks of a document of the top k pass this
test, so its parts are complete; the remaining terms add theirs from blocks that
may hold a candidate.  Nothing that may be in the top k is ever left out.
Postings meet by document, once each however many queries ask for them, and
tasks score their own documents, so pairs of query and document are never shuffled.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidara.functions.numeric import round_to
from evidara.operators import lexical
from evidara.operators.checks import broadcast_if_small, kept, require_unique, small
from evidara.operators.lexical import B, K1
from evidara.sources.snapshots import Snapshots

BLOCK_POSTINGS = 256
#: Folders over which terms are dealt.
BUCKETS = 16
#: Levels of impact by which a term's postings are ordered.
LEVELS = 16
#: Slices of documents by a hash of their id; a block tells from which to which its documents are.
SLICES = 1024
#: Ids of voided documents that may be broadcast, so that postings stream past them.
MOST_VOIDED = 1 << 21
#: A bound may be below the score it bounds by rounding; scores are compared at six digits.
SLACK = 1e-5


def _saturation(tf: Column, dl: Column, avgdl: float | Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _whole() -> Column:
    """Title and text of a document, as lexical indexes see it."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))


def _digest() -> Column:
    return F.unhex(F.sha2(_whole().cast("binary"), 256)).alias("digest")


def _lengths(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, dl), counted in each document's row."""

    def count(batches):
        for batch in lexical.slices_of(batches, lexical.SLICE_ROWS):
            length = np.diff(lexical.word_lists(batch.column(2)).offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length)], ["doc_id", "digest", "dl"])

    return documents.select("doc_id", _digest(), _whole().alias("text")).mapInArrow(count, f"doc_id {dict(documents.dtypes)['doc_id']}, digest binary, dl long")


def _cut_blocks(batches):
    """Sorted postings (bucket, term, chunk, slice, doc_id, tf, dl) as a row for each run of one term and chunk."""

    def made(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        at = pa.array(starts)
        tf, dl, slices = (rows.column(c).to_numpy() for c in ("tf", "dl", "slice"))
        posting = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in ("doc_id", "tf", "dl")], ["doc_id", "tf", "dl"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, rows.num_rows), pa.int32()), posting)
        own = [rows.column(c).combine_chunks().take(at) for c in ("bucket", "term", "chunk")]
        told = [np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts), np.diff(np.append(starts, rows.num_rows)), np.minimum.reduceat(slices, starts), np.maximum.reduceat(slices, starts)]
        return pa.RecordBatch.from_arrays([*own, lists, *map(pa.array, told)], ["bucket", "term", "chunk", "postings", "max_tf", "min_dl", "n", "low", "high"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        term, chunk = rows.column("term").combine_chunks(), rows.column("chunk").to_numpy()
        new = (chunk[1:] != chunk[:-1]) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(new) + 1))
        if len(starts) > 1:
            yield made(rows.slice(0, starts[-1]).combine_chunks(), starts[:-1])
        held = rows.slice(starts[-1])  # it may go on in the next batch
    if held is not None:
        yield made(held.combine_chunks(), np.array([0]))


def _postings_in(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of (doc_id, slice, postings): row, term and part of every posting, and a factor of 1 for each row."""
    lists = batch.column(2)
    held = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, held.field("number").to_numpy(), held.field("part").to_numpy(), np.ones(len(lists))


class LexicalIndex:
    """BM25 over a stored index of documents (doc_id, title, text) in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, block: int = BLOCK_POSTINGS):
        self.spark, self.store = spark, Snapshots(spark, folder)
        self.buckets, self.block = self.store.manifest().get("buckets", buckets), block

    # -- writing ----------------------------------------------------------------

    def refresh(self, documents: DataFrame, removed: DataFrame | None = None) -> int:
        """Insert or update a batch of documents and drop the ids of ``removed``; returns the new version.

        Documents that are stored as they come stay untouched.  Only the batch is
        tokenised; of the stored postings those of superseded ids are counted.
        """
        base = self.store.version()
        state = self.store.manifest(base)
        require_unique(documents, "doc_id")
        segments = state.get("segments", [])
        if segments:
            stored = self._live_documents(state)
            # Texts stream past the ids that change; only ids and digests meet the stored ones.
            changed = kept(documents.select("doc_id", _digest()).join(stored.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti").select("doc_id"))
            incoming = documents.join(broadcast_if_small(changed, MOST_VOIDED), "doc_id", "left_semi")
            touched = changed if removed is None else changed.unionByName(removed.select("doc_id")).distinct()
            gone = kept(stored.join(touched, "doc_id", "left_semi").select("doc_id", "dl"))
            dropped = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            old = self._live_postings(state).join(broadcast_if_small(gone.select("doc_id"), MOST_VOIDED), "doc_id", "left_semi")
            minus = old.groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        else:
            incoming, gone, dropped, minus = documents, None, (0, 0), None
        # The batch's texts are dealt once, and stand beside the store until its segment does.
        batch = self.store.write("incoming", lexical.dealt(incoming.select("doc_id", "title", "text")))
        incoming = self.store.read(batch)
        segment = {"documents": self.store.write("documents", _lengths(incoming))}
        added = self.store.read(segment["documents"]).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        segment["gone"] = None if gone is None else self.store.write("gone", gone.select("doc_id"))
        self._write(segment, "blocks", self._blocks(lexical.postings(incoming, deal=False), added[1] / added[0] if added[1] else 1.0))
        plus = self._read(segment, "blocks").groupBy("term").agg(F.sum("n").alias("df"))
        self._write(segment, "terms", self._bucketed(plus if minus is None else plus.unionByName(minus)).repartition("bucket"))
        self.store.drop(batch)
        content = {"buckets": self.buckets, "segments": [*segments, segment], "n": state.get("n", 0) + added[0] - dropped[0], "dl": state.get("dl", 0) + added[1] - dropped[1]}
        return self.store.commit(base, content)

    def compact(self) -> int:
        """Rewrite the live postings of all segments as one; no text is read."""
        base = self.store.version()
        state = self.store.manifest(base)
        live = self._live_postings(state)
        avgdl = state["dl"] / state["n"] if state["dl"] else 1.0
        segment = {"documents": self.store.write("documents", self._live_documents(state).drop("segment")), "gone": None}
        self._write(segment, "terms", self._bucketed(live.groupBy("term").agg(F.count(F.lit(1)).alias("df"))).repartition("bucket"))
        self._write(segment, "blocks", self._blocks(live, avgdl))
        return self.store.commit(base, state | {"segments": [segment]})

    def _write(self, segment: dict, part: str, rows: DataFrame) -> None:
        """Rows in folders by bucket; with none there is no file to tell their schema, so the segment does."""
        segment[part] = self.store.write(part, rows, "bucket")
        segment.setdefault("schemas", {})[part] = rows.schema.json()

    def _read(self, segment: dict, part: str) -> DataFrame:
        told = segment.get("schemas", {}).get(part)
        return self.store.read(segment[part], told and StructType.fromJson(json.loads(told)))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))

    def _blocks(self, postings: DataFrame, avgdl: float) -> DataFrame:
        """Blocks of a term's postings, best first: dealt by ranges, so that one term may fill any number of tasks."""
        level = F.floor(_saturation(F.col("tf"), F.col("dl"), avgdl) * (LEVELS / (K1 + 1))).alias("level")
        order = ["bucket", "term", F.desc("level"), "slice", "doc_id"]
        rows = self._bucketed(postings.select("doc_id", "term", "tf", "dl", level, self._slice(F.col("doc_id")).alias("slice"))).repartitionByRange(*order).sortWithinPartitions(*order)
        cut = rows.withColumn("chunk", F.floor(F.monotonically_increasing_id() / self.block)).select("bucket", "term", "chunk", "slice", "doc_id", "tf", "dl")
        kinds = dict(cut.dtypes)
        held = ", ".join(f"{c}:{kinds[c]}" for c in ("doc_id", "tf", "dl"))
        schema = f"bucket int, term string, chunk long, postings array<struct<{held}>>, max_tf {kinds['tf']}, min_dl {kinds['dl']}, n long, low {kinds['slice']}, high {kinds['slice']}"
        # Rows of a block stand behind one another, so they become one where they are.
        return cut.mapInArrow(_cut_blocks, schema).sortWithinPartitions("bucket", "term", "chunk")

    # -- reading ------------------------------------------------------------------

    def _segments(self, state: dict, part: str) -> list[DataFrame]:
        return [self._read(s, part).withColumn("segment", F.lit(i)) for i, s in enumerate(state["segments"]) if s[part]]

    def _voided(self, state: dict) -> DataFrame | None:
        """(doc_id, until): the last segment that voids what earlier ones have of a document."""
        parts = self._segments(state, "gone")
        return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.max("segment").alias("until")) if parts else None

    def _alive(self, rows: DataFrame, voided: DataFrame | None) -> DataFrame:
        if voided is None:
            return rows
        return rows.join(voided, "doc_id", "left").filter("until IS NULL OR until <= segment").drop("until")

    def _live_documents(self, state: dict) -> DataFrame:
        return self._alive(reduce(DataFrame.unionByName, self._segments(state, "documents")), self._voided(state))

    def _live_postings(self, state: dict) -> DataFrame:
        blocks = reduce(DataFrame.unionByName, self._segments(state, "blocks"))
        rows = blocks.select("segment", "term", F.explode("postings").alias("p")).select("segment", "term", "p.doc_id", "p.tf", "p.dl")
        return self._alive(rows, self._voided(state)).drop("segment")

    def _weighted(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame | None, float] | None:
        """(weights, blocks, voided, mean length); None over an empty index.

        weights: query_id, term, idf, rest (the most that the query's other terms
        give), least (what the k-th document has at least, null if unknown) and
        essential: without one of those terms no document reaches ``least``.
        """
        state = self.store.manifest()
        if not state.get("n"):
            return None
        wanted = self._bucketed(lexical.query_terms(queries))
        buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most self.buckets
        own = lambda part: reduce(DataFrame.unionByName, self._segments(state, part)).filter(F.col("bucket").isin(buckets))
        avgdl = state["dl"] / state["n"] if state["dl"] else 1.0
        terms = broadcast_if_small(wanted.select("term").distinct())
        df = own("terms").join(terms, "term").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        idf = F.log(1.0 + (F.lit(float(state["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = _saturation(F.col("max_tf"), F.col("min_dl"), avgdl)
        best = own("blocks").join(terms, "term").groupBy("term").agg(F.max(F.struct(gain.alias("gain"), "segment", "chunk")).alias("best"))
        weights = df.select("term", idf.alias("idf")).join(best, "term").join(wanted.select("query_id", "term"), "term")
        weights = kept(weights.select("query_id", "term", "idf", F.col("best.segment").alias("s"), F.col("best.chunk").alias("c"), (F.col("idf") * F.col("best.gain")).alias("most")))
        voided = self._voided(state)
        voided = None if voided is None else broadcast_if_small(voided, MOST_VOIDED)
        blocks = own("blocks").withColumn("gain", gain)
        first = blocks.join(broadcast_if_small(weights), "term").filter((F.col("segment") == F.col("s")) & (F.col("chunk") == F.col("c")))
        seeds = self._sums(first, voided, avgdl)
        least = lexical.top_k(seeds, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        query = W.partitionBy("query_id")
        upto = F.sum("most").over(query.orderBy("most", "term").rowsBetween(W.unboundedPreceding, 0))
        planned = weights.join(least, "query_id", "left").select(
            "query_id", "term", "idf", "least", (F.sum("most").over(query) - F.col("most")).alias("rest"), (F.col("least").isNull() | (upto >= F.col("least") - SLACK)).alias("essential"), "most"
        )
        return kept(planned), blocks, voided, avgdl

    def _chosen(self, queries: DataFrame, k: int):
        """(essential blocks, the other terms' blocks, candidates, voided, mean length), with what each needs to be read for."""
        found = self._weighted(queries, k)
        if found is None:
            return None
        weights, blocks, voided, avgdl = found
        met = blocks.join(broadcast_if_small(weights), "term")
        enough = F.col("least").isNull() | (F.col("idf") * F.col("gain") + F.col("rest") >= F.col("least") - SLACK)
        leading = met.filter("essential").withColumn("read", enough)
        partial = self._sums(leading.filter("read"), voided, avgdl)
        others = weights.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))), F.lit(0.0)).alias("others"), F.max("least").alias("least"))
        able = F.col("least").isNull() | (F.col("score") + F.col("others") >= F.col("least") - SLACK)
        candidates = kept(partial.join(broadcast_if_small(others), "query_id").filter(able).select("query_id", "doc_id", "score"))
        slices = candidates.select("query_id", self._slice(F.col("doc_id")).alias("slice")).groupBy("query_id").agg(F.collect_set("slice").alias("slices"))
        holds = F.exists("slices", lambda x: x.between(F.col("low"), F.col("high")))
        rest = met.filter(~F.col("essential")).join(broadcast_if_small(slices), "query_id", "left").withColumn("read", F.coalesce(holds, F.lit(False)))
        return leading, rest, candidates, voided, avgdl

    @staticmethod
    def _slice(doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(SLICES))

    def _postings_of(self, blocks: DataFrame, voided: DataFrame | None, avgdl: float) -> DataFrame:
        """(query_id, doc_id, part) of every live posting of blocks that met a query's term."""
        rows = blocks.select("query_id", "segment", "idf", F.explode("postings").alias("p")).select("query_id", "segment", "idf", "p.doc_id", "p.tf", "p.dl")
        return self._alive(rows, voided).select("query_id", "doc_id", (F.col("idf") * _saturation(F.col("tf"), F.col("dl"), avgdl)).alias("part"))

    def _sums(self, blocks: DataFrame, voided: DataFrame | None, avgdl: float) -> DataFrame:
        return self._postings_of(blocks, voided, avgdl).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))

    def search(self, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """(query_id, doc_id, score, rank): the same as a BM25 search over the documents themselves."""
        if small(lexical.query_terms(queries), lexical.MOST_BROADCAST_TERMS):
            return self._search_by_document(queries, k, digits)
        chosen = self._chosen(queries, k)
        if chosen is None:
            return lexical.top_k(queries.select("query_id", F.lit(None).alias("doc_id"), F.lit(0.0).alias("score")).limit(0), k)
        _, rest, candidates, voided, avgdl = chosen
        completing = self._postings_of(rest.filter("read"), voided, avgdl).join(broadcast_if_small(candidates.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_semi")
        parts = candidates.withColumnRenamed("score", "part").unionByName(completing)
        scores = parts.groupBy("query_id", "doc_id").agg(round_to(F.sum("part"), digits).alias("score"))
        return lexical.top_k(scores, k).filter("score > 0")

    def _search_by_document(self, queries: DataFrame, k: int, digits: int) -> DataFrame:
        """``search`` where the query terms travel to every task."""
        found = self._weighted(queries, k)
        if found is None:
            return lexical.top_k(queries.select("query_id", F.lit(None).alias("doc_id"), F.lit(0.0).alias("score")).limit(0), k)
        weights, blocks, voided, avgdl = found
        pairs, kind = weights.filter("query_id IS NOT NULL").select("query_id", "term", "idf", "rest", "least", "essential", "most").toArrow(), dict(queries.dtypes)["query_id"]
        whole, leading = lexical.travelling(pairs, kind), lexical.travelling(pairs.filter(pairs.column("essential")), kind)
        idf = dict(zip(pairs.column("term").to_pylist(), pairs.column("idf").to_pylist(), strict=True))
        # A block is read once for all queries: if it may reach what the least demanding of them needs.
        need = F.coalesce((F.col("least") - SLACK - F.col("rest")) / F.col("idf"), F.lit(float("-inf")))
        needed = weights.filter("essential").groupBy("term").agg(F.min(need).alias("need"))
        first = blocks.join(F.broadcast(needed), "term").filter("gain >= need").drop("need")
        slices = self._reached(self._by_document(first, leading, idf, voided, avgdl), leading, pairs)
        rest = blocks.join(F.broadcast(slices), "term").filter(
            "exists(sequence(low div 64, high div 64), w -> (bits[cast(w AS INT)] & shiftleft(-1L, cast(greatest(low - 64 * w, 0) AS INT)) & shiftrightunsigned(-1L, cast(63 - least(high - 64 * w, 63) AS INT))) <> 0)"
        ).drop("bits")
        # Terms that are essential to some queries only are in both; such blocks count once.
        passed = rest.join(F.broadcast(needed), "term", "left").filter("need IS NULL OR gain < need").drop("need")
        rows = self._by_document(first.unionByName(passed), whole, idf, voided, avgdl)
        return lexical.best_scored(rows, whole, np.ones(len(whole.terms)), _postings_in, k, digits).filter("score > 0")

    def _by_document(self, blocks: DataFrame, asked: lexical.Asked, idf: dict[str, float], voided: DataFrame | None, avgdl: float) -> DataFrame:
        """(doc_id, slice, postings) with the number and the part of each wanted term, from the live postings of blocks."""
        terms = asked.terms.to_pylist()
        told = pa.table({"term": asked.terms, "number": pa.array(np.arange(len(terms)), pa.int32()), "idf": pa.array([idf[t] for t in terms], pa.float64())})
        numbered = blocks.join(F.broadcast(self.spark.createDataFrame(told)), "term")
        rows = numbered.select("segment", "number", "idf", F.explode("postings").alias("p")).select("segment", "number", "idf", "p.doc_id", "p.tf", "p.dl")
        part = F.col("idf") * _saturation(F.col("tf"), F.col("dl"), avgdl)
        live = self._alive(rows, voided).select("doc_id", F.struct("number", part.alias("part")).alias("p"))
        return live.groupBy("doc_id").agg(F.collect_list("p").alias("postings")).select("doc_id", self._slice(F.col("doc_id")).alias("slice"), "postings")

    def _reached(self, rows: DataFrame, asked: lexical.Asked, pairs: pa.Table) -> DataFrame:
        """(term, bits): in which slices the candidates of those queries are to which the term is not essential, a bit each.

        A candidate is a document that, with all that the other terms may give, reaches the query's ``least``.
        """
        at = {q: i for i, q in enumerate(asked.queries.to_pylist())}
        others, least = np.zeros(len(at)), np.full(len(at), -np.inf)
        told = [pairs.column(c).to_pylist() for c in ("query_id", "term", "essential", "most", "least")]
        for query, _, essential, most, low in zip(*told, strict=True):
            others[at[query]] += 0.0 if essential else most
            least[at[query]] = -np.inf if low is None else low

        def mark(batches):
            seen = np.zeros((len(at), SLICES), bool)
            for batch in lexical.slices_of(batches, lexical.scored_together(asked)):
                row, term, part, _ = _postings_in(batch)
                sums = lexical.score_sums(asked, row, term, part, batch.num_rows)
                doc, query = np.nonzero((sums > 0) & (sums + others >= least - SLACK))
                seen[query, batch.column(1).to_numpy()[doc]] = True
            query = np.flatnonzero(seen.any(axis=1))
            words = np.packbits(seen[query], axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(query), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(SLICES // 64))], names)

        names = ["query", *(f"b{i}" for i in range(SLICES // 64))]
        marked = rows.mapInArrow(mark, ", ".join(f"{n} long" for n in names)).groupBy("query").agg(*[F.bit_or(n).alias(n) for n in names[1:]]).toArrow()
        bits = np.zeros((len(at), SLICES // 64), np.int64)
        bits[marked.column("query").to_numpy()] = np.stack([marked.column(n).to_numpy() for n in names[1:]], axis=1)
        of_term: dict[str, np.ndarray] = {}
        for query, term, essential, _, _ in zip(*told, strict=True):
            if not essential:
                of_term[term] = of_term.get(term, 0) | bits[at[query]]
        held = pa.table({"term": pa.array(list(of_term), pa.string()), "bits": pa.array([b.tolist() for b in of_term.values()], pa.list_(pa.int64()))})
        return self.spark.createDataFrame(held)

    def work(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, blocks, blocks_read, postings, postings_read): how much of its terms' lists each query reads."""
        leading, rest, *_ = self._chosen(queries, k)
        blocks = leading.select("query_id", "n", "read").unionByName(rest.select("query_id", "n", "read"))
        return blocks.groupBy("query_id").agg(
            F.count(F.lit(1)).alias("blocks"), F.count_if("read").alias("blocks_read"), F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(F.col("read"), F.col("n"))), F.lit(0)).alias("postings_read")
        )
