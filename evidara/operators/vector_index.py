"""A stored vector index with exact pruning: cells of vectors around centroids, skipped by the triangle inequality.

Vectors are compared at length 1, where the cosine is 1 - d^2 / 2 of their
distance d.  No vector of a cell is nearer to a query than the centroid's
distance less the cell's radius.  Each query first searches the cells nearest to
it for a score that its k-th document reaches at least, and then every cell that
may hold a better one; cells are folders, so the others are never read.  The
centroids come from a bounded sample, which decides how much is skipped but not
what is found.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators import dense
from evidara.operators.checks import ContractError
from evidara.operators.dense import QUERY_BLOCK, _unit
from evidara.operators.lexical import top_k
from evidara.sources.snapshots import Snapshots

#: Vectors from which centroids are fitted, and the most cells there may be.
FIT_VECTORS, MOST_CELLS = 8192, 1024
FIT_ROUNDS = 8
#: For a query's first pass: chunks in its nearest cells, as a multiple of k.
FIRST_CHUNKS = 4
#: Scores are compared at six digits; distances are roots of differences.
SLACK, ROOT_SLACK = 1e-5, 1e-6
#: Tasks that may write one cell, however many rows it has.
CELL_SPREAD = 8


def fitted_centroids(vectors: np.ndarray, cells: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids of unit vectors: evenly spread rows of the sample, moved to the mean of what is nearest."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, min(cells, len(vectors))).astype(int)].copy()
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-300), centroids)
    return np.unique(centroids.round(12), axis=0)


class VectorIndex:
    """Chunks (doc_id, representation, ordinal, embedding) stored by cell in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Snapshots(spark, folder)

    def build(self, chunks: DataFrame, cells: int | None = None) -> int:
        """Store all chunks that have a vector other than zero, as a new version.

        Without ``cells`` there are about as many as the square root of the
        number of chunks.  All vectors must have one length.
        """
        base = self.store.version()
        usable = chunks.filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("doc_id", "representation", "ordinal", "embedding")
        size = usable.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
        if not size["n"]:
            return self.store.commit(base, {"n": 0})
        if size["least"] != size["most"]:
            raise ContractError("vectors of different lengths")
        sample = usable.withColumn("h", F.xxhash64("doc_id", "representation", "ordinal")).orderBy("h", "doc_id", "representation", "ordinal").select("embedding").limit(FIT_VECTORS)
        centroids = fitted_centroids(_unit(sample.toArrow().column(0).to_pylist()), cells or int(min(MOST_CELLS, max(1, size["n"] ** 0.5))))
        kinds = dict(usable.dtypes)

        def assign(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                e = _unit(batch.column(3).to_pylist())
                cell = (e @ centroids.T).argmax(axis=1)
                away = np.linalg.norm(e - centroids[cell], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(cell, pa.int32())], [*batch.schema.names, "away", "cell"])

        schema = ", ".join(f"`{c}` {kinds[c]}" for c in usable.columns) + ", away double, cell int"
        placed = usable.mapInArrow(assign, schema).repartition("cell", F.pmod(F.xxhash64("doc_id", "ordinal"), F.lit(CELL_SPREAD)))
        path = self.store.write("cells", placed.sortWithinPartitions("cell", "doc_id"), "cell")
        stats = self.store.read(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()  # at most MOST_CELLS
        rows = [(int(r["cell"]), int(r["n"]), float(r["radius"]), centroids[r["cell"]].tolist()) for r in stats]
        about = self.store.write("about", self.spark.createDataFrame(rows, "cell int, n long, radius double, centroid array<double>").coalesce(1))
        return self.store.commit(base, {"n": size["n"], "cells": path, "about": about})

    def _plan(self, queries: DataFrame, k: int, representations: list[str] | None):
        """For each block of queries: (ids, vectors, cells, their sizes, which query needs which cell)."""
        state = self.store.manifest()
        asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
        if not state.get("n"):
            return
        about = sorted(self.store.read(state["about"]).collect())  # at most MOST_CELLS
        cells, sizes = np.array([r["cell"] for r in about]), np.array([r["n"] for r in about])
        radius, centroids = np.array([r["radius"] for r in about]), np.array([r["centroid"] for r in about])
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        for i in range(blocks):
            block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()  # about QUERY_BLOCK rows
            ids, vectors = block.column(0).combine_chunks(), _unit(block.column(1).to_pylist() or np.zeros((0, centroids.shape[1])))
            away = np.sqrt(np.maximum(0, (vectors**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * vectors @ centroids.T))
            order = np.argsort(away, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = np.zeros(away.shape, bool)
            np.put_along_axis(first, order, before < FIRST_CHUNKS * k, axis=1)
            some = vectors.any(axis=1)
            first[~some] = False
            found = self._met(ids, vectors, cells, first, k, representations, state)
            reached = dict(found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")).collect())  # a row a query of the block
            least = np.array([v if (v := reached.get(x)) is not None else -np.inf for x in ids.to_pylist()])
            nearest = np.maximum(0, away - radius - ROOT_SLACK)
            need = (1 - nearest**2 / 2 >= least[:, None] - SLACK) & some[:, None]
            yield ids, vectors, cells, sizes, need, state

    def _met(self, ids, vectors, cells, need, k, representations, state) -> DataFrame:
        """The k best documents of each query among the cells that it needs."""
        wanted = [int(c) for c in cells[need.any(axis=0)]]
        rows = self.store.read(state["cells"]).filter(F.col("cell").isin(wanted))
        if representations is not None:
            rows = rows.filter(F.col("representation").isin(representations))
        rows = rows.select("doc_id", "representation", "ordinal", "embedding", "cell")
        place = {int(c): i for i, c in enumerate(cells)}

        def meet(batches):
            for batch in batches:
                step = max(1, dense.MATRIX_CELLS // max(1, len(vectors)))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    e, own = _unit(part.column(3).to_pylist()), part.column(4).to_numpy()
                    scores = np.full((len(e), len(vectors)), -np.inf)
                    for cell in np.unique(own):
                        at_rows, at_queries = np.flatnonzero(own == cell), np.flatnonzero(need[:, place[int(cell)]])
                        scores[np.ix_(at_rows, at_queries)] = np.clip(np.round(e[at_rows] @ vectors[at_queries].T, 6), -1.0, 1.0) + 0.0
                    yield dense.found_rows(ids, part, *dense.reduced(part.column(0), part.column(1), part.column(2), scores, k))

        kinds = dict(rows.dtypes) | {"query_id": {"int64": "bigint", "int32": "int", "string": "string"}[str(ids.type)]}
        return top_k(dense.best_of(rows.mapInArrow(meet, dense.found_schema(kinds))), k)

    def search(self, queries: DataFrame, k: int, representations: list[str] | None = None) -> DataFrame:
        """The k nearest documents of each query (query_id, embedding), by their nearest chunk; equal to a search of all chunks."""
        out = [self._met(ids, vectors, cells, need, k, representations, state) for ids, vectors, cells, _, need, state in self._plan(queries, k, representations)]
        if not out:
            return top_k(queries.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("representation"), F.lit(0).alias("ordinal"), F.lit(0.0).alias("score")).limit(0), k)
        return reduce(DataFrame.unionByName, out)

    def work(self, queries: DataFrame, k: int, representations: list[str] | None = None) -> DataFrame:
        """(query_id, chunks, chunks_met): how many of the stored chunks each query meets."""
        kind = dict(queries.dtypes)["query_id"]
        rows = []
        for ids, _, _, sizes, need, state in self._plan(queries, k, representations):
            rows += [(q, int(state["n"]), int(n)) for q, n in zip(ids.to_pylist(), need @ sizes, strict=True)]
        return self.spark.createDataFrame(rows, f"query_id {kind}, chunks long, chunks_met long")
