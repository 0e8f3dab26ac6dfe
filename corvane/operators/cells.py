"""A stored index of vectors: cells of k-means, of which a search opens those nearest to the query and scores them exactly."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.vectors import PACK, best_of_products, nearest
from corvane.session import table
from corvane.storage import once, stored

#: The training sample has about so many vectors for each cell, of MOST_CELLS at most; every vector is indexed.
SAMPLE, MOST_CELLS, ROUNDS = 64, 4_096, 12
#: Queries, about, that the number of probes is measured with, and the recall that it is to reach.
MEASURED, RECALL = 200, 0.98


@dataclass
class CellIndex:
    """cells: cell, ids, dim, rows (packs of vectors of length 1); centroids; probes: how many cells a search opens; recall as measured."""

    cells: DataFrame
    centroids: np.ndarray
    probes: int
    recall: float


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids of length 1 of rows of length 1, by cosine; an empty cell is given the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        scores = rows @ centroids.T
        of, near = scores.argmax(1), scores.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, rows)
        empty = np.flatnonzero(np.bincount(of, minlength=len(centroids)) == 0)
        sums[empty] = rows[np.argsort(near)[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def _matrix(column) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))


def train(vectors: DataFrame, n: int, dim: int, cells: int) -> np.ndarray:
    """Centroids from a sample by a hash of vec_id, about SAMPLE vectors a cell, in one task."""

    def learn(batches):
        import pyarrow as pa

        parts = sorted(((i, v) for b in batches for i, v in zip(b.column("vec_id").to_pylist(), _matrix(b.column("v")), strict=True)), key=lambda x: x[0])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([k_means(np.stack([v for _, v in parts]), cells).tobytes()], pa.binary())], ["m"])

    rate = min(1.0, SAMPLE * cells / n)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    made = sample.repartition(1).mapInArrow(learn, "m binary").first()
    made = made or vectors.limit(cells).repartition(1).mapInArrow(learn, "m binary").first()  # a sample may be empty where there are few
    return np.frombuffer(bytes(made.m)).reshape(-1, dim)


def dealt(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """cell, vec_id, v: each vector (vec_id, v) in its nearest cells."""

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, PACK):
                some = batch.slice(a, PACK)
                scores = _matrix(some.column("v")) @ centroids.T
                m = min(probes, scores.shape[1])
                near = np.argpartition(-scores, m - 1, axis=1)[:, :m] if m < scores.shape[1] else np.tile(np.arange(m), (len(scores), 1))
                at = pa.array(np.repeat(np.arange(len(scores)), m))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), some.column("vec_id").take(at), some.column("v").take(at)], ["cell", "vec_id", "v"])

    return vectors.mapInArrow(deal, "cell int, vec_id long, v array<double>")


def packs(placed: DataFrame, ids: str, rows: str) -> DataFrame:
    """cell, ids, dim, rows: matrices of at most PACK vectors of one cell, so that a cell with very many is many rows."""

    def pack(batches):
        import pyarrow as pa

        cell, held_ids, held = None, [], []

        def out():
            m = _unit(np.array(held, float))
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([held_ids], pa.list_(pa.int64())), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["cell", ids, "dim", rows])

        for batch in batches:
            for c, i, v in zip(*(batch.column(x).to_pylist() for x in ("cell", "vec_id", "v")), strict=True):
                if held and (c != cell or len(held) == PACK):
                    yield out()
                    held_ids, held = [], []
                cell = c
                held_ids.append(i)
                held.append(v)
        if held:
            yield out()

    # ranges of (cell, vec_id): a cell with very many vectors is several ranges
    ordered = placed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    return ordered.mapInArrow(pack, f"cell int, {ids} array<long>, dim int, {rows} binary")


def _of_length(vectors: DataFrame, dim: int) -> DataFrame:
    whole = F.col("embedding").isNotNull() & (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull())
    return vectors.where(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def build(vectors: DataFrame, dim: int, k: int = 10, cells: int | None = None, recall: float = RECALL) -> CellIndex:
    """The index of all vectors (vec_id, embedding) of dim numbers, none null; others are not in it.

    There are about as many cells as the square root of the vectors. Some of the vectors, as queries, are answered exactly, and
    the fewest probes (doubled step by step) are taken that find the share recall of their k neighbours.
    """
    rows = _of_length(vectors, dim)
    n = rows.count()
    cells = cells or max(1, min(MOST_CELLS, round(math.sqrt(n))))
    centroids = train(rows, n, dim, cells) if n else np.zeros((1, dim))
    index = CellIndex(stored(packs(dealt(rows, centroids, 1), "ids", "rows"), "cells"), centroids, 1, 1.0)
    if n:
        rate = min(1.0, MEASURED / n)
        asked = stored(rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) < int(rate * (1 << 30))).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "asked")
        exact = stored(nearest(asked, rows.withColumnRenamed("v", "embedding"), k), "exact")
        while True:
            index.recall = measured(index, asked, exact, k)
            if index.recall >= recall or index.probes >= len(centroids):
                break
            index.probes = min(2 * index.probes, len(centroids))
    return index


def measured(index: CellIndex, asked: DataFrame, exact: DataFrame, k: int) -> float:
    """The share of exact (query_id, vec_id) that a search for asked finds; 1 if there are none."""
    hit = exact.join(search(index, asked, k).select("query_id", "vec_id"), ["query_id", "vec_id"]).count()
    return hit / max(1, exact.count()) if exact.count() else 1.0


def search(index: CellIndex, queries: DataFrame, k: int, places: int = 9) -> DataFrame:
    """query_id, vec_id, score, rank: the k best of the index's vectors in the cells that are nearest to each query (query_id, q), itself left out."""
    dim = index.centroids.shape[1]
    asked = _of_length(queries.select(F.col("query_id").alias("vec_id"), F.col("q").alias("embedding")), dim)
    opened = packs(dealt(asked, index.centroids, index.probes), "query_ids", "queries").drop("dim")
    return best_of_products(index.cells.join(opened, "cell"), k, places)


@query("vector_index_search")
def vector_index_search(spark, sf_dir):
    """Five neighbours of every vector whose id 50 divides, by the index; tests measure its recall against the exact search."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dim = v.where("embedding is not null").select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    index = once([v], "cells", lambda: build(v, dim.n if dim else 1, 5))
    found = search(index, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)
    return found.withColumn("score", F.round("score", 6))
