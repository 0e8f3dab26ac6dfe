"""The index of vectors against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.vectors import nearest
from corvane.operators import cells


def recall(index, df, k, every=50):
    q = df.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = {(r.query_id, r.vec_id): r.score for r in nearest(q, df, k).collect()}
    found = {(r.query_id, r.vec_id): r.score for r in cells.search(index, q, k).collect()}
    assert len(found) == len(exact) and all(found[x] == pytest.approx(exact[x]) for x in exact.keys() & found.keys())
    return len(exact.keys() & found.keys()) / len(exact)


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    dim = df.select(F.size("embedding").alias("n")).first().n
    index = cells.build(df, dim, 5)
    assert index.recall >= 0.98
    assert recall(index, df, 5) >= 0.95
    assert index.cells.select(F.sum(F.size("ids")).alias("n")).first().n == df.count()
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = cells.search(index, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_grouped_vectors_need_few_probes(spark):
    """Where vectors lie in groups, a small part of the cells is opened."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + rng.normal(0, 0.25, 16)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    index = cells.build(df, 16, 5)
    assert index.recall >= 0.98 and index.probes <= 0.25 * len(index.centroids)
    assert recall(index, df, 5, 20) >= 0.95


def test_hot_cell_and_odd_vectors(spark):
    """A third of the vectors are one vector: its cell is many packs; every vector of the length is indexed."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) if i % 3 else np.ones(6)).tolist()) for i in range(6000)]
    rows += [(7000, None), (7001, [1.0]), (7002, [0.0] * 6), (7003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    index = cells.build(df, 6, 3)
    sizes = index.cells.select(F.explode("ids").alias("i")).agg(F.count("*").alias("n"), F.countDistinct("i").alias("d")).first()
    assert (sizes.n, sizes.d) == (6001, 6001) and index.cells.agg(F.max(F.size("ids")).alias("m")).first().m <= cells.PACK
    assert index.recall >= 0.98


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "vec_id long, embedding array<double>")
    q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert {(r.query_id, r.vec_id) for r in cells.search(cells.build(df, 2), q, 3).collect()} == {(1, 2), (2, 1)}
    none = df.where("vec_id > 5")
    assert cells.search(cells.build(none, 2), q, 3).count() == 0


def test_k_means_splits_groups():
    rng = np.random.default_rng(2)
    rows = cells._unit(np.concatenate([np.eye(5)[i] + rng.normal(0, 0.05, (40, 5)) for i in range(5)]))
    of = (rows @ cells.k_means(rows, 5, seed=3).T).argmax(1).reshape(5, 40)
    assert all(len(set(x)) <= 2 for x in of.tolist()) and len(set(of[:, 0].tolist())) >= 3
