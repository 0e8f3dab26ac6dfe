"""Bounded retrieval against scoring every document, and neighbours against a loop."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane import storage
from corvane.functions import vectors
from corvane.functions.vectors import nearest
from corvane.operators import retrieval, topk


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(600)])
    share = 1 / np.arange(1, 601)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum()))) for i in range(2500)]
    rows += [(5000 + i, rows[7][1]) for i in range(30)] + [(9000, ""), (9001, None), (9002, "w0 " * 3000), (9003, "w599 w598 w597")]
    asked = [(1, rows[7][1]), (2, "w0 w1 w2"), (3, "w599 w598 w3 w3"), (4, "nowhere"), (5, ""), (6, "w0"), (7, "w599 w0 w0 w0"), (8, " ".join(words[200:260]))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache(), spark.createDataFrame(asked, "query_id long, text string")


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in df.collect())


def index_of(docs, shard_docs):
    sizes = docs.select(F.size(retrieval.plain_tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("t"), F.avg("n").alias("m")).first()
    rows = retrieval.lexical_impacts(docs, sizes.m).unionByName(retrieval.vector_impacts(docs))
    return topk.build(rows, sizes.t, shard_docs), sizes.t


@pytest.mark.parametrize("k, shard_docs", [(10, 65_536), (1, 300), (40, 50)])
def test_lexical_like_scoring_all(spark, corpus, k, shard_docs):
    docs, queries = corpus
    index, total = index_of(docs, shard_docs)
    got = topk.top_k(retrieval.lexical_terms(queries, index, total), index, k)
    want = retrieval.best(retrieval._rounded(retrieval.bm25(queries, docs)), k)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("k", [5, 24])
def test_hybrid_like_scoring_all(spark, corpus, k):
    docs, queries = corpus
    got = retrieval.retrieve(queries, docs, k)
    want = retrieval.best(retrieval._rounded(retrieval.hybrid(retrieval.bm25(queries, docs), retrieval.vector_scores(queries, docs))), k)
    assert rows_of(got) == rows_of(want)
    parts = {(r.query_id, r.doc_id): (round(r.lexical, 5), round(r.vector, 5)) for r in got.collect()}
    assert parts == {(r.query_id, r.doc_id): (round(r.lexical, 5), round(r.vector, 5)) for r in want.collect()}


def test_few_documents_are_candidates(spark, corpus):
    docs, queries = corpus
    index, total = index_of(docs, 500)
    terms = topk.bounded_terms(retrieval.lexical_terms(queries, index, total), index)
    n = {r.query_id: r["count"] for r in topk.candidates(terms, index, 10).groupBy("query_id").count().collect()}
    shared = index.blocks.join(terms.select("query_id", "term"), "term").select("query_id", F.explode("docs")).distinct().groupBy("query_id").count()
    every = {r.query_id: r["count"] for r in shared.collect()}
    assert n.keys() == every.keys() and sum(n.values()) < 0.25 * sum(every.values())
    assert n[3] < 0.05 * every[3]  # a rare term leaves little


def test_vector_like_scoring_all(spark, corpus):
    docs, queries = corpus
    got = retrieval.vector_top(queries, docs, 12)
    want = retrieval.best(retrieval._rounded(retrieval.vector_scores(queries, docs)), 12)
    assert rows_of(got) == rows_of(want)


def test_no_documents(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert retrieval.retrieve(corpus[1], none, 3).count() == 0
    assert retrieval.retrieve(none.withColumnRenamed("doc_id", "query_id"), corpus[0], 3).count() == 0


def test_nearest_like_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (402, [0.0] * 8), (403, None), (404, []), (405, [1.0, 2.0]), (406, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = nearest(df.where("vec_id % 5 = 0 or vec_id > 399").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), df, 4)
    want = []
    for q, a in rows:
        if (q % 5 and q < 400) or not a:
            continue
        size = lambda x: np.linalg.norm(x) or 1.0
        scores = [(round(float(np.dot(a, b) / size(a) / size(b)), 9), v) for v, b in rows if b and len(b) == len(a) and v != q]
        want += [(q, i + 1, v, round(s, 5)) for i, (s, v) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:4])]
    assert [(r[0], r[1], r[2], abs(r[3])) for r in rows_of(got.withColumnRenamed("vec_id", "doc_id"))] == [(a, b, c, abs(d)) for a, b, c, d in sorted(want)]


def test_stored_once_while_files_are_the_same(spark, tmp_path):
    path, made = str(tmp_path / "t"), []
    spark.range(3).write.parquet(path)
    for _ in range(2):
        storage.once([spark.read.parquet(path)], "x", lambda: made.append(1) or len(made))
    assert made == [1]
    assert storage.once([spark.read.parquet(path).where("id > 0")], "x", lambda: made.append(1) or len(made)) == 2
    spark.range(4).write.mode("overwrite").parquet(path)
    assert storage.once([spark.read.parquet(path)], "x", lambda: made.append(1) or len(made)) == 3
    assert storage.once([spark.createDataFrame([(1,)], "a int")], "x", lambda: "mine") == "mine"


@pytest.mark.parametrize("channels", [("lexical",), ("lexical", "vector")])
def test_no_posting_is_shuffled(spark, corpus, channels, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(retrieval.topk, "build", lambda *a: pytest.fail("an index of all postings"))
    got = retrieval.retrieve(queries, docs, 5, channels)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Aggregate" not in plan  # terms of documents are never rows


def test_many_packs_of_queries(spark, corpus, monkeypatch):
    docs, queries = corpus
    want = rows_of(retrieval.retrieve(queries, docs, 5))
    for name, value in (("QUERIES", 2), ("MOST_PACKS", 1), ("DOCS", 100), ("WORDS", 500), ("TERMS", 7)):
        monkeypatch.setattr(retrieval.packs, name, value)
    assert rows_of(retrieval.retrieve(queries, docs, 5)) == want


def test_only_candidates_texts_are_shuffled(spark, tmp_path, monkeypatch):
    from corvane.operators.retrieval import named_by

    spark.range(500).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.createDataFrame([(1, 7), (2, 7), (2, 9), (3, None), (4, 1000)], "query_id long, doc_id long")
    kept = named_by(docs, rows)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(x.doc_id for x in kept.collect()) == [7, 9]
    monkeypatch.setattr("corvane.operators.retrieval.MOST_SENT", 0)
    assert sorted(x.doc_id for x in named_by(docs, rows).collect()) == [7, 9]


def test_a_worker_holds_little_beside_its_batch(spark):
    """Twelve pairs of whole packs: objects for all of a batch and products of whole packs took over 100 MB."""
    r = np.random.default_rng(3)
    n, dim, pairs = vectors.PACK, 16, 12
    packs = r.normal(size=(pairs, n, dim))
    packs /= np.linalg.norm(packs, axis=2, keepdims=True)
    ids = [np.arange(n) + i * n for i in range(pairs)]
    lists = [pa.array(x, pa.list_(pa.int64())) for x in (ids, ids[::-1])]
    rows = [pa.array([m.tobytes() for m in x], pa.binary()) for x in (packs, packs[::-1])]
    batch = pa.RecordBatch.from_arrays([lists[0], rows[0], lists[1], rows[1], pa.array([dim] * pairs, pa.int32())], ["ids", "rows", "query_ids", "queries", "dim"])

    class Met:
        def select(self, *_):
            return self

        withColumn = where = select

        def mapInArrow(self, f, _):
            tracemalloc.start()
            self.out = pa.Table.from_batches(f(iter([batch]))).to_pandas()
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return self

    met = Met()
    vectors.best_of_products(met, 3, 9)
    assert met.peak < 30_000_000
    query, among = packs[5][700], packs[6]
    scores = np.round(among @ query, 9)
    want = sorted(zip(-scores, ids[6]))[:3]
    got = met.out[(met.out.query_id == ids[5][700])]
    assert list(zip(-got.score.round(9), got.vec_id)) == [(w, i) for w, i in want]
