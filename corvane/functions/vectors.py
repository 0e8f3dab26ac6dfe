"""Vectors: hashed bags of words, cosine similarity, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import plain_tokens
from corvane.session import table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a vector has no length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the characters' codes."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(2166136261).cast("long"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")),
    )


def sha_bucket(text: Column, size: int) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def sparse_bag(docs: DataFrame, key: str, text: str, size: int = 256, bigram_weight: float = 0.5, bucket=None) -> DataFrame:
    """key, bucket, w of each text's hashed bag of words: 1 for a word, bigram_weight for two in a row, length 1."""
    bucket = bucket or (lambda t: F.pmod(fnv1a(t), F.lit(size)).cast("int"))
    words = docs.select(key, plain_tokens(F.col(text)).alias("w"))
    twos = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit("_"), b)))
    terms = words.select(key, F.explode("w").alias("t"), F.lit(1.0).alias("x")).union(
        words.select(key, F.explode(twos).alias("t"), F.lit(bigram_weight).alias("x"))
    )
    # terms recur across texts: each distinct one is hashed once for a text
    counted = terms.groupBy(key, "t").agg(F.sum("x").alias("x"))
    sums = counted.groupBy(key, bucket(F.col("t")).alias("bucket")).agg(F.sum("x").alias("x"))
    return sums.select(key, "bucket", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))).alias("w"))


def dense(sparse: DataFrame, key: str, size: int) -> DataFrame:
    """key, embedding of sparse rows (key, bucket, w), one row at most for a key and bucket."""

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            buckets, w = batch.column("buckets"), batch.column("ws")
            rows = np.repeat(np.arange(batch.num_rows), buckets.value_lengths().to_numpy(zero_copy_only=False))
            out = np.zeros((batch.num_rows, size))
            out[rows, buckets.flatten().to_numpy()] = w.flatten().to_numpy()
            ends = pa.array(np.arange(batch.num_rows + 1) * size, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [key, "embedding"])

    held = sparse.groupBy(key).agg(F.collect_list(F.struct("bucket", "w")).alias("p")).select(key, F.col("p.bucket").alias("buckets"), F.col("p.w").alias("ws"))
    return held.mapInArrow(spread, f"{key} {held.schema[key].dataType.simpleString()}, embedding array<double>")


#: Vectors of a pack, and queries of one product with a pack.
PACK, ASKED = 2_048, 128


def packed(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """ids, dim, rows: packs of vectors of one length, as a matrix of doubles with rows of length 1; a null or empty vector is in none."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        held: dict = {}

        def out(dim):
            ids, rows = held.pop(dim)
            m = np.array(rows)
            size = np.sqrt((m * m).sum(1, keepdims=True))
            m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([dim], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["ids", "dim", "rows"])

        for batch in batches:
            # numbers stay in arrays: as objects they would take four times as much
            lists = batch.column("v")
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
            values, ends = lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for i, size, end in zip(batch.column("id").to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
                if not size:
                    continue
                ids, rows = held.setdefault(size, ([], []))
                ids.append(i)
                rows.append(values[end - size : end].copy())
                if len(ids) == PACK:
                    yield out(size)
        for dim in list(held):
            yield out(dim)

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.mapInArrow(pack, "ids array<long>, dim int, rows binary")


def best_of_products(met: DataFrame, k: int, places: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k best of each query in met, rows of a pack (ids, rows) and a pack of queries (query_ids, queries) of dim numbers each.

    Packs are read where the batch holds them, and ASKED queries at a time are scored, so a worker needs a batch and a few MB.
    """

    def best(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for n in range(batch.num_rows):
                ids, all_ids = (batch.column(c)[n].values.to_numpy() for c in ("ids", "query_ids"))
                dim = batch.column("dim")[n].as_py()
                a, asked = (np.frombuffer(batch.column(c)[n].as_buffer()).reshape(-1, dim) for c in ("rows", "queries"))
                at = min(k, len(ids)) - 1
                for first in range(0, len(all_ids), ASKED):
                    q_ids = all_ids[first : first + ASKED]
                    scores = np.round(asked[first : first + ASKED] @ a.T, places)
                    scores[q_ids[:, None] == ids] = -np.inf
                    least = np.partition(scores, -at - 1, axis=1)[:, -at - 1]
                    rows, columns = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))  # ties with the last included
                    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
                    rows, columns = rows[order], columns[order]
                    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    rows, columns = rows[place < k], columns[place < k]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(ids[columns]), pa.array(scores[rows, columns])], ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met.select("ids", "rows", "query_ids", "queries", "dim").mapInArrow(best, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, places: int = 9) -> DataFrame:
    """query_id, vec_id, score (to so many places), rank: the k vectors with the largest cosine to each query (query_id, q), itself left out.

    Both sides are packed into matrices; each pack of queries meets each pack of vectors in one product, of which k rows a
    query go on. Packs of queries are dealt to every part of the vectors by a key, so neither side has to fit one task. A
    null or empty vector, and one of another length than the query, is nobody's neighbour. Ties go to the smaller vec_id.
    """
    parts = vectors.sparkSession.sparkContext.defaultParallelism
    mine = packed(vectors, "vec_id", "embedding").withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    asked = packed(queries, "query_id", "q").select(F.col("ids").alias("query_ids"), "dim", F.col("rows").alias("queries"))
    everywhere = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = mine.join(everywhere, ["part", "dim"])

    return best_of_products(met, k, places)


_W = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1)"


@query(
    "vector_hashed_bag",
    f"""WITH w AS (SELECT item_id, {_W} AS w FROM benchmark),
    t AS (SELECT item_id, unnest(w) AS t, 1.0::DOUBLE AS x FROM w UNION ALL
      SELECT item_id, unnest([w[i] || '_' || w[i + 1] for i in range(1, len(w))]), 0.5 FROM w),
    s AS (SELECT item_id, CAST((('0x' || substr(sha256(t), 1, 8))::UBIGINT % 256) AS INTEGER) AS bucket, sum(x) AS x FROM t GROUP BY ALL)
    SELECT item_id, bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 9) AS w FROM s""",
)
def vector_hashed_bag(spark, sf_dir):
    """The wide variant's buckets, by SHA-256."""
    bag = sparse_bag(table(spark, sf_dir, "benchmark"), "item_id", "text", 256, bucket=lambda t: sha_bucket(t, 256))
    return bag.withColumn("w", F.round("w", 9))


@query("vector_fnv_bag")
def vector_fnv_bag(spark, sf_dir):
    """The 256-wide variant's buckets, by FNV-1a; tests compare it with a plain loop."""
    return dense(sparse_bag(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id", 256)


@query(
    "vector_nearest_neighbours",
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM n q JOIN n v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def vector_nearest_neighbours(spark, sf_dir):
    """Five neighbours of every vector whose id 50 divides, among all vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return nearest(q, v, 5).withColumn("score", F.round("score", 6))


@query(
    "vector_centroids",
    """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL)
    SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(x::DOUBLE), 6) AS mean FROM e GROUP BY ALL""",
)
def vector_centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label is not null").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(
    "vector_profile_similarity",
    """WITH c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
    m AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY label),
    f AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS f FROM embeddings GROUP BY label)
    SELECT e.vec_id, round((0.5 * greatest(list_cosine_similarity(e.embedding::DOUBLE[], m.m), 0) + 0.2 * greatest(list_cosine_similarity(e.embedding::DOUBLE[], f.f), 0)) / 0.7, 6) AS score
    FROM embeddings e JOIN m USING (label) JOIN f USING (label)""",
)
def vector_profile_similarity(spark, sf_dir):
    """A weighted mean over the profile vectors that are there: the label's centroid and its first vector."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroid = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("m")).select("label", F.transform("m", lambda x: x["m"]).alias("m"))
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    joined = e.join(centroid, "label").join(first, "label")

    def part(weight, v):
        return weight * F.greatest(cosine(F.col("embedding"), F.col(v)), F.lit(0.0))

    return joined.select("vec_id", F.round((part(0.5, "m") + part(0.2, "f")) / 0.7, 6).alias("score"))


@query(
    "vector_index_health",
    """WITH p AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 11 = 0)
    SELECT count(*) FILTER (p.vec_id IS NULL) AS missing, count(*) FILTER (e.vec_id IS NULL) AS orphan, count(*) FILTER (p.vec_id = e.vec_id) AS both
    FROM embeddings e FULL JOIN p ON e.vec_id = p.vec_id""",
)
def vector_index_health(spark, sf_dir):
    """What an index lacks, and what it holds beyond the table."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    points = e.where("vec_id % 7 != 0").union(e.where("vec_id % 11 = 0").select(F.col("vec_id") + 1000000)).withColumnRenamed("vec_id", "p")
    joined = e.join(points, e.vec_id == points.p, "full")
    return joined.agg(
        F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("vec_id").isNull()).alias("orphan"), F.count_if(F.col("p") == F.col("vec_id")).alias("both")
    )
