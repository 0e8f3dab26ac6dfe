"""Whole paths: from queries to grounded evidence, from uploads to indexed chunks, from feedback to adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import plain_tokens, short_hash
from corvane.operators.filters import above_floor
from corvane.operators.retrieval import best, confidence, named_by, phrase_bonus, prune, retrieve
from corvane.operators.scans import clamped_sum
from corvane.operators.structure import chunks
from corvane.session import table
from corvane.storage import stored


def grounded_evidence(queries: DataFrame, docs: DataFrame, first: int = 24, last: int = 3) -> DataFrame:
    """query_id, doc_id, rank, confidence, evidence of queries (query_id, text) over docs (doc_id, text).

    Both channels are fused and cut to the first rows; phrases are scored on those; a floor and the last cut follow; then
    each text is pruned to its evidence. All queries at once; the candidates of each step are stored.
    """
    fused = stored(retrieve(queries, docs, first).select("query_id", "doc_id", "score"), "fused")
    exact = stored(phrase_bonus(fused, queries, docs), "exact")
    kept = best(above_floor(exact, "query_id", "score"), last)
    w = Window.partitionBy("query_id")
    sure = kept.withColumn("confidence", confidence(F.max("score").over(w), F.max(F.when(F.col("rank") == 2, F.col("score"))).over(w)))
    words = queries.select("query_id", F.array_distinct(plain_tokens(F.col("text"))).alias("a"))
    rows = sure.join(words, "query_id").join(named_by(docs, exact).select("doc_id", "text"), "doc_id")
    return prune(rows, carry=("rank", "confidence")).select("query_id", "doc_id", "rank", "confidence", "evidence")


def indexed_chunks(docs: DataFrame) -> DataFrame:
    """chunk_id, doc_id, chunk_index, content, tokens, content_hash: what an upload puts into the index; equal contents of a document once."""
    c = chunks(docs)
    hashed = c.withColumns({"content_hash": short_hash(F.col("content")), "tokens": F.greatest(F.lit(1), F.ceil(F.length("content") / 4)).cast("long")})
    once = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "content_hash").orderBy("chunk_index"))).where("_n = 1").drop("_n")
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return once.select(F.sha2(key, 256).alias("chunk_id"), "doc_id", "chunk_index", "content", "tokens", "content_hash")


def ranking_adjustments(events: DataFrame, least: int = 3) -> DataFrame:
    """user_id, delta, n, gate: feedback folded into a bounded delta, which only enough feedback opens."""
    d = F.when(F.col("event_type") == "error", -0.08).when(F.col("event_type") == "purchase", 0.04).otherwise(0.0)
    judged = events.withColumn("d", d).where("d != 0")
    folded = clamped_sum(judged, "user_id", ["ts", "event_id"], "d", -0.35, 0.35)
    n = judged.groupBy("user_id").agg(F.count("*").alias("n"))
    return folded.join(n, "user_id").select("user_id", F.col("total").alias("delta"), "n", F.when(F.col("n") >= least, "open").otherwise("held").alias("gate"))


@query("plan_grounded_evidence")
def plan_grounded_evidence(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return grounded_evidence(q, table(spark, sf_dir, "documents"))


@query("plan_indexed_chunks")
def plan_indexed_chunks(spark, sf_dir):
    return indexed_chunks(table(spark, sf_dir, "documents")).drop("content")


@query(
    "plan_ranking_adjustments",
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CASE event_type WHEN 'error' THEN -0.08 ELSE 0.04 END AS d FROM events WHERE event_type IN ('error', 'purchase')),
    f AS (SELECT user_id, rn, round(least(greatest(CAST(0 AS DOUBLE) + d, -0.35), 0.35), 4) AS t FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, round(least(greatest(f.t + e.d, -0.35), 0.35), 4) FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT user_id, arg_max(t, rn) AS delta, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'open' ELSE 'held' END AS gate FROM f GROUP BY 1""",
)
def plan_ranking_adjustments(spark, sf_dir):
    return ranking_adjustments(table(spark, sf_dir, "events"))


@query(
    "plan_collection_profiles",
    """WITH w AS (SELECT source, lang, n_chars, doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1) AS w FROM documents),
    k AS (SELECT source, t, count(*) AS n FROM (SELECT source, unnest(w) AS t FROM w) WHERE length(t) > 4 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, t) AS rn FROM k),
    kk AS (SELECT source, string_agg(t, ' ' ORDER BY rn) AS keywords FROM r WHERE rn <= 8 GROUP BY 1), l AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY source, lang),
    s AS (SELECT source, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY 1)
    SELECT s.source, docs, CAST(chars AS BIGINT) AS chars, l.lang AS main_lang, keywords, substr(sha256(keywords), 1, 16) AS profile_hash FROM s JOIN l USING (source) JOIN kk USING (source) WHERE l.rn = 1""",
)
def plan_collection_profiles(spark, sf_dir):
    """Each source's size, main language, keywords and the hash that tells whether its profile changed."""
    d = table(spark, sf_dir, "documents")
    words = d.select("source", F.explode(plain_tokens(F.col("text"))).alias("t")).where("length(t) > 4").groupBy("source", "t").agg(F.count("*").alias("n"))
    top = words.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "t"))).where("rn <= 8")
    keywords = top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"]), " ").alias("keywords"))
    langs = d.groupBy("source", "lang").agg(F.count("*").alias("n"))
    first = langs.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang"))).where("rn = 1").select("source", F.col("lang").alias("main_lang"))
    s = d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return s.join(first, "source").join(keywords, "source").withColumn("profile_hash", F.substring(F.sha2("keywords", 256), 1, 16))
