"""Sinks: JSONL, Markdown bundles, keyed upserts, point ids, patches and insert-ignore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.session import table


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bundles(rows: DataFrame, group: str, order: str, line: Column, size: int) -> DataFrame:
    """group, part, text, n: rows rendered and put together, so many to a part."""
    part = F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size)
    numbered = rows.select(group, order, part.cast("long").alias("part"), line.alias("_line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_line"))), lambda x: x["_line"]), "\n\n")
    return numbered.groupBy(group, "part").agg(text.alias("text"), F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(key, "_r.*")


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target with the rows of changes in place of those of the same key."""
    return target.join(changes.select(key), key, "left_anti").unionByName(changes)


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The rows to append: the first of each key that the target lacks."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(target.select(*key), key, "left_anti")


def point_id(seed: Column) -> Column:
    """A UUID-shaped id from the SHA-256 of the seed."""
    return F.regexp_replace(F.substring(F.sha2(seed, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


@query(
    "sink_markdown_bundles",
    """WITH r AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS part, '## ' || doc_id || chr(10) || text AS line FROM documents)
    SELECT source, part, md5(string_agg(line, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5, count(*) AS n FROM r GROUP BY ALL""",
)
def sink_markdown_bundles(spark, sf_dir):
    line = F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n"), "text")
    b = bundles(table(spark, sf_dir, "documents"), "source", "doc_id", line, 20)
    return b.select("source", "part", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n")


@query("sink_latest_wins", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def sink_latest_wins(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"]).withColumnRenamed("event_type", "status")


@query(
    "sink_point_ids",
    "SELECT vec_id, regexp_replace(substr(sha256(CAST(vec_id AS VARCHAR)), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point_id FROM embeddings",
)
def sink_point_ids(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", point_id(F.col("vec_id").cast("string")).alias("point_id"))


@query("sink_payload_patch", "SELECT doc_id, CASE WHEN source = 'src3' THEN 'PUBLIC' ELSE lang END AS visibility FROM documents")
def sink_payload_patch(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src3", "PUBLIC").otherwise(F.col("lang")).alias("visibility"))


@query(
    "sink_insert_ignore",
    "SELECT md5(text) AS k, min(doc_id) AS doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 100) GROUP BY 1",
)
def sink_insert_ignore(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    return insert_ignore(d.where("doc_id < 100"), d, ["k"], ["doc_id"]).select("k", "doc_id")


@query(
    "sink_upsert",
    "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, 0.0 FROM customer WHERE c_custkey % 100 = 0",
)
def sink_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    zero = F.lit(0.0).alias("c_acctbal")
    changes = c.where("c_custkey % 10 = 0").select("c_custkey", zero).union(c.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), zero))
    return upsert(c, changes, "c_custkey")


@query("sink_vector_literals", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS squares FROM embeddings")
def sink_vector_literals(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).alias("dims"), F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x), 6).alias("squares"))
