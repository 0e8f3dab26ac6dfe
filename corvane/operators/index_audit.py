"""What a stored index lacks, holds beyond its table, or holds as it no longer is: found by checksums of buckets, rows joined only where these differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.session import table
from corvane.storage import stored

#: Buckets of ids, and how many make a group: the checksums of groups are compared first.
BUCKETS, GROUP = 65_536, 256
#: Columns that a target and its point must have alike, with the finding if not; version is compared apart.
ALIKE = {"content_hash": "stale", "payload_hash": "payload_drift", "provider": "provider_mismatch", "visibility": "visibility_drift"}
FINDINGS = ["missing", "orphan", "stale", "payload_drift", "provider_mismatch", "visibility_drift", "vector_drift", "duplicate"]
#: Cosine below which a point's vector has drifted from its target's; the share of sound targets below which an index has failed.
SAME_VECTOR, FAILED_BELOW = 0.999, 0.5


def _leaves(rows: DataFrame, bucket_count: int) -> DataFrame:
    held = rows.where("id is not null").select("id", *ALIKE, "version", F.col("vector").cast("array<double>").alias("vector"))
    return held.withColumns({"bucket": F.pmod(F.xxhash64("id"), F.lit(bucket_count)).cast("int"), "sum": F.xxhash64("id", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ALIKE), "version", "vector")})


def _sums(leaves: DataFrame, side: str) -> DataFrame:
    """bucket, count and checksum; equal rows do not cancel out, since hashes are added."""
    return leaves.groupBy("bucket").agg(F.struct(F.count("*").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("s")).alias(side))


def unequal_buckets(targets: DataFrame, points: DataFrame) -> DataFrame:
    """The buckets of _leaves() whose rows differ: groups of buckets are compared by their sums, then the buckets of unequal groups."""
    both = _sums(targets, "a").join(_sums(points, "b"), "bucket", "full").withColumn("group", F.floor(F.col("bucket") / GROUP))
    both = stored(both, "checksums")

    def total(side: str) -> Column:
        return F.struct(F.coalesce(F.sum(f"{side}.n"), F.lit(0)), F.coalesce(F.sum(f"{side}.s"), F.lit(0).cast("decimal(38,0)")))

    groups = both.groupBy("group").agg(total("a").alias("x"), total("b").alias("y")).where("x <> y").select("group")
    # BUCKETS / GROUP rows at most
    return both.join(F.broadcast(groups), "group").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def _cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def audit(targets: DataFrame, points: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """id, findings (in the order of FINDINGS) of every target and point that is not in order; what is in order has no row.

    Both have id, content_hash, payload_hash, provider, visibility, version, vector. missing: a target without a point; orphan: a point
    without a target; stale: another content, or a version below the target's; the drifts: the other columns differ though the content is the same; vector_drift: same content,
    but another length or a cosine below SAME_VECTOR; duplicate: several points of an id, of which the latest version counts (ties: the largest
    content hash). A repeated target counts once, in the same way. Null equals null; a null vector on either side is not compared; a null id has no row.

    Ids fall into buckets, at most BUCKETS; the checksums of both sides are compared, and only rows of unequal buckets are joined.
    """
    buckets = min(buckets, BUCKETS)
    a, b = _leaves(targets, buckets), _leaves(points, buckets)
    changed = stored(unequal_buckets(a, b), "unequal")

    def latest(rows: DataFrame, side: str) -> DataFrame:
        mine = rows.join(F.broadcast(changed), "bucket")  # BUCKETS rows at most
        kept = F.max_by(F.struct(*ALIKE, "version", "vector"), F.struct(F.coalesce("version", F.lit(-(1 << 62))), F.coalesce("content_hash", F.lit("")), "sum"))
        return mine.groupBy("id").agg(kept.alias(side), F.count("*").alias(f"{side}_n"))

    met = latest(a, "t").join(latest(b, "p"), "id", "full")
    both = F.col("t").isNotNull() & F.col("p").isNotNull()
    same = both & F.col("t.content_hash").eqNullSafe(F.col("p.content_hash"))
    older = both & F.coalesce(F.col("p.version") < F.col("t.version"), F.lit(False))
    found = [F.when(F.col("p").isNull(), "missing"), F.when(F.col("t").isNull(), "orphan"), F.when(both & (~same | older), "stale")]
    found += [F.when(same & ~F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")), name) for c, name in list(ALIKE.items())[1:]]
    vectors = F.col("t.vector").isNotNull() & F.col("p.vector").isNotNull()
    cosine = _cosine(F.col("t.vector"), F.col("p.vector"))
    apart = (F.size("t.vector") != F.size("p.vector")) | (~F.col("t.vector").eqNullSafe(F.col("p.vector")) & ~F.coalesce(cosine >= SAME_VECTOR, F.lit(False)))
    found += [F.when(same & vectors & apart, "vector_drift"), F.when(F.col("p_n") > 1, "duplicate")]
    return met.select("id", F.array_compact(F.array(*found)).alias("findings")).where(F.size("findings") > 0)


def report(targets: DataFrame, points: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: total_targets, total_points (distinct ids), a count for each of FINDINGS, ready_ratio (sound targets; 1 without targets) and status.

    unavailable without points, ready without findings, failed if fewer than FAILED_BELOW of the targets are sound, else degraded.
    """
    counted = findings.agg(*(F.count_if(F.array_contains("findings", f)).alias(f) for f in FINDINGS), F.count_if(~F.array_contains("findings", "orphan") & (F.array_remove("findings", "duplicate") != F.array().cast("array<string>"))).alias("unsound"), F.count("*").alias("any"))
    n = targets.agg(F.count_distinct("id").alias("total_targets")).crossJoin(points.agg(F.count_distinct("id").alias("total_points"))).crossJoin(counted)  # one row each
    ratio = F.when(F.col("total_targets") == 0, 1.0).otherwise(F.round((F.col("total_targets") - F.col("unsound")) / F.col("total_targets"), 6))
    status = F.when(F.col("total_points") == 0, "unavailable").when(F.col("any") == 0, "ready").when(F.col("ready_ratio") < FAILED_BELOW, "failed").otherwise("degraded")
    return n.withColumn("ready_ratio", ratio).select("total_targets", "total_points", *FINDINGS, "ready_ratio", status.alias("status"))


def _document_index(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All documents as targets; an index that was made when poor documents read otherwise, toxic ones were public and short ones were not there, and that still has benchmark items."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    none = F.lit(None).cast("array<double>")

    def row(key, text, shown, version):
        digest = F.md5(text.cast("binary"))
        return [key.alias("id"), digest.alias("content_hash"), F.md5(F.concat_ws("|", digest, shown).cast("binary")).alias("payload_hash"), F.lit("bag").alias("provider"), shown.alias("visibility"), version.cast("long").alias("version"), none.alias("vector")]

    private = F.lit("PRIVATE")
    targets = docs.select(*row(F.col("doc_id"), F.col("text"), private, F.lit(2)))
    old = docs.join(labels, "doc_id", "left").where("n_chars >= 200")
    text = F.when(F.col("quality") == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    points = old.select(*row(F.col("doc_id"), text, F.when(F.col("toxic") == 1, "PUBLIC").otherwise(private), F.lit(2)))
    return targets, points.unionByName(table(spark, sf_dir, "benchmark").select(*row(-1 - F.col("item_id"), F.col("text"), private, F.lit(1))))


_FOUND = """f AS (SELECT doc_id AS id, CASE WHEN n_chars < 200 THEN 'missing' WHEN quality = 0 THEN 'stale' WHEN toxic = 1 THEN 'payload_drift,visibility_drift' END AS findings FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT -1 - item_id, 'orphan' FROM benchmark)"""


@query("vector_index_audit", f"WITH {_FOUND} SELECT id, findings FROM f WHERE findings IS NOT NULL")
def vector_index_audit(spark, sf_dir):
    """What is wrong in an index of all documents."""
    return audit(*_document_index(spark, sf_dir)).select("id", F.array_join("findings", ",").alias("findings"))


@query(
    "vector_index_report",
    f"""WITH {_FOUND} SELECT (SELECT count(*) FROM documents) AS total_targets, (SELECT count(*) FROM documents WHERE n_chars >= 200) + (SELECT count(*) FROM benchmark) AS total_points, count(*) FILTER (findings = 'missing') AS missing, count(*) FILTER (findings = 'orphan') AS orphan,
    count(*) FILTER (findings = 'stale') AS stale, count(*) FILTER (starts_with(findings, 'payload')) AS payload_drift, count(*) FILTER (starts_with(findings, 'payload')) AS visibility_drift, 0 AS provider_mismatch, 0 AS vector_drift, 0 AS duplicate,
    round((count(*) FILTER (findings IS NULL))::DOUBLE / (SELECT count(*) FROM documents), 6) AS ready_ratio, CASE WHEN (count(*) FILTER (findings IS NULL))::DOUBLE / (SELECT count(*) FROM documents) < 0.5 THEN 'failed' ELSE 'degraded' END AS status FROM f""",
)
def vector_index_report(spark, sf_dir):
    """The health of that index in one row."""
    targets, points = _document_index(spark, sf_dir)
    return report(targets, points, audit(targets, points))
