"""Removal of cross-site boilerplate lines, in DataFrame operations only.

A line's spread is the number of distinct sites (source) it stands on. Lines that occur less often than the
threshold cannot reach it; each of the rest gets a HyperLogLog sketch of its sites, merged by the aggregation.
Where the estimate is near the threshold the distinct sites are counted exactly. A line that reaches
the threshold is removed wherever it stands but for its first place (smallest doc_id, first line there), so that
one copy of every text stays in the corpus.

Lines are compared without the spaces around them, by two hashes of 64 and 32 bits; blank lines are never
removed. A null source is a site of its own. Rows that share a doc_id all count as the first place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import materialize

MIN_SITES = 10


def _lines(text):
    return F.split(text, "\n")


def _key(line):
    return F.struct(F.xxhash64(F.trim(line)).alias("h"), F.hash(F.trim(line)).alias("g"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, sketch_lg: int = 10) -> DataFrame:
    """h, g, first_doc of the lines (h, g, site, doc_id) that stand on min_sites sites or more."""
    often = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_sites)
    often = materialize(often.drop("n"), "often")
    placed = lines.select("h", "g", "site").join(often.select("h", "g"), ["h", "g"])
    estimates = materialize(
        placed.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", sketch_lg)).alias("sites")), "sketches"
    )
    margin = 1 + 4 * 1.04 / 2 ** (sketch_lg / 2) * min_sites
    near = estimates.where(F.abs(F.col("sites") - min_sites) <= margin).select("h", "g")
    exact = placed.join(near, ["h", "g"], "left_semi").groupBy("h", "g", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h", "g").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    spread = estimates.where(F.col("sites") > min_sites + margin).select("h", "g").union(exact.select("h", "g"))
    return spread.join(often, ["h", "g"])


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, counts: tuple[str, str] = ("_lines", "_removed")) -> DataFrame:
    """docs (doc_id, text, source and others) with boilerplate lines taken out of text; adds the numbers of lines and of removed ones.

    counts names the two added columns, which take the place of columns of docs with these names. A null text stays
    null and has no lines; a text of boilerplate lines only becomes empty; every row stays.
    """
    site = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    cut = docs.select("doc_id", site.alias("site"), F.explode(_lines(F.col("text"))).alias("line")).where("trim(line) != ''")
    lines = materialize(cut.select("doc_id", "site", _key(F.col("line")).alias("k")).select("doc_id", "site", "k.h", "k.g"), "lines")
    spread = materialize(boilerplate(lines, min_sites), "boilerplate")
    key = F.struct("h", "g")
    first = F.col("first_doc").eqNullSafe(F.col("doc_id")) if keep_first else F.lit(False)
    hits = (
        lines.select("doc_id", "h", "g")
        .join(spread, ["h", "g"])
        .groupBy("doc_id", "h", "g")
        .agg(F.first("first_doc").alias("first_doc"))
        .groupBy(F.col("doc_id").alias("of"))
        .agg(F.collect_list(F.when(~first, key)).alias("gone"), F.collect_list(F.when(first, key)).alias("once"))
    )
    # the input's columns stay in one struct beside ours, whatever their names
    joined = docs.select(F.struct("*").alias("d")).join(hits, F.col("d.doc_id").eqNullSafe(F.col("of")), "left")
    before = _lines(F.col("d.text"))
    trimmed = F.transform(before, lambda x: F.trim(x))
    after = F.filter(
        before,
        lambda x, i: ~F.array_contains("gone", _key(x)) & ~(F.array_contains("once", _key(x)) & (F.array_position(trimmed, F.trim(x)) <= i)),
    )
    cut = joined.select("d", F.when(F.col("gone").isNull(), before).otherwise(after).alias("kept"), F.col("gone").isNotNull().alias("hit"), F.size(before).alias("n"))
    changed = cut.select(
        "d",
        F.when(F.col("hit"), F.array_join("kept", "\n")).otherwise(F.col("d.text")).alias("text"),
        F.greatest(F.col("n"), F.lit(0)).cast("long").alias("lines"),
        F.greatest(F.col("n") - F.size("kept"), F.lit(0)).cast("long").alias("removed"),
    )
    same = [F.col("text") if c == "text" else F.col("d")[c].alias(c) for c in docs.columns if c not in counts]
    return changed.select(*same, F.col("lines").alias(counts[0]), F.col("removed").alias(counts[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what stays of each document's lines."""
    found = remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
),
b AS (
  SELECT trim(line) AS t, min(doc_id) AS first_doc FROM l WHERE trim(line) <> ''
  GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}
),
f AS (SELECT b.t, b.first_doc, min(i) AS first_i FROM b JOIN l ON trim(l.line) = b.t AND l.doc_id = b.first_doc GROUP BY ALL),
k AS (
  SELECT l.doc_id, l.i, l.line, (f.t IS NULL OR (l.doc_id = f.first_doc AND l.i = f.first_i)) AS keep
  FROM l LEFT JOIN f ON trim(l.line) = f.t
),
o AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '') AS text
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(o.text, '')) AS kept_sha256
FROM documents d LEFT JOIN o USING (doc_id)
"""
