"""Filters, predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import plain_tokens
from corvane.session import table

#: Between ASCII word edges: \b takes letters beyond ASCII for parts of words.
IDENTIFIER = r"(?<![A-Za-z0-9_])[A-Z0-9]{10,}(?![A-Za-z0-9_])"
BOILERPLATE = r"(?i)copyright|all rights reserved|licensed under|^page [0-9]+|https?://"


def ready(parse: Column, chunk: Column, embedding: Column, readiness: Column) -> Column:
    """Whether a document is fit to be searched."""
    return (parse == "READY") & (chunk == "READY") & (embedding == "READY") & readiness.isin("READY", "PARTIAL_READY")


def visible(owner: Column, visibility: Column, user: Column | str, wanted: list | None = None) -> Column:
    """Owned by the user or public, and among the wanted owners if any are named."""
    seen = (owner == user) | (visibility == "PUBLIC")
    return seen & owner.isin(wanted) if wanted else seen


def above_floor(scored: DataFrame, key: str, score: str, absolute: float = 0.9, relative: float = 0.45) -> DataFrame:
    """Rows of at least the absolute score, and of at least that share of the key's best; the best is held to the first only."""
    top = F.max(score).over(Window.partitionBy(key))
    return scored.withColumn("_top", top).where((F.col(score) >= absolute) & ((F.col(score) >= relative * F.col("_top")) | (F.col(score) == F.col("_top")))).drop("_top")


def contains_any(docs: DataFrame, text: str, words: list[str]) -> DataFrame:
    return docs.where(F.exists(F.array(*map(F.lit, words[:16])), lambda w: F.contains(F.lower(text), w)))


def widened(docs: DataFrame, strict: Column, least: int) -> DataFrame:
    """The rows that pass strict, or all rows where fewer than least do; one plan, without a look from the driver."""
    counted = docs.withColumn("_strict", strict)
    enough = counted.agg((F.count_if("_strict") >= least).alias("_enough"))
    return counted.crossJoin(F.broadcast(enough)).where("_strict or not _enough").drop("_strict", "_enough")


@query(
    "filter_readiness",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 1000""",
)
def filter_readiness(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 1000)).select("o_orderkey")


@query(
    "filter_contains_any",
    "SELECT doc_id FROM documents WHERE list_bool_or([contains(lower(text), w) for w in ['license', 'copyright', 'worthless', 'reserved']])",
)
def filter_contains_any(spark, sf_dir):
    return contains_any(table(spark, sf_dir, "documents"), "text", ["license", "copyright", "worthless", "reserved"]).select("doc_id")


@query(
    "filter_access",
    """SELECT doc_id, source FROM documents WHERE (source = 'src3' OR lang = 'en') AND source IN ('src1', 'src2', 'src3')""",
)
def filter_access(spark, sf_dir):
    """Documents of one's own source or in the open language, among the named sources."""
    d = table(spark, sf_dir, "documents").withColumn("visibility", F.when(F.col("lang") == "en", "PUBLIC").otherwise("PRIVATE"))
    return d.where(visible(F.col("source"), F.col("visibility"), "src3", ["src1", "src2", "src3"])).select("doc_id", "source")


@query(
    "filter_route_scope",
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'domain' WHEN contains(lower(text), 'licen') THEN 'term' ELSE NULL END AS scope FROM documents WHERE lang = 'de' OR contains(lower(text), 'licen')""",
)
def filter_route_scope(spark, sf_dir):
    scope = F.when(F.col("lang") == "de", "domain").when(F.contains(F.lower("text"), F.lit("licen")), "term")
    return table(spark, sf_dir, "documents").select("doc_id", scope.alias("scope")).where("scope is not null")


@query(
    "filter_explicit_identifier",
    """SELECT doc_id FROM documents WHERE len(list_intersect(regexp_extract_all(text, '\\b[A-Z0-9]{10,}\\b'), (SELECT list(DISTINCT x) FROM (SELECT unnest(regexp_extract_all(text, '\\b[A-Z0-9]{10,}\\b')) AS x FROM documents WHERE doc_id % 2 = 0)))) > 0""",
)
def filter_explicit_identifier(spark, sf_dir):
    """Documents that share an identifier with one of even id: an equality join on identifiers, not on documents."""
    ids = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))).alias("x"))
    wanted = ids.where("doc_id % 2 = 0").select("x").distinct()
    return ids.join(wanted, "x", "left_semi").select("doc_id").distinct()


@query(
    "filter_score_floor",
    """SELECT o_orderkey, o_custkey FROM (SELECT *, o_totalprice / 100000 AS s, max(o_totalprice / 100000) OVER (PARTITION BY o_custkey) AS top FROM orders) WHERE s >= 0.9 AND (s >= 0.45 * top OR s = top)""",
)
def filter_score_floor(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 100000).alias("s"))
    return above_floor(o, "o_custkey", "s").select("o_orderkey", "o_custkey")


@query(
    "filter_corpus_quality",
    """WITH w AS (SELECT doc_id, n_chars, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1) AS w FROM documents)
    SELECT doc_id, n_chars BETWEEN 200 AND 20000 AS length_ok, len(w) > 0 AND CAST(len(list_distinct(w)) AS DOUBLE) / len(w) >= 0.2 AS diverse FROM w""",
)
def filter_corpus_quality(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", "n_chars", plain_tokens(F.col("text")).alias("w"))
    diverse = F.when(F.size("w") > 0, F.size(F.array_distinct("w")) / F.size("w") >= 0.2).otherwise(False)
    return w.select("doc_id", F.col("n_chars").between(200, 20000).alias("length_ok"), diverse.alias("diverse"))


@query(
    "filter_boilerplate_lines",
    f"""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '{BOILERPLATE}')), chr(10))) AS kept_md5 FROM documents""",
)
def filter_boilerplate_lines(spark, sf_dir):
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(BOILERPLATE)), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(kept.cast("binary")).alias("kept_md5"))


@query(
    "filter_widening",
    """WITH s AS (SELECT doc_id, contains(text, 'Apache') AS strict FROM documents) SELECT doc_id FROM s WHERE strict OR (SELECT count(*) FILTER (strict) FROM s) < 24""",
)
def filter_widening(spark, sf_dir):
    return widened(table(spark, sf_dir, "documents").select("doc_id", "text"), F.contains("text", F.lit("Apache")), 24).select("doc_id")


@query(
    "filter_dominant_domain",
    """SELECT o_orderkey FROM (SELECT *, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS top FROM orders) WHERE o_orderpriority = top""",
)
def filter_dominant_domain(spark, sf_dir):
    top = F.first("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("top", top).where("o_orderpriority = top").select("o_orderkey")


@query("filter_low_signal", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 80 AND regexp_matches(text, '[A-Za-z]{3,}')")
def filter_low_signal(spark, sf_dir):
    return table(spark, sf_dir, "documents").where((F.length(F.trim("text")) >= 80) & F.col("text").rlike("[A-Za-z]{3,}")).select("doc_id")


@query(
    "project_precedence",
    """SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), nullif(o_orderstatus, 'O'), c_mktsegment, 'none') AS tag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
)
def project_precedence(spark, sf_dir):
    """The first value that is set: of the row, its parent, or its parent's."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    tag = F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.nullif("o_orderstatus", F.lit("O")), "c_mktsegment", F.lit("none"))
    return joined.select("l_orderkey", "l_linenumber", tag.alias("tag"))


@query(
    "project_citations",
    """SELECT source, doc_id, substr(text, 1, 220) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def project_citations(spark, sf_dir):
    """One row a source, with an excerpt."""
    best = table(spark, sf_dir, "documents").groupBy("source").agg(F.max_by(F.struct("doc_id", "text"), F.struct("n_chars", -F.col("doc_id"))).alias("d"))
    return best.select("source", "d.doc_id", F.substring("d.text", 1, 220).alias("excerpt"))


@query(
    "project_items",
    """SELECT o_orderkey AS id, 'order-' || o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'PENDING' ELSE 'REJECTED' END AS status, CAST(NULLIF(o_custkey % 7, 0) AS VARCHAR) AS chain_id,
      coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'weights-' || o_orderkey END, CASE WHEN o_orderkey % 3 = 1 THEN 'manifest-' || o_orderkey END) AS cid, CAST(CASE WHEN o_totalprice > 1000 THEN o_totalprice END AS DOUBLE) AS score,
      o_orderpriority || ',' || c_mktsegment AS tags, c_name AS owner_wallet, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def project_items(spark, sf_dir):
    """List items of a service: ids as text, the first content address there is, numbers as doubles or null, times in ISO form, the owner's name."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey, "left")
    text, third = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("order-"), text).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("REJECTED").alias("status"),
        F.nullif(F.col("o_custkey") % 7, F.lit(0)).cast("string").alias("chain_id"),
        F.coalesce(F.when(third == 0, F.concat(F.lit("weights-"), text)), F.when(third == 1, F.concat(F.lit("manifest-"), text))).alias("cid"),
        F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).cast("double").alias("score"),
        F.concat_ws(",", "o_orderpriority", "c_mktsegment").alias("tags"),
        F.col("c_name").alias("owner_wallet"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
    )
