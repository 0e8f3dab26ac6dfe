"""Aggregations: corpus statistics, pivots, ordered folds, votes, percentiles, rates and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import plain_tokens
from corvane.operators.scans import clamped_sum
from corvane.session import table

_W = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1)"


def majority(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value, n of the most frequent value; of equals the one seen first in order."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("v")).select(key, f"v.{value}", "v.n")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to three places; 0 where the whole is 0."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 3)


@query(
    "agg_corpus_statistics",
    f"""WITH w AS (SELECT {_W} AS w FROM documents), t AS (SELECT unnest(list_distinct(w)) AS t FROM w)
    SELECT t AS token, count(*) AS df, (SELECT count(*) FROM documents) AS n_docs, round((SELECT avg(len(w)) FROM w), 6) AS mean_length FROM t GROUP BY t""",
)
def agg_corpus_statistics(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(plain_tokens(F.col("text")).alias("w"))
    sizes = w.agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size("w")), 6).alias("mean_length"))
    df = w.select(F.explode(F.array_distinct("w")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(sizes))


#: Kinds of feedback and the columns that count them.
FEEDBACK = {"GOOD_SOURCE": "good_source", "WRONG_SOURCE": "wrong_source", "MISSING_SOURCE": "missing_source", "BAD_ANSWER": "bad_answer", "GOOD_ANSWER": "good_answer"}


def feedback_pivot(rows: DataFrame) -> DataFrame:
    """Counts by kind, negative rate and suggested action of rows (kind, collection, expected, query_hash), nulls a key of their own."""
    counts = [F.count_if(F.col("kind") == k).alias(c) for k, c in FEEDBACK.items()]
    g = rows.groupBy("collection", "expected", "query_hash").agg(F.count("*").alias("total"), *counts)
    named = F.col("collection").isNotNull()
    action = (
        F.when((F.col("wrong_source") > 0) & named, "PENALIZE_SOURCE")
        .when(F.col("missing_source") > 0, "REVIEW_MISSING_SOURCE")
        .when(F.col("bad_answer") > 0, "REVIEW_ANSWER_QUALITY")
        .when((F.col("good_source") > 0) & named, "BOOST_SOURCE")
    )
    negative = F.col("wrong_source") + F.col("missing_source") + F.col("bad_answer")
    return g.withColumn("negative_rate", ratio(negative, F.col("total"))).withColumn("action", action)


@query(
    "agg_feedback_pivot",
    """WITH r AS (SELECT CASE event_type WHEN 'purchase' THEN 'GOOD_SOURCE' WHEN 'error' THEN 'WRONG_SOURCE' WHEN 'signup' THEN 'MISSING_SOURCE' WHEN 'view' THEN 'BAD_ANSWER' ELSE 'GOOD_ANSWER' END AS kind,
      CASE WHEN event_type <> 'signup' AND value >= 10 THEN user_id END AS collection, CASE WHEN event_type = 'signup' THEN user_id END AS expected, substr(sha256(CAST(floor(value / 25) AS INTEGER)::VARCHAR), 1, 16) AS query_hash FROM events),
    g AS (SELECT collection, expected, query_hash, count(*) AS total, count(*) FILTER (kind = 'GOOD_SOURCE') AS good_source, count(*) FILTER (kind = 'WRONG_SOURCE') AS wrong_source, count(*) FILTER (kind = 'MISSING_SOURCE') AS missing_source,
      count(*) FILTER (kind = 'BAD_ANSWER') AS bad_answer, count(*) FILTER (kind = 'GOOD_ANSWER') AS good_answer FROM r GROUP BY ALL)
    SELECT *, round((wrong_source + missing_source + bad_answer) / CAST(total AS DOUBLE), 3) AS negative_rate, CASE WHEN wrong_source > 0 AND collection IS NOT NULL THEN 'PENALIZE_SOURCE' WHEN missing_source > 0 THEN 'REVIEW_MISSING_SOURCE'
      WHEN bad_answer > 0 THEN 'REVIEW_ANSWER_QUALITY' WHEN good_source > 0 AND collection IS NOT NULL THEN 'BOOST_SOURCE' END AS action FROM g""",
)
def agg_feedback_pivot(spark, sf_dir):
    """Events as feedback on a user's collection: signups miss it, small values name none."""
    t = F.col("event_type")
    kind = F.when(t == "purchase", "GOOD_SOURCE").when(t == "error", "WRONG_SOURCE").when(t == "signup", "MISSING_SOURCE").when(t == "view", "BAD_ANSWER").otherwise("GOOD_ANSWER")
    rows = table(spark, sf_dir, "events").select(
        kind.alias("kind"),
        F.when((t != "signup") & (F.col("value") >= 10), F.col("user_id")).alias("collection"),
        F.when(t == "signup", F.col("user_id")).alias("expected"),
        F.substring(F.sha2(F.floor(F.col("value") / 25).cast("int").cast("string"), 256), 1, 16).alias("query_hash"),
    )
    return feedback_pivot(rows)


@query(
    "agg_clamped_running_sum",
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CASE event_type WHEN 'error' THEN -0.3 WHEN 'purchase' THEN 0.4 ELSE 0.05 END AS d FROM events),
    f AS (SELECT user_id, rn, round(least(greatest(CAST(0 AS DOUBLE) + d, -1), 1), 4) AS total FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.rn, round(least(greatest(f.total + e.d, -1), 1), 4) FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT user_id, arg_max(total, rn) AS total FROM f GROUP BY user_id""",
)
def agg_clamped_running_sum(spark, sf_dir):
    delta = F.when(F.col("event_type") == "error", -0.3).when(F.col("event_type") == "purchase", 0.4).otherwise(0.05)
    return clamped_sum(table(spark, sf_dir, "events").withColumn("d", delta), "user_id", ["ts", "event_id"], "d")


@query(
    "agg_promotion_gate",
    """SELECT c_mktsegment, bool_and(c_acctbal > -990) AS all_solvent, count(*) AS n, array_to_string(list_filter([CASE WHEN count(*) < 290 THEN 'too-few' END, CASE WHEN avg(c_acctbal) < 4500 THEN 'low-mean' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer GROUP BY 1""",
)
def agg_promotion_gate(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.bool_and(F.col("c_acctbal") > -990).alias("all_solvent"), F.count("*").alias("n"), F.avg("c_acctbal").alias("m"))
    why = F.array_compact(F.array(F.when(F.col("n") < 290, "too-few"), F.when(F.col("m") < 4500, "low-mean")))
    return g.select("c_mktsegment", "all_solvent", "n", F.array_join(why, ",").alias("reasons"))


@query(
    "agg_weighted_terms",
    f"""WITH t AS (SELECT source, unnest({_W}) AS t FROM documents), c AS (SELECT source, t, count(*) AS n FROM t WHERE length(t) > 3 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, t) AS rn FROM c)
    SELECT source, string_agg(t, ' ' ORDER BY rn) AS keywords FROM r WHERE rn <= 12 GROUP BY source""",
)
def agg_weighted_terms(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("source", F.explode(plain_tokens(F.col("text"))).alias("t")).where("length(t) > 3")
    c = t.groupBy("source", "t").agg(F.count("*").alias("n"))
    r = c.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "t"))).where("rn <= 12")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"])
    return r.groupBy("source").agg(F.array_join(ordered, " ").alias("keywords"))


@query(
    "agg_majority_vote",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c)
    SELECT user_id, event_type, n FROM r WHERE rn = 1""",
)
def agg_majority_vote(spark, sf_dir):
    return majority(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query(
    "agg_strict_plurality",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn, lead(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS n2 FROM c)
    SELECT user_id, CASE WHEN n > coalesce(n2, 0) THEN event_type END AS winner FROM r WHERE rn = 1""",
)
def agg_strict_plurality(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    r = c.withColumns({"rn": F.row_number().over(w), "n2": F.coalesce(F.lead("n").over(w), F.lit(0))}).where("rn = 1")
    return r.select("user_id", F.when(F.col("n") > F.col("n2"), F.col("event_type")).alias("winner"))


@query(
    "agg_ordinal_maximum",
    """SELECT o_custkey, arg_max(o_orderpriority, -CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS worst FROM orders GROUP BY 1""",
)
def agg_ordinal_maximum(spark, sf_dir):
    rank = -F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", rank).alias("worst"))


@query(
    "agg_quality_rollup",
    """SELECT source, CAST(floor(avg(n_chars) + 0.5) AS BIGINT) AS mean_chars, CAST(sum(n_chars) AS BIGINT) AS total, CASE WHEN count(*) FILTER (n_chars < 800) / CAST(count(*) AS DOUBLE) >= 0.34 THEN 'noisy' ELSE 'clean' END AS level FROM documents GROUP BY source""",
)
def agg_quality_rollup(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.floor(F.avg("n_chars") + 0.5).cast("long").alias("mean_chars"), F.sum("n_chars").alias("total"), (F.count_if(F.col("n_chars") < 800) / F.count("*")).alias("r")
    )
    return g.select("source", "mean_chars", "total", F.when(F.col("r") >= 0.34, "noisy").otherwise("clean").alias("level"))


@query(
    "agg_percentiles",
    """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS top, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1""",
)
def agg_percentiles(spark, sf_dir):
    """Nearest-rank percentiles."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events_p")
    return spark.sql(
        "SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS top, round(avg(value), 6) AS mean, count(*) AS n FROM events_p GROUP BY event_type"
    )


@query("agg_histogram_missing", "SELECT coalesce(nullif(o_orderstatus, 'P'), 'missing') AS bucket, count(*) AS n FROM orders GROUP BY 1")
def agg_histogram_missing(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("missing")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "agg_ratios",
    """SELECT l_suppkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 0 ELSE round(count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') / CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE), 3) END AS r FROM lineitem GROUP BY 1""",
)
def agg_ratios(spark, sf_dir):
    a, b = F.count_if((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")), F.count_if(F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(ratio(a.cast("double"), b.cast("double")).alias("r"))


@query(
    "agg_dynamic_metric_means",
    """WITH m AS (SELECT l_orderkey, unnest(['quantity', 'price', 'tax']) AS metric, unnest([l_quantity, l_extendedprice, l_tax]) AS v FROM lineitem) SELECT metric, round(avg(v), 6) AS mean FROM m GROUP BY 1""",
)
def agg_dynamic_metric_means(spark, sf_dir):
    m = F.create_map(F.lit("quantity"), "l_quantity", F.lit("price"), "l_extendedprice", F.lit("tax"), "l_tax")
    return table(spark, sf_dir, "lineitem").select(F.explode(m).alias("metric", "v")).groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"))


@query(
    "agg_weighted_merge",
    """WITH p AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS m, count(*) AS w FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(sum(m * w) / sum(w), 4) AS merged FROM p GROUP BY 1""",
)
def agg_weighted_merge(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("m"), F.count("*").alias("w"))
    return p.groupBy("l_suppkey").agg(F.round(F.sum(F.col("m") * F.col("w")) / F.sum("w"), 4).alias("merged"))


@query(
    "agg_event_sums_exact",
    """SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS HUGEINT) * 1000000000000000000 ELSE 0 END) AS VARCHAR) AS bought, CAST(sum(CASE WHEN event_type = 'error' THEN -CAST(floor(value) AS HUGEINT) * 1000000000000000000 ELSE 0 END) AS VARCHAR) AS lost FROM events GROUP BY 1""",
)
def agg_event_sums_exact(spark, sf_dir):
    """Amounts in units of 1e-18, beyond 64 bits, summed as decimals and written out."""
    v = F.floor("value").cast("decimal(10,0)") * F.lit("1000000000000000000").cast("decimal(19,0)")

    def of(kind, x):
        return F.sum(F.when(F.col("event_type") == kind, x).otherwise(0)).cast("decimal(38,0)").cast("string")

    return table(spark, sf_dir, "events").groupBy("user_id").agg(of("purchase", v).alias("bought"), of("error", -v).alias("lost"))


@query(
    "agg_kind_count_map",
    """WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role || ':' || n, ' ' ORDER BY role) AS kinds FROM c GROUP BY conv_id""",
)
def agg_kind_count_map(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    m = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    return m.select("conv_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), " ").alias("kinds"))


@query(
    "agg_failure_taxonomy",
    """SELECT coalesce(event_type, 'all') AS kind, CASE WHEN grouping(h) = 1 THEN -1 ELSE h END AS hour, count(*) AS n FROM (SELECT event_type, CAST(hour(ts) AS INTEGER) AS h FROM events) GROUP BY GROUPING SETS ((event_type), (event_type, h))""",
)
def agg_failure_taxonomy(spark, sf_dir):
    """Totals and totals by bucket in one pass."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.hour("ts").alias("h"))
    g = ev.groupingSets([["kind"], ["kind", "h"]], "kind", "h").agg(F.grouping("h").alias("g"), F.count("*").alias("n"))
    return g.select("kind", F.when(F.col("g") == 1, -1).otherwise(F.col("h")).alias("hour"), "n")


@query(
    "agg_finding_trend",
    """WITH f AS (SELECT conv_id, unnest(list_filter([CASE WHEN length(text) > 400 THEN 'long' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END], lambda x: x IS NOT NULL)) AS finding FROM conversations WHERE role = 'assistant')
    SELECT finding, count(DISTINCT conv_id) AS n, round(count(DISTINCT conv_id) / CAST((SELECT count(DISTINCT conv_id) FROM conversations) AS DOUBLE), 6) AS rate FROM f GROUP BY 1""",
)
def agg_finding_trend(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    found = F.array_compact(F.array(F.when(F.length("text") > 400, "long"), F.when(F.contains("text", F.lit("\n")), "lines")))
    f = c.where("role = 'assistant'").select("conv_id", F.explode(found).alias("finding"))
    total = c.agg(F.count_distinct("conv_id").alias("total"))
    g = f.groupBy("finding").agg(F.count_distinct("conv_id").alias("n")).crossJoin(F.broadcast(total))
    return g.select("finding", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


@query(
    "agg_cluster_summary",
    """WITH c AS (SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS cluster, l_orderkey, l_linenumber, l_returnflag FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY l_orderkey, l_linenumber) AS rn FROM c)
    SELECT cluster, count(*) AS n, max(l_returnflag) AS worst, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 8) AS examples FROM r GROUP BY cluster""",
)
def agg_cluster_summary(spark, sf_dir):
    """Counts, the worst flag and the first eight examples; the window keeps eight rows a task before the shuffle."""
    q = F.col("l_quantity")
    c = table(spark, sf_dir, "lineitem").select(F.when(q < 10, "small").when(q < 30, "middle").otherwise("large").alias("cluster"), "l_orderkey", "l_linenumber", "l_returnflag")
    first = c.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy("l_orderkey", "l_linenumber"))).where("rn <= 8")
    ex = first.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "l_orderkey"))), lambda x: x["l_orderkey"].cast("string")), ",").alias("examples"))
    return c.groupBy("cluster").agg(F.count("*").alias("n"), F.max("l_returnflag").alias("worst")).join(ex, "cluster")


@query(
    "agg_demand_coverage",
    """WITH d AS (SELECT user_id, unnest(list_filter(['view', 'click', 'purchase'], lambda x: NOT list_contains(s, x))) AS lacks FROM (SELECT user_id, list(DISTINCT event_type) AS s FROM events GROUP BY user_id, CAST(ts AS DATE))) SELECT lacks, count(*) AS n FROM d GROUP BY 1""",
)
def agg_demand_coverage(spark, sf_dir):
    """How many users' days lack each wanted kind of event."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts")).agg(F.collect_set("event_type").alias("s"))
    wanted = F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))
    return s.select(F.explode(F.array_except(wanted, "s")).alias("lacks")).groupBy("lacks").agg(F.count("*").alias("n"))


@query(
    "agg_reindex_audit",
    """SELECT count(*) AS n, count(*) FILTER (text = '') AS empty, count(*) FILTER (n_chars <> length(text)) AS stale, count(DISTINCT md5(text)) AS distinct_texts FROM documents""",
)
def agg_reindex_audit(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("n_chars") != F.length("text")).alias("stale"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("distinct_texts")
    )


@query("agg_answer_quality")
def agg_answer_quality(spark, sf_dir):
    """Half longest-common-subsequence F1, half BLEU, of each assistant turn against the turn before it."""
    from corvane.functions.overlap import answer_score

    c = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = c.withColumn("reference", before).where("role = 'assistant' and reference is not null")
    return pairs.select("conv_id", answer_score(F.col("text"), F.col("reference")).alias("score")).groupBy("conv_id").agg(F.round(F.avg("score"), 4).alias("score"))
