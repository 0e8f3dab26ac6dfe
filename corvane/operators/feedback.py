"""The feedback loop and evaluation: impacts, plans, case scores, guardrails and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.overlap import answer_score
from corvane.functions.text import plain_tokens
from corvane.session import table

#: Fixed values of a proposal's impact: cap, base, step and least confidence.
CAP, BASE, STEP, FLOOR = 0.25, 0.08, 0.04, 0.2


def impact(direction: Column, n: Column, confidence: Column) -> Column:
    """direction · min(cap, base + n · step) · max(confidence, floor)."""
    return F.round(direction * F.least(F.lit(CAP), BASE + n * STEP) * F.greatest(confidence, F.lit(FLOOR)), 4)


def guardrail(metrics: DataFrame, limits: list[tuple[str, float, float]]) -> DataFrame:
    """metric, value, verdict of metrics (metric, value): pass up to the first limit, warn up to the second, else fail."""
    spark = metrics.sparkSession
    table_ = spark.createDataFrame(limits, "metric string, warn double, fail double")
    v = F.when(F.col("value") <= F.col("warn"), "pass").when(F.col("value") <= F.col("fail"), "warn").otherwise("fail")
    return metrics.join(F.broadcast(table_), "metric").select("metric", "value", v.alias("verdict"))


_U = "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1"


def _users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "purchase").alias("p"))


@query(
    "feedback_impact",
    f"SELECT user_id, CASE WHEN p > e THEN 1.0 WHEN e > p THEN -1.0 ELSE 0.0 END * round(least(0.25, 0.08 + abs(p - e) * 0.04) * greatest(abs(p - e) / CAST(n AS DOUBLE), 0.2), 4) AS impact FROM ({_U})",
)
def feedback_impact(spark, sf_dir):
    d = F.col("p") - F.col("e")
    return _users(spark, sf_dir).select("user_id", impact(F.signum(d), F.abs(d), F.abs(d) / F.col("n")).alias("impact"))


@query(
    "feedback_apply_plan",
    f"SELECT user_id, unnest(CASE WHEN e >= p + 3 THEN ['demote', 'review'] WHEN p >= e + 3 THEN ['promote'] ELSE ['keep'] END) AS step FROM ({_U})",
)
def feedback_apply_plan(spark, sf_dir):
    lists = F.when(F.col("e") >= F.col("p") + 3, F.array(F.lit("demote"), F.lit("review"))).when(F.col("p") >= F.col("e") + 3, F.array(F.lit("promote"))).otherwise(F.array(F.lit("keep")))
    return _users(spark, sf_dir).select("user_id", F.explode(lists).alias("step"))


@query("feedback_repair_track", f"SELECT user_id, CASE WHEN e = 0 THEN 'none' WHEN e * 3 >= n THEN 'urgent' WHEN e * 5 >= n THEN 'planned' ELSE 'watch' END AS track FROM ({_U})")
def feedback_repair_track(spark, sf_dir):
    e, n = F.col("e"), F.col("n")
    return _users(spark, sf_dir).select("user_id", F.when(e == 0, "none").when(e * 3 >= n, "urgent").when(e * 5 >= n, "planned").otherwise("watch").alias("track"))


@query(
    "feedback_regression_cases",
    "SELECT event_id, 'case-' || substr(sha256(CAST(user_id AS VARCHAR) || ':' || event_type), 1, 12) AS case_id, event_type AS kind FROM events WHERE event_type IN ('error', 'purchase')",
)
def feedback_regression_cases(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    key = F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type")
    return ev.select("event_id", F.concat(F.lit("case-"), F.substring(F.sha2(key, 256), 1, 12)).alias("case_id"), F.col("event_type").alias("kind"))


@query(
    "eval_case_scores",
    """WITH c AS (SELECT conv_id, list(DISTINCT role) AS r, sum(length(text)) AS chars FROM conversations GROUP BY 1)
    SELECT conv_id, array_to_string(list_filter([CASE WHEN NOT list_contains(r, 'system') THEN 'no-system' END, CASE WHEN NOT list_contains(r, 'assistant') THEN 'no-answer' END, CASE WHEN chars > 3000 THEN 'over-budget' END], lambda x: x IS NOT NULL), ',') AS failures FROM c""",
)
def eval_case_scores(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"), F.sum(F.length("text")).alias("chars"))
    wrong = F.array_compact(F.array(F.when(~F.array_contains("r", "system"), "no-system"), F.when(~F.array_contains("r", "assistant"), "no-answer"), F.when(F.col("chars") > 3000, "over-budget")))
    return c.select("conv_id", F.array_join(wrong, ",").alias("failures"))


@query(
    "eval_guardrails",
    """WITH m AS (SELECT 'p95' AS metric, quantile_disc(value, 0.95) AS value FROM events UNION ALL SELECT 'errors', count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) FROM events)
    SELECT metric, value, CASE metric WHEN 'p95' THEN CASE WHEN value <= 50 THEN 'pass' WHEN value <= 90 THEN 'warn' ELSE 'fail' END ELSE CASE WHEN value <= 0.1 THEN 'pass' WHEN value <= 0.25 THEN 'warn' ELSE 'fail' END END AS verdict FROM m""",
)
def eval_guardrails(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ev.createOrReplaceTempView("events_g")
    p95 = spark.sql("SELECT 'p95' AS metric, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS value FROM events_g")
    rate = ev.agg(F.lit("errors").alias("metric"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("value"))
    return guardrail(p95.unionByName(rate), [("p95", 50.0, 90.0), ("errors", 0.1, 0.25)])


@query(
    "eval_certification_rollup",
    """SELECT o_orderpriority, count(*) AS cases, count(*) FILTER (o_orderstatus = 'F') AS passed, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'release' ELSE 'blocked' END AS gate FROM orders GROUP BY 1""",
)
def eval_certification_rollup(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("cases"), F.count_if(F.col("o_orderstatus") == "F").alias("passed"))
    return g.withColumn("gate", F.when(F.col("cases") == F.col("passed"), "release").otherwise("blocked"))


@query("eval_suite_dedupe", "SELECT user_id, event_type, arg_max(event_id, value * 1000000 - event_id) AS best FROM events GROUP BY ALL")
def eval_suite_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.col("value") * 1000000 - F.col("event_id")).alias("best"))


@query("eval_ingestion_expectations", "SELECT page_id, regexp_matches(html, '<h1') AS has_title, len(regexp_extract_all(html, '<li[ >]')) >= 1 AS has_items, NOT regexp_matches(html, '<table') AS no_tables FROM pages")
def eval_ingestion_expectations(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", h.rlike("<h1").alias("has_title"), (F.size(F.regexp_extract_all("html", F.lit("<li[ >]"), F.lit(0))) >= 1).alias("has_items"), (~h.rlike("<table")).alias("no_tables"))


def manifest_problems(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem: what of a manifest (path, sha256) is missing or changed among files (path, sha256), and what is not listed."""
    both = manifest.withColumnRenamed("sha256", "wanted").join(files, "path", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "unlisted").when(F.col("sha256") != F.col("wanted"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


@query(
    "eval_manifest",
    """SELECT 'doc-' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unlisted' END AS problem FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 1 AND doc_id % 10 <> 0 AND doc_id % 7 <> 0""",
)
def eval_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    files = d.where("doc_id % 10 != 0").select("path", "sha256")
    listed = d.where("doc_id % 10 = 0 or doc_id % 7 = 0 or doc_id % 11 != 1")
    return manifest_problems(files, listed.select("path", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("sha256")).alias("sha256")))


def evidence_only_findings(answer: Column, evidence: Column, forbidden: list[str], least_overlap: float = 0.3, most_words: int = 220) -> Column:
    """What is wrong with an answer that must rest on its evidence alone: an array of names, empty for a good one."""
    words = F.array_distinct(plain_tokens(answer))
    shared = F.size(F.array_intersect(words, F.array_distinct(plain_tokens(evidence))))
    numbers = F.regexp_extract_all(answer, F.lit("[0-9]+"), F.lit(0))
    bad = F.lit(False)
    for term in forbidden:
        bad = bad | F.contains(F.lower(answer), F.lit(term))
    return F.array_compact(
        F.array(
            F.when(F.trim(answer) == "", "empty_answer"),
            F.when(evidence.isNull() | (F.trim(evidence) == ""), "no_evidence"),
            F.when((F.size(words) > 0) & (shared < F.size(words) * least_overlap), "not_in_evidence"),
            F.when(F.exists(numbers, lambda x: ~F.contains(evidence, x)), "unsupported_number"),
            F.when(bad, "forbidden_term"),
            F.when(F.size(plain_tokens(answer)) > most_words, "too_long"),
        )
    )


_P = "list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1)"


@query(
    "eval_evidence_only",
    f"""WITH p AS (SELECT conv_id, turn, role, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
    w AS (SELECT *, list_distinct({_P.format(x="a")}) AS wa, list_distinct({_P.format(x="coalesce(e, '')")}) AS we, {_P.format(x="a")} AS every FROM p WHERE role = 'assistant')
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(a) = '' THEN 'empty_answer' END, CASE WHEN e IS NULL OR trim(e) = '' THEN 'no_evidence' END,
      CASE WHEN len(wa) > 0 AND len(list_intersect(wa, we)) < len(wa) * 0.3 THEN 'not_in_evidence' END, CASE WHEN e IS NOT NULL AND len(list_filter(regexp_extract_all(a, '[0-9]+'), lambda x: NOT contains(e, x))) > 0 THEN 'unsupported_number' END,
      CASE WHEN contains(lower(a), 'guaranteed') OR contains(lower(a), 'idiot') THEN 'forbidden_term' END, CASE WHEN len(every) > 220 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS findings FROM w""",
)
def eval_evidence_only(spark, sf_dir):
    """Assistant turns held against the turn before as their only evidence."""
    c = table(spark, sf_dir, "conversations").withColumn("e", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    found = evidence_only_findings(F.col("text"), F.col("e"), ["guaranteed", "idiot"])
    return c.where("role = 'assistant'").select("conv_id", "turn", F.array_join(found, ",").alias("findings"))


def adapter_benchmark(answers: DataFrame, hidden: DataFrame) -> DataFrame:
    """adapter, cases, answered, score: mean answer score of each adapter over all hidden rows, unanswered ones counted 0.

    answers: adapter, case_id, answer; hidden: case_id, reference.
    """
    total = hidden.agg(F.count("*").alias("cases"))
    scored = answers.join(hidden, "case_id").select("adapter", answer_score(F.col("answer"), F.col("reference")).alias("s"))
    g = scored.groupBy("adapter").agg(F.sum("s").alias("s"), F.count("*").alias("answered"))
    return g.crossJoin(F.broadcast(total)).select("adapter", "cases", "answered", F.round(F.col("s") / F.col("cases"), 4).alias("score"))


@query("eval_adapter_benchmark")
def eval_adapter_benchmark(spark, sf_dir):
    """Conversations' first answers as four adapters' answers to their hidden reference, the last answer."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    g = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"), F.max_by("text", "turn").alias("reference"))
    answers = g.select(F.pmod("conv_id", F.lit(4)).cast("int").alias("adapter"), F.col("conv_id").alias("case_id"), "answer")
    return adapter_benchmark(answers, g.select(F.col("conv_id").alias("case_id"), "reference"))
