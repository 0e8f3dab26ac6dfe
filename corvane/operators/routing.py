"""Routing: rules that vote for a domain, query signals, collection scores and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import normalized, plain_tokens, tokens
from corvane.functions.vectors import cosine
from corvane.session import table

#: Rules: domain, subtopic, terms, hints, words that must occur, terms of high risk. A table of the caller's own takes their place.
RULES = [
    ("rights", "licence", ["licensed", "license", "rights reserved", "copyright"], ["terms of use"], ["license"], ["reserved"]),
    ("rights", "open", ["cc by", "apache", "gnu"], ["open licences"], ["license", "source"], []),
    ("safety", "insult", ["idiot", "scum", "worthless", "pathetic"], ["tone"], ["people"], ["scum", "trash"]),
    ("safety", "secrets", ["token", "password", "secret"], ["credentials"], ["key"], ["token"]),
    ("knowledge", "question", ["what", "which", "how many"], ["facts"], ["answer"], []),
    ("knowledge", "place", ["city", "river", "capital"], ["geography"], ["place"], []),
    ("work", "code", ["write a function", "program", "python"], ["code"], ["function"], []),
]
#: Domains that are of medium risk where none of their risk terms occurs.
SENSITIVE = ["safety", "rights"]
#: Weights of the signals of a collection's score.
WEIGHTS = {"profile": 0.45, "lexical": 0.25, "route": 0.15, "quality": 0.1, "freshness": 0.05}


def _has(term: str) -> Column:
    """Whether a query (columns norm and words) has a term: as a phrase, as a word, as a word's beginning, or softened at its end."""
    if " " in term:
        return F.contains("norm", F.lit(term))
    found = F.array_contains("words", term)
    if term.endswith("k"):
        found = found | F.exists("words", lambda w: F.startswith(w, F.lit(term[:-1] + "g")))
    if len(term) >= 4:
        found = found | F.exists("words", lambda w: F.startswith(w, F.lit(term)))
    return found


def route(rows: DataFrame, key: str, text: str, rules=RULES, sensitive=SENSITIVE) -> DataFrame:
    """key, domain, subtopics, hints, must_include, risk, confidence of each text.

    The domain is the one with most rules that fit; of equals the one whose rule has most terms, then the first. Subtopics, hints
    and words come from its rules that fit, those with most terms first; four, eight and twelve of them at most. No rule: general.
    """
    q = rows.select(key, normalized(F.col(text)).alias("norm"), tokens(F.col(text)).alias("words"))
    fits = []
    for i, (domain, subtopic, terms, hints, include, risky) in enumerate(rules):
        n = sum(_has(t).cast("int") for t in terms)
        danger = F.lit(False)
        for t in risky:
            danger = danger | _has(t)
        texts = [F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (hints, include)]
        fit = F.struct((-n).alias("minus"), F.lit(i).alias("at"), F.lit(domain).alias("domain"), F.lit(subtopic).alias("subtopic"), texts[0].alias("hints"), texts[1].alias("include"), danger.alias("danger"))
        fits.append(F.when(n > 0, fit))
    q = q.select(key, F.array_sort(F.array_compact(F.array(*fits))).alias("fits"))
    first = F.transform(F.array_distinct(F.transform("fits", lambda x: x["domain"])), lambda d: F.struct((-F.size(F.filter("fits", lambda x: x["domain"] == d))).alias("minus"), F.array_position(F.transform("fits", lambda x: x["domain"]), d).alias("at"), d.alias("domain")))
    q = q.withColumn("domain", F.when(F.size("fits") > 0, F.element_at(F.array_sort(first), 1)["domain"]).otherwise("general"))
    q = q.withColumn("own", F.filter("fits", lambda x: x["domain"] == F.col("domain")))

    def every(name, most):
        return F.slice(F.array_distinct(F.flatten(F.transform("own", lambda x: x[name]))), 1, most)

    risk = F.when(F.exists("own", lambda x: x["danger"]), "high").when(F.col("domain").isin(sensitive), "medium").otherwise("low")
    top = -F.element_at("fits", 1)["minus"]
    confidence = F.when(F.size("own") == 0, "low").when((F.size("own") >= 2) | (top > 1), "high").otherwise("medium")
    return q.select(
        key, "domain", F.slice(F.array_distinct(F.transform("own", lambda x: x["subtopic"])), 1, 4).alias("subtopics"), every("hints", 8).alias("hints"), every("include", 12).alias("must_include"),
        F.when(F.size("own") == 0, "low").otherwise(risk).alias("risk"), confidence.alias("confidence"),
    )


def weighted_signals(signals: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the signals that are there; null where none is."""
    total = sum(F.when(c.isNotNull(), weights[n]).otherwise(0.0) for n, c in signals.items())
    return F.try_divide(sum(F.coalesce(c * weights[n], F.lit(0.0)) for n, c in signals.items()), total)


def decide(top: Column, second: Column) -> Column:
    """strict where one source leads clearly, broad where several are near, suggest where the best is weak, else no_source."""
    gap = top - F.coalesce(second, F.lit(0.0))
    return F.when(top.isNull() | (top < 0.2), "no_source").when((top >= 0.6) & (gap >= 0.1), "strict").when(top >= 0.35, "broad").otherwise("suggest")


_NORM_SQL = "trim(regexp_replace(regexp_replace(lower(translate(text, 'Iİ', 'ıi')), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_RULE_ROWS = ", ".join(f"({i}, '{d}', '{st}', {hints}, {include}, {risky})" for i, (d, st, _, hints, include, risky) in enumerate(RULES))
_TERM_ROWS = ", ".join(f"({i}, '{t}', {risky})" for i, r in enumerate(RULES) for t, risky in [*((x, "FALSE") for x in r[2]), *((x, "TRUE") for x in r[5])])
_TEXTS = "(SELECT item_id AS text_id, text FROM benchmark UNION ALL SELECT -doc_id - 1, text FROM documents)"


@query(
    "route_rules",
    f"""WITH rule(nr, domain, subtopic, hints, include, risky) AS (VALUES {_RULE_ROWS.replace(", []", ", []::VARCHAR[]")}), term(nr, term, risky) AS (VALUES {_TERM_ROWS}),
    q AS (SELECT text_id, {_NORM_SQL} AS norm FROM {_TEXTS}), w AS (SELECT text_id, norm, list_filter(string_split(norm, ' '), lambda t: length(t) > 1 OR regexp_matches(t, '[0-9]')) AS words FROM q),
    hit AS (SELECT text_id, nr, count(*) FILTER (NOT risky) AS n, count(*) FILTER (risky) > 0 AS danger FROM w, term WHERE CASE WHEN contains(term, ' ') THEN contains(norm, term) ELSE list_contains(words, term)
      OR (length(term) >= 4 AND len(list_filter(words, lambda x: starts_with(x, term))) > 0) OR (ends_with(term, 'k') AND len(list_filter(words, lambda x: starts_with(x, term[:-2] || 'g'))) > 0) END GROUP BY ALL),
    fit AS (SELECT hit.*, rule.* EXCLUDE nr, row_number() OVER (PARTITION BY text_id ORDER BY n DESC, nr) AS place FROM hit JOIN rule USING (nr) WHERE n > 0),
    dom AS (SELECT text_id, domain, row_number() OVER (PARTITION BY text_id ORDER BY count(*) DESC, min(place)) AS rn FROM fit GROUP BY text_id, domain),
    own AS (SELECT fit.* FROM fit JOIN dom USING (text_id, domain) WHERE rn = 1),
    g AS (SELECT text_id, any_value(domain) AS domain, string_agg(subtopic, ',' ORDER BY place) AS subtopics, string_agg(array_to_string(hints, ','), ',' ORDER BY place) AS hints, bool_or(danger) AS danger, count(*) AS k FROM own GROUP BY 1),
    top AS (SELECT text_id, max(n) AS n FROM fit GROUP BY 1)
    SELECT q.text_id, coalesce(domain, 'general') AS domain, coalesce(subtopics, '') AS subtopics, coalesce(hints, '') AS hints, CASE WHEN k IS NULL THEN 'low' WHEN danger THEN 'high' WHEN domain IN ('safety', 'rights') THEN 'medium' ELSE 'low' END AS risk,
      CASE WHEN k IS NULL THEN 'low' WHEN k >= 2 OR n > 1 THEN 'high' ELSE 'medium' END AS confidence FROM q LEFT JOIN g USING (text_id) LEFT JOIN top USING (text_id)""",
)
def route_rules(spark, sf_dir):
    """Domain, subtopics, hints, risk and confidence of the queries, and of the documents as queries, by a table of rules."""
    docs = table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("text_id"), "text")
    rows = route(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), "text").union(docs), "text_id", "text")
    return rows.select("text_id", "domain", F.array_join("subtopics", ",").alias("subtopics"), F.array_join("hints", ",").alias("hints"), "risk", "confidence")


_T = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1)"


@query(
    "route_query_signals",
    f"""WITH w AS (SELECT item_id, text, {_T} AS w FROM benchmark)
    SELECT item_id, CAST(len(w) AS INTEGER) AS n_words, CASE WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[ñíó]') THEN 'es' WHEN regexp_matches(text, '[èéêç]') THEN 'fr' ELSE 'en' END AS lang,
      CASE WHEN len(w) < 4 THEN 'short' WHEN regexp_matches(text, '[?]') THEN 'question' ELSE 'statement' END AS shape, round(least(1.0, len(list_distinct(w)) / 12.0), 6) AS clarity FROM w""",
)
def route_query_signals(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", "text", plain_tokens(F.col("text")).alias("w"))
    t = F.col("text")
    lang = F.when(t.rlike("[äöüß]"), "de").when(t.rlike("[ñíó]"), "es").when(t.rlike("[èéêç]"), "fr").otherwise("en")
    shape = F.when(F.size("w") < 4, "short").when(t.rlike("[?]"), "question").otherwise("statement")
    return w.select("item_id", F.size("w").alias("n_words"), lang.alias("lang"), shape.alias("shape"), F.round(F.least(F.lit(1.0), F.size(F.array_distinct("w")) / 12.0), 6).alias("clarity"))


@query(
    "route_task_detection",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^(hi|hello|thanks)\\b') THEN 'small-talk' WHEN regexp_matches(lower(text), '\\?') THEN 'question' WHEN length(text) < 40 THEN 'short' ELSE 'task' END AS task FROM conversations WHERE role = 'user'""",
)
def route_task_detection(spark, sf_dir):
    low = F.lower("text")
    task = F.when(low.rlike(r"^(hi|hello|thanks)\b"), "small-talk").when(low.rlike(r"\?"), "question").when(F.length("text") < 40, "short").otherwise("task")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", task.alias("task"))


def collection_scores(spark, sf_dir) -> DataFrame:
    """item_id, source, score: how well each source's words and size suit each item.

    Sources' distinct words meet items' words in a join on words.
    """
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = d.select("source", F.explode(plain_tokens(F.col("text"))).alias("t")).where("length(t) > 3").groupBy("source", "t").agg(F.count("*").alias("n"))
    items = b.select("item_id", F.explode(F.array_distinct(plain_tokens(F.col("text")))).alias("t")).where("length(t) > 3")
    sizes = items.groupBy("item_id").agg(F.count("*").alias("k"))
    hits = items.join(words.select("source", "t"), "t").groupBy("item_id", "source").agg(F.count("*").alias("h"))
    quality = d.groupBy("source").agg((F.avg("n_chars") / 5000).alias("q"))
    rows = hits.join(sizes, "item_id").join(quality, "source")
    score = weighted_signals({"lexical": F.col("h") / F.col("k"), "quality": F.least(F.col("q"), F.lit(1.0)), "profile": F.lit(None).cast("double")})
    return rows.select("item_id", "source", F.round(score, 6).alias("score"))


_COLL = f"""w AS (SELECT source, t FROM (SELECT source, unnest({_T}) AS t FROM documents) WHERE length(t) > 3 GROUP BY ALL),
  i AS (SELECT item_id, t FROM (SELECT item_id, unnest(list_distinct({_T})) AS t FROM benchmark) WHERE length(t) > 3), k AS (SELECT item_id, count(*) AS k FROM i GROUP BY 1),
  h AS (SELECT item_id, source, count(*) AS h FROM i JOIN w USING (t) GROUP BY ALL), qu AS (SELECT source, avg(n_chars) / 5000 AS q FROM documents GROUP BY 1),
  c AS (SELECT item_id, source, round((0.25 * h / k + 0.1 * least(q, 1.0)) / 0.35, 6) AS score FROM h JOIN k USING (item_id) JOIN qu USING (source))"""


@query("route_collection_scores", f"WITH {_COLL} SELECT * FROM (SELECT item_id, source, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) AS rank FROM c) WHERE rank <= 5")
def route_collection_scores(spark, sf_dir):
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "source")
    return collection_scores(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@query(
    "route_decision",
    f"""WITH {_COLL}, r AS (SELECT item_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) AS rank FROM c), g AS (SELECT item_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM r GROUP BY 1)
    SELECT item_id, CASE WHEN a IS NULL OR a < 0.2 THEN 'no_source' WHEN a >= 0.6 AND a - coalesce(b, 0) >= 0.1 THEN 'strict' WHEN a >= 0.35 THEN 'broad' ELSE 'suggest' END AS decision FROM g""",
)
def route_decision(spark, sf_dir):
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "source")
    r = collection_scores(spark, sf_dir).withColumn("rank", F.row_number().over(w))
    g = r.groupBy("item_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    return g.select("item_id", decide(F.col("a"), F.col("b")).alias("decision"))


@query(
    "route_budget",
    """SELECT item_id, CASE WHEN length(text) > 300 THEN 'deep' WHEN length(text) > 120 THEN 'normal' ELSE 'fast' END AS mode, CASE WHEN length(text) > 300 THEN 4 WHEN length(text) > 120 THEN 3 ELSE 2 END AS sources FROM benchmark""",
)
def route_budget(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.when(n > 300, "deep").when(n > 120, "normal").otherwise("fast").alias("mode"), F.when(n > 300, 4).when(n > 120, 3).otherwise(2).alias("sources"))


@query(
    "route_adaptive_profile",
    """WITH m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1),
    s AS (SELECT vec_id, m.label AS profile, round(list_cosine_similarity(embedding::DOUBLE[], m.m), 9) AS s FROM embeddings, m)
    SELECT vec_id, profile FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, profile) AS rn FROM s) WHERE rn = 1""",
)
def route_adaptive_profile(spark, sf_dir):
    """The profile, one for each label and so few, that each vector is nearest to."""
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    m = mean.groupBy(F.col("label").alias("profile")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m"))
    s = e.crossJoin(F.broadcast(m)).select("vec_id", "profile", F.round(cosine(F.col("embedding"), F.col("m")), 9).alias("s"))
    return s.groupBy("vec_id").agg(F.max_by("profile", F.struct("s", -F.col("profile"))).alias("profile"))


@query(
    "route_source_plan",
    f"""WITH {_COLL}, r AS (SELECT item_id, source, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) AS rank, count(*) OVER (PARTITION BY item_id) AS n FROM c), g AS (SELECT item_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b, max(n) AS n FROM r GROUP BY 1)
    SELECT item_id, CASE WHEN n = 1 THEN 'single' WHEN a - coalesce(b, 0) >= 0.05 THEN 'ranked' ELSE 'guarded' END AS plan FROM g""",
)
def route_source_plan(spark, sf_dir):
    """single where one source is left, ranked where the best leads, else guarded."""
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "source")
    r = collection_scores(spark, sf_dir).withColumn("rank", F.row_number().over(w))
    g = r.groupBy("item_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"), F.count("*").alias("n"))
    gap = F.col("a") - F.coalesce("b", F.lit(0.0))
    return g.select("item_id", F.when(F.col("n") == 1, "single").when(gap >= 0.05, "ranked").otherwise("guarded").alias("plan"))
