"""Ranking of retrieved candidates: a light score before reranking, a score by rules, and a choice that covers intents.

Candidates are rows (query_id, doc_id) with their fused score, few for each query; rules are tables of the caller's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import normalized, tokens
from corvane.operators.retrieval import _HYB, _RANK, _queries, fallback_rerank, hybrid_top, named_by
from corvane.operators.windows import scaled
from corvane.session import table

#: Weights of the score by rules.
OVERLAP, TAG, INTENT, MISSING_INTENT, OFF_TOPIC, CONFLICT, MOST_INTENTS = 0.35, 0.5, 1.2, 2.0, 0.8, 2.5, 0.6
#: Weights of the score before reranking, and the vector score from which it counts.
PHRASE, ROUTE, CHANNELS, SEMANTIC, KEEP_SEMANTIC, IDENTIFIER, SHORT = 2.0, 0.35, 0.75, 3.0, 0.62, 10.0, 1.0
MODEL = 1.75
#: Intents of queries: name and markers, all of them required. A table of the caller's own takes their place.
INTENTS = [("question", ["what", "which", "how"]), ("place", ["city", "river", "capital"]), ("number", ["many", "number", "sum"]), ("work", ["write", "function", "program"])]
#: Markers that are off topic unless the query has them, and pairs of markers that conflict.
OFF_TOPICS, CONFLICTS = ["licensed", "worthless", "token"], [("what", "scum"), ("how", "idiot")]
ROUTE_TERMS = ["the", "what", "number"]


def _holds(text: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def intent_flags(text: Column, intents=INTENTS) -> Column:
    """Names of the intents whose markers the text has."""
    return F.array_compact(F.array(*[F.when(_holds(text, markers), name) for name, markers in intents]))


def rule_scored(rows: DataFrame, intents=INTENTS, off_topics=OFF_TOPICS, conflicts=CONFLICTS) -> DataFrame:
    """Adds matched (intents of the query that the card has), strict and det_score to rows of query, card, tags and fused."""
    q, c = normalized(F.col("query")), normalized(F.col("card"))
    asked = tokens(F.col("query"))
    overlap = F.size(F.filter(tokens(F.col("card")), lambda t: F.array_contains("asked", t)))
    hits = F.size(F.filter("tags", lambda t: F.contains(F.col("q"), t)))
    off = sum(F.when(F.contains(F.col("c"), F.lit(m)) & ~F.contains(F.col("q"), F.lit(m)), OFF_TOPIC).otherwise(0.0) for m in off_topics)
    against = F.lit(False)
    for a, b in conflicts:
        against = against | (F.contains(F.col("q"), F.lit(a)) & ~F.contains(F.col("q"), F.lit(b)) & F.contains(F.col("c"), F.lit(b)))
    rows = rows.withColumns({"q": q, "c": c, "asked": F.array_distinct(asked)})
    rows = rows.withColumn("wanted", intent_flags(F.col("q"), intents))
    rows = rows.withColumn("matched", F.array_intersect("wanted", intent_flags(F.col("c"), intents)))
    n, m = F.size("wanted"), F.size("matched")
    unlike = (n > 0) & (against | (m == 0))
    strict = (n == 0) | ((m >= F.greatest(F.lit(1), F.ceil(n * MOST_INTENTS))) & ~unlike)
    score = F.col("fused") + OVERLAP * overlap + TAG * hits + INTENT * m - MISSING_INTENT * (n - m) - off - F.when(unlike, CONFLICT).otherwise(0.0)
    return rows.withColumns({"strict": strict, "unlike": unlike, "det_score": score}).drop("q", "c", "asked")


def complementary(scored: DataFrame, limit: int = 4) -> DataFrame:
    """Rows of rule_scored() that are chosen: down the ranking, those that are strict or bring an intent which none before has.

    Where none is, the first limit rows. The fold runs over a query's few candidates.
    """
    keep = (F.col("det_score") > 0) | ((F.size("matched") > 0) & ~F.col("unlike"))
    item = F.struct((-F.round("det_score", 6)).alias("order"), "doc_id", "strict", "matched")
    lists = scored.where(keep).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array().cast("array<string>").alias("have"), F.array().cast("array<bigint>").alias("ids"))

    def add(state, x):
        takes = (F.size(state["ids"]) < limit) & (x["strict"] | (F.size(F.array_except(x["matched"], state["have"])) > 0))
        have = F.when(takes, F.array_union(state["have"], x["matched"])).otherwise(state["have"])
        return F.struct(have.alias("have"), F.when(takes, F.concat(state["ids"], F.array(x["doc_id"]))).otherwise(state["ids"]).alias("ids"))

    chosen = F.aggregate("items", start, add)["ids"]
    rest = F.slice(F.transform("items", lambda x: x["doc_id"]), 1, limit)
    ids = lists.select("query_id", F.when(F.size(chosen) > 0, chosen).otherwise(rest).alias("ids"))
    return ids.select("query_id", F.posexplode("ids").alias("place", "doc_id")).select("query_id", "doc_id", (F.col("place") + 1).alias("place"))


def pre_rank_score(route_terms: list[str] = ROUTE_TERMS) -> Column:
    """The light score of rows of query, title, text, lexical and vector, before any reranking."""
    both = normalized(F.concat_ws(" ", "title", "text"))
    overlap = F.size(F.filter(tokens(F.concat_ws(" ", "title", "text")), lambda t: F.array_contains(tokens(F.col("query")), t)))
    parts = F.filter(F.transform(F.split("query", r"[?.!,;:\n]+"), normalized), lambda p: F.length(p) >= 10)
    phrase = F.when(F.exists(parts, lambda p: F.contains(both, p)), PHRASE).otherwise(0.0)
    route = ROUTE * sum(F.contains(both, F.lit(t)).cast("int") for t in route_terms)
    channels = F.when((F.col("lexical") > 0) & (F.col("vector") > 0), CHANNELS).otherwise(0.0)
    semantic = F.when(F.col("vector") >= KEEP_SEMANTIC, SEMANTIC * F.col("vector")).otherwise(0.0)
    codes = F.regexp_extract_all("query", F.lit(r"[A-Z]+[0-9][A-Z0-9]{3,}"), F.lit(0))
    identifier = F.when(F.exists(codes, lambda x: F.contains(F.concat_ws(" ", "title", "text"), x)), IDENTIFIER).otherwise(0.0)
    return overlap + phrase + route + channels + semantic + identifier - F.when(F.length(F.trim("text")) < 80, SHORT).otherwise(0.0)


def _candidates(spark, sf_dir, k: int = 8) -> DataFrame:
    q = _queries(spark, sf_dir).select("query_id", F.col("text").alias("query"))
    rows = hybrid_top(spark, sf_dir, k)
    d = named_by(table(spark, sf_dir, "documents"), rows).select("doc_id", "text", "source", "lang")
    return rows.withColumnRenamed("score", "fused").join(q, "query_id").join(d, "doc_id")


def _cards(spark, sf_dir) -> DataFrame:
    card = F.concat_ws(" ", "source", "lang", "text")
    return rule_scored(_candidates(spark, sf_dir).withColumns({"card": card, "tags": F.array("source", "lang")}))


_NORM = "trim(regexp_replace(regexp_replace(lower(translate({x}, 'Iİ', 'ıi')), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TOKENS = "list_filter(string_split({x}, ' '), lambda t: length(t) > 1 OR regexp_matches(t, '[0-9]'))"


def _any_sql(x: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


_CAND = f"""{_HYB}, c0 AS (SELECT * FROM (SELECT query_id, doc_id, lexical, vector, round(score, 6) AS fused, {_RANK} AS rank FROM hyb) WHERE rank <= 8),
  cand AS (SELECT c0.*, b.text AS query, documents.text, source, lang FROM c0 JOIN (SELECT item_id AS query_id, text FROM benchmark) b USING (query_id) JOIN documents USING (doc_id))"""
_DET = f"""{_CAND}, n1 AS (SELECT *, {_NORM.format(x="query")} AS nq, {_NORM.format(x="source || ' ' || lang || ' ' || text")} AS nc FROM cand),
  n2 AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_any_sql('nq', m)} THEN '{n}' END" for n, m in INTENTS)}], lambda x: x IS NOT NULL) AS wanted,
    list_filter([{", ".join(f"CASE WHEN {_any_sql('nc', m)} THEN '{n}' END" for n, m in INTENTS)}], lambda x: x IS NOT NULL) AS has FROM n1),
  n3 AS (SELECT *, len(wanted) AS n, len(list_intersect(wanted, has)) AS m, {" OR ".join(f"(contains(nq, '{a}') AND NOT contains(nq, '{b}') AND contains(nc, '{b}'))" for a, b in CONFLICTS)} AS against FROM n2),
  n4 AS (SELECT *, n > 0 AND (against OR m = 0) AS unlike FROM n3),
  det AS (SELECT query_id, doc_id, fused, query, text, source, CAST(m AS INTEGER) AS matched, n = 0 OR (m >= greatest(1, ceil(n * 0.6)) AND NOT unlike) AS strict,
    fused + 0.35 * len(list_filter({_TOKENS.format(x="nc")}, lambda t: list_contains({_TOKENS.format(x="nq")}, t))) + 0.5 * (CASE WHEN contains(nq, source) THEN 1 ELSE 0 END + CASE WHEN contains(nq, lang) THEN 1 ELSE 0 END)
      + 1.2 * m - 2 * (n - m) - ({" + ".join(f"CASE WHEN contains(nc, '{x}') AND NOT contains(nq, '{x}') THEN 0.8 ELSE 0 END" for x in OFF_TOPICS)}) - CASE WHEN unlike THEN 2.5 ELSE 0 END AS det FROM n4)"""


@query("retrieve_det_rerank", f"WITH {_DET} SELECT query_id, doc_id, matched, strict, round(det, 6) AS score FROM det")
def retrieve_det_rerank(spark, sf_dir):
    """The score by rules: the fused one, words and tags in common, intents met and missed, off-topic marks and conflicts."""
    rows = _cards(spark, sf_dir)
    return rows.select("query_id", "doc_id", F.size("matched").alias("matched"), "strict", F.round("det_score", 6).alias("score"))


@query("retrieve_complementary")
def retrieve_complementary(spark, sf_dir):
    """Up to four candidates of each query that together cover its intents; tests hold the choice against a loop."""
    return complementary(_cards(spark, sf_dir))


_PLAIN = "list_distinct(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1))"


@query(
    "retrieve_rerank",
    f"""WITH {_DET}, m0 AS (SELECT *, {_PLAIN.format(x="query")} AS a, {_PLAIN.format(x="text")} AS b, {_PLAIN.format(x="source")} AS ti FROM det),
    m1 AS (SELECT query_id, doc_id, det, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) + CASE WHEN contains(lower(text), lower(trim(query))) THEN 0.25 ELSE 0 END
      + CASE WHEN len(list_intersect(a, ti)) > 0 THEN 0.15 ELSE 0 END AS model FROM m0),
    s AS (SELECT *, CASE WHEN max(det) OVER w - min(det) OVER w < 1e-9 THEN 0.5 ELSE (det - min(det) OVER w) / (max(det) OVER w - min(det) OVER w) END AS x,
      CASE WHEN max(model) OVER w - min(model) OVER w < 1e-9 THEN 0.5 ELSE (model - min(model) OVER w) / (max(model) OVER w - min(model) OVER w) END AS y FROM m1 WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, doc_id, round(x + 1.75 * y, 4) AS score FROM s""",
)
def retrieve_rerank(spark, sf_dir):
    """The scaled score by rules and 1.75 of the scaled score of the model, here its token-overlap fallback."""
    from corvane.functions.text import plain_tokens

    asked = F.array_distinct(plain_tokens(F.col("query")))
    rows = _cards(spark, sf_dir).withColumn("model", fallback_rerank(asked, F.col("text"), F.col("source"), F.lower(F.trim("query"))))
    both = scaled(scaled(rows, "query_id", "det_score", "x"), "query_id", "model", "y")
    return both.select("query_id", "doc_id", F.round(F.col("x") + MODEL * F.col("y"), 4).alias("score"))


_BOTH = _NORM.format(x="source || ' ' || text")


@query(
    "retrieve_prerank",
    f"""WITH {_CAND}, pre AS (SELECT *, {_BOTH} AS b, {_NORM.format(x="query")} AS nq FROM cand),
    s AS (SELECT query_id, doc_id, len(list_filter({_TOKENS.format(x="b")}, lambda t: list_contains({_TOKENS.format(x="nq")}, t)))
      + CASE WHEN len(list_filter(string_split_regex(query, '[?.!,;:\\n]+'), lambda x: length({_NORM.format(x="x")}) >= 10 AND contains(b, {_NORM.format(x="x")}))) > 0 THEN 2 ELSE 0 END
      + 0.35 * ({" + ".join(f"CASE WHEN contains(b, '{t}') THEN 1 ELSE 0 END" for t in ROUTE_TERMS)}) + CASE WHEN lexical > 0 AND vector > 0 THEN 0.75 ELSE 0 END + CASE WHEN vector >= 0.62 THEN 3 * vector ELSE 0 END
      + CASE WHEN len(list_filter(regexp_extract_all(query, '[A-Z]+[0-9][A-Z0-9]{{3,}}'), lambda x: contains(source || ' ' || text, x))) > 0 THEN 10 ELSE 0 END - CASE WHEN length(trim(text)) < 80 THEN 1 ELSE 0 END AS score FROM pre)
    SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM s WHERE score > 0""",
)
def retrieve_prerank(spark, sf_dir):
    """Candidates by the light score: words and phrases in common, route terms, channels, semantics, identifiers; short texts less."""
    rows = _candidates(spark, sf_dir).withColumn("title", F.col("source"))
    scored = rows.select("query_id", "doc_id", F.round(pre_rank_score(), 4).alias("score")).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
