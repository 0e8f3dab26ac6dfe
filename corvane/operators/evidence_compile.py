"""Evidence of answers compiled: facts that disagree, coverage of requested fields, confidence, sufficiency and readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.terms import folded
from corvane.session import table
from corvane.storage import stored

#: Words of contradiction, limits of an answer's evidence, points of confidence and coverage.
CONTRADICTION = r"(?iu)(çeliş|celis|contradict|conflict|tutarsız|tutarsiz|uyuşmuyor|uyusmuyor)"
LIMITS = {"fact": 5, "structured": 5, "risk": 3, "unknown": 4, "source": 8}
POINTS = {"high": 0.9, "medium": 0.62, "low": 0.28}
COVERED = {"complete": 0.08, "partial": -0.12, "none": -0.3}
CONTRADICTED = 0.25
#: Tokens of a requested field that a fact must have: all of two or fewer, else this share.
FIELD_SHARE = 0.75
#: Fields in conflict that the report of an answer names; the count has all.
NAMED_CONFLICTS = 8
#: Groups of keys, by hash, whose facts are counted, and facts of a group from which its keys are dealt into ranges.
KEY_GROUPS, MOST_FACTS = 65_536, 2_000_000


def prefix_max(rows: DataFrame, key: str, order: str, rest: list[str], value: str, name: str, own: bool) -> DataFrame:
    """Adds name, the largest value among the rows of key before a row by order and rest, or up to it with own.

    Rows are dealt into ranges of order, a number, between bounds that are fixed first; of other ranges only the largest value counts,
    so a key with most of the rows is the work of many tasks.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    bounds = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)]).alias("b")).first().b or []
    below = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>")
    ranged = rows.withColumn("_range", F.size(F.filter(below, lambda b: b < F.col(order))))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy(key, "_range").agg(F.max(value).alias("_m")).select(key, "_range", F.max("_m").over(earlier).alias("_base"))
    inside = Window.partitionBy(key, "_range").orderBy(order, *rest).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    at = ranged.withColumn("_at", F.max(value).over(inside))
    return at.join(bases, [key, "_range"]).withColumn(name, F.greatest("_at", "_base")).drop("_range", "_at", "_base")


def _large(rows: DataFrame, by: list[str]) -> Column | None:
    """Whether a row's key is in a group of more than MOST_FACTS rows; None if no group is."""
    group = F.pmod(F.xxhash64(*by), F.lit(KEY_GROUPS)).cast("int")
    # at most KEY_GROUPS numbers
    large = [x.g for x in rows.groupBy(group.alias("g")).agg(F.count("*").alias("c")).where(F.col("c") > MOST_FACTS).select("g").collect()]
    return group.isin(large) if large else None


def _sound(facts: DataFrame, by: list[str]) -> DataFrame:
    """by (as strings, null as ''), low and high of the facts that have two finite bounds, the smaller one first."""

    def sound(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    cast = facts.withColumns({"low": F.col("low").cast("double"), "high": F.col("high").cast("double")}).where(sound("low") & sound("high"))
    return cast.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by), F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))


def _summed(seen: DataFrame, by: list[str]) -> DataFrame:
    """conflicts() of intervals (by..., low, high, n) with before, the largest high of earlier ones of their key, and its least high and most low."""
    start = (F.col("before").isNull() | (F.col("low") > F.col("before"))).cast("long")
    apart = F.when((F.col("low") > F.col("least")) | (F.col("high") < F.col("most")), F.col("n")).otherwise(0)
    whole = seen.groupBy(*by).agg(
        F.sum("n").alias("facts"), F.count("*").alias("readings"), F.sum(start).alias("camps"), F.first("least").alias("least"), F.first("most").alias("most"), F.sum(apart).alias("disagreeing")
    )
    return whole.withColumn("in_conflict", F.col("most") > F.col("least"))


def _swept(rows: DataFrame, by: list[str]) -> DataFrame:
    """conflicts() of _sound() rows, those of a key in one task: they are shuffled once, by key."""
    held = rows.repartition(*by).groupBy(*by, "low", "high").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    key = Window.partitionBy(*by)
    seen = held.withColumns({"before": F.max("high").over(before), "least": F.min("high").over(key), "most": F.max("low").over(key)})
    return _summed(seen, by)


def _swept_in_ranges(rows: DataFrame, by: list[str]) -> DataFrame:
    """conflicts() of _sound() rows, those of a key dealt into ranges of low."""
    held = stored(rows.groupBy(F.struct(*by).alias("k"), "low", "high").agg(F.count("*").alias("n")), "intervals")
    seen = prefix_max(held, "k", "low", ["high"], "high", "before", False)
    ends = held.groupBy("k").agg(F.min("high").alias("least"), F.max("low").alias("most"))
    whole = _summed(seen.join(ends, "k"), ["k"])
    return whole.select("k.*", *whole.columns[1:])


def conflicts(facts: DataFrame, by: list[str]) -> DataFrame:
    """by, facts, readings, camps, least, most, disagreeing, in_conflict of facts (by..., low, high): one row a key.

    A fact says that the value lies from low to high. Two facts of a key disagree if their intervals have no point in common. In a
    key there are such two just if its largest low is above its smallest high, and the facts that disagree with some other are those that begin above the
    smallest high or end below the largest low: no pair is formed. disagreeing counts them, readings the distinct intervals, camps the
    groups that chains of overlapping intervals make, by a sweep. Bounds may be swapped; without two finite ones a fact takes no part, a null in by is ''.

    Facts are counted in KEY_GROUPS groups of keys first. Keys of groups with more than MOST_FACTS are swept in ranges, by many tasks; the facts of all
    others are shuffled once.
    """
    rows = _sound(facts, by)
    large = _large(rows, by)
    if large is None:
        return _swept(rows, by)
    return _swept(rows.where(~large), by).unionByName(_swept_in_ranges(rows.where(large), by))


def field_matches(field: Column, fact: Column) -> Column:
    """Whether a folded fact's text has a folded requested field, or its words: both of two, three quarters of more (words of three letters or more)."""
    words = F.array_distinct(F.filter(F.split(field, " "), lambda w: F.length(w) >= 3))
    met = F.size(F.array_intersect(words, F.split(fact, " ")))
    enough = F.when(F.size(words) <= 2, met == F.size(words)).otherwise(met >= F.ceil(F.size(words) * FIELD_SHARE))
    return (field != "") & (fact != "") & (F.contains(fact, field) | ((F.size(words) > 0) & enough))


def _key(text: Column) -> Column:
    return F.lower(F.translate(F.trim(text), "Iİ", "ıi"))


def _first(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The most first rows of by in the order of at and key."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("at", "key"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def compiled(
    requests: DataFrame, texts: DataFrame, facts: DataFrame, medium_facts: int = 1, high_facts: int = 1, medium_source: bool = False, high_source: bool = False, contradicted_low: bool = True
) -> DataFrame:
    """One row for each answer of requests: its evidence counted, judged and found ready or not.

    requests: answer_id, grounding (high, medium, low), fields array<string>. texts: answer_id, at, channel (fact, risk, unknown), text.
    facts: answer_id, at, source_id, subject, field, value, unit, low, high, quote; low and high as in conflicts(). Repeats (without regard to case) count once, the first by at; of
    each channel LIMITS are used. Contradictions are texts of any channel with a word of CONTRADICTION, and the keys of
    subject, field and unit whose facts disagree, whether among the used ones or not. Nulls: texts and fields are left out, a grounding is low, an answer_id has no row.

    Columns: answer_id, text_facts, structured_facts, risks, unknowns, sources, contradictions, conflict_fields, covered, missing, coverage, confidence,
    reason, score, sufficiency, should_answer, mode. What an answer gathers in one place is bounded by LIMITS and by the fields it asks for.
    """
    asked = requests.where("answer_id is not null").select(
        "answer_id", F.when(F.col("grounding").isin("high", "medium"), F.col("grounding")).otherwise("low").alias("grounding"),
        F.array_distinct(F.filter(F.transform(F.coalesce("fields", F.array().cast("array<string>")), lambda f: F.trim(f)), lambda f: f.isNotNull() & (f != ""))).alias("fields"),
    )
    said = texts.where("text is not null").groupBy("answer_id", "channel", _key(F.col("text")).alias("key")).agg(F.bool_or(F.col("text").rlike(CONTRADICTION)).alias("against")).where("key <> ''")
    spoken = said.groupBy("answer_id").agg(
        *(F.least(F.count_if(F.col("channel") == c), F.lit(LIMITS[c])).alias(n) for c, n in (("fact", "text_facts"), ("risk", "risks"), ("unknown", "unknowns"))),
        F.count_distinct(F.when(F.col("against"), F.col("key"))).alias("words_against"),
    )
    parts = ["source_id", "field", "value", "quote"]
    told = F.concat_ws("|", *(F.coalesce(_key(F.col(c).cast("string")), F.lit("")) for c in parts))
    large = _large(facts, ["answer_id"])
    # an answer's facts lie together, those of one with very many in parts, so each part's first ones alone are shuffled again
    dealt, whole = facts.select("answer_id", told.alias("key"), "subject", "field", "value", "unit", "at"), ["answer_id"]
    if large is not None:
        dealt, whole = dealt.withColumn("part", F.when(large, F.pmod(F.xxhash64("key"), F.lit(KEY_GROUPS)).cast("int")).otherwise(0)), ["answer_id", "part"]
    once = dealt.repartition(*whole).groupBy(*whole, "key").agg(F.min_by(F.struct("subject", "field", "value", "unit"), "at").alias("f"), F.min("at").alias("at"))
    used = _first(once, ["answer_id"], LIMITS["structured"]).groupBy("answer_id").agg(
        F.sort_array(F.collect_list(F.struct("at", F.col("f.field").alias("field"), folded(F.concat_ws(" ", "f.subject", "f.field", "f.value", "f.unit")).alias("t")))).alias("used")
    )
    named = facts.where("source_id is not null").select("answer_id", "source_id").distinct()  # a sketch for each answer and task would be larger
    sources = named.groupBy("answer_id").agg(F.least(F.count("*"), F.lit(LIMITS["source"])).alias("sources"))
    apart = conflicts(facts, ["answer_id", "subject", "field", "unit"]).where("in_conflict").groupBy("answer_id", "field").agg(F.count("*").alias("n"))
    at_most = F.row_number().over(Window.partitionBy("answer_id").orderBy("field"))
    apart = apart.withColumn("r", at_most).groupBy("answer_id").agg(
        F.sum("n").alias("facts_against"), F.sort_array(F.collect_list(F.when(F.col("r") <= NAMED_CONFLICTS, F.col("field")))).alias("conflict_fields")
    )
    apart = apart.withColumn("answer_id", F.col("answer_id").cast(asked.schema["answer_id"].dataType))
    joined = reduce(lambda a, b: a.join(b, "answer_id", "left"), [spoken, used, sources, apart], asked)
    counts = ["text_facts", "risks", "unknowns", "words_against", "sources", "facts_against"]
    rows = joined.fillna(0, counts).withColumns(
        {"used": F.coalesce("used", F.array().cast(used.schema["used"].dataType)), "conflict_fields": F.coalesce("conflict_fields", F.array().cast("array<string>"))}
    )
    covered = F.filter("fields", lambda f: F.exists("used", lambda u: field_matches(folded(f), u["t"])))
    own = F.array_distinct(F.filter(F.transform("used", lambda u: F.trim(u["field"])), lambda f: f.isNotNull() & (f != "")))
    none_asked = F.size("fields") == 0
    rows = rows.withColumns(
        {"structured_facts": F.size("used"), "contradictions": F.col("words_against") + F.col("facts_against"), "covered": F.when(none_asked, own).otherwise(covered)}
    ).withColumns({"missing": F.array_except("fields", "covered"), "grounds": F.greatest("text_facts", "structured_facts")})
    coverage = (
        F.when(none_asked, F.when(F.col("grounds") > 0, "complete").otherwise("none")).when(F.size("missing") == 0, "complete").when((F.size("covered") > 0) | (F.col("grounds") > 0), "partial").otherwise("none")
    )
    some_medium = (F.col("grounds") >= medium_facts) & (F.lit(not medium_source) | (F.col("sources") > 0))
    some_high = (F.col("grounds") >= high_facts) & (F.lit(not high_source) | (F.col("sources") > 0))
    wants_high, wants_medium = F.col("grounding") == "high", F.col("grounding") == "medium"
    reason = (
        F.when(F.lit(contradicted_low) & (F.col("contradictions") > 0), "contradiction").when(F.col("grounds") == 0, "no_usable_facts")
        .when(wants_high & some_high, "grounding_high").when(wants_high & some_medium, "high_requirements_not_met")
        .when(wants_medium & some_medium, "grounding_medium").when(wants_high | wants_medium, "medium_requirements_not_met").otherwise("grounding_low")
    )
    level = F.when(F.col("reason") == "grounding_high", "high").when(F.col("reason").isin("grounding_medium", "high_requirements_not_met"), "medium").otherwise("low")
    rows = rows.withColumns({"coverage": coverage, "reason": reason}).withColumn("confidence", level)
    against = F.col("contradictions") > 0
    points = reduce(lambda c, p: c.when(F.col("confidence") == p[0], p[1]), POINTS.items(), F.when(F.lit(False), 0.0))
    moved = reduce(lambda c, p: c.when(F.col("coverage") == p[0], p[1]), COVERED.items(), F.when(F.lit(False), 0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points + moved - F.when(against, CONTRADICTED).otherwise(0.0))), 3)
    enough = F.when(against, "contradictory").when(F.col("grounds") == 0, "insufficient").when(F.col("coverage") == "partial", "partial").otherwise("sufficient")
    answer = F.col("grounds") > 0
    mode = F.when(against, "contradiction").when(~answer, "no_source").when(F.col("coverage") == "partial", "partial_answer").otherwise("answer")
    return rows.select(
        "answer_id", "text_facts", "structured_facts", "risks", "unknowns", "sources", "contradictions", "conflict_fields", "covered", "missing", "coverage",
        "confidence", "reason", score.alias("score"), enough.alias("sufficiency"), answer.alias("should_answer"), mode.alias("mode"),
    )


_READINGS = """f AS (SELECT l_partkey AS answer_id, l_suppkey, field, l_orderkey * 100 + l_linenumber * 2 + CAST(field = 'tax' AS INTEGER) AS pos, CASE field WHEN 'tax' THEN l_tax ELSE l_discount END AS v FROM lineitem, (VALUES ('discount'), ('tax')) AS x(field)),
    i AS (SELECT answer_id, l_suppkey, field, round(v - 0.02, 2) AS low, round(v + 0.02, 2) AS high, count(*) AS n FROM f GROUP BY ALL),
    e AS (SELECT *, min(high) OVER w AS least, max(low) OVER w AS most, max(high) OVER (PARTITION BY answer_id, l_suppkey, field ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i WINDOW w AS (PARTITION BY answer_id, l_suppkey, field)),
    c AS (SELECT answer_id, l_suppkey, field, CAST(sum(n) AS BIGINT) AS facts, count(*) AS readings, count(*) FILTER (before IS NULL OR low > before) AS camps, any_value(least) AS least, any_value(most) AS most, CAST(sum(CASE WHEN low > least OR high < most THEN n ELSE 0 END) AS BIGINT) AS disagreeing FROM e GROUP BY ALL)"""


def _readings(spark, sf_dir) -> DataFrame:
    """What the lines of a part say of its discount and tax at each supplier, give or take 0.02."""
    field = F.explode(F.array(F.lit("discount"), F.lit("tax")))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_discount", "l_tax", field.alias("field"))
    tax = F.col("field") == "tax"
    v = F.when(tax, F.col("l_tax")).otherwise(F.col("l_discount"))
    return lines.select(
        F.col("l_partkey").alias("answer_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 2 + tax.cast("int")).alias("at"), F.col("l_suppkey").cast("string").alias("source_id"),
        F.col("l_suppkey").cast("string").alias("subject"), "field", v.cast("string").alias("value"), F.lit("share").alias("unit"), F.round(v - 0.02, 2).alias("low"), F.round(v + 0.02, 2).alias("high"), F.lit("").alias("quote"),
    )


@query(
    "evidence_conflicts",
    f"""WITH {_READINGS} SELECT answer_id, CAST(l_suppkey AS VARCHAR) AS subject, field, facts, readings, camps, least, most, disagreeing, most > least AS in_conflict FROM c""",
)
def evidence_conflicts(spark, sf_dir):
    """Which parts' discounts and taxes at a supplier disagree between lines."""
    c = conflicts(_readings(spark, sf_dir), ["answer_id", "subject", "field", "unit"])
    return c.select(F.col("answer_id").cast("long").alias("answer_id"), "subject", "field", "facts", "readings", "camps", "least", "most", "disagreeing", "in_conflict")


@query(
    "evidence_compiled",
    f"""WITH {_READINGS},
    a AS (SELECT p_partkey AS answer_id, CASE WHEN p_size <= 15 THEN 'high' WHEN p_size <= 35 THEN 'medium' ELSE 'low' END AS grounding, CASE WHEN p_size < 10 THEN [] WHEN p_retailprice > 1500 THEN ['discount', 'warranty term'] ELSE ['discount', 'tax'] END AS fields,
      1 AS text_facts, CAST(p_size > 40 AS INTEGER) AS risks, CAST(p_retailprice < 1000 AS INTEGER) AS unknowns FROM part),
    o AS (SELECT answer_id, l_suppkey, field, v, min(pos) AS pos FROM f GROUP BY ALL),
    u AS (SELECT answer_id, count(*) AS k, list(DISTINCT field) AS has FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS r FROM o) WHERE r <= 5 GROUP BY 1),
    x AS (SELECT answer_id, count(*) AS against FROM c WHERE most > least GROUP BY 1),
    j AS (SELECT answer_id, grounding, fields, text_facts, risks, unknowns, coalesce(k, 0) AS structured_facts, coalesce(against, 0) AS contradictions, len(list_filter(fields, lambda z: list_contains(coalesce(has, []), z))) AS n_covered FROM a LEFT JOIN u USING (answer_id) LEFT JOIN x USING (answer_id)),
    g AS (SELECT *, CASE WHEN len(fields) = 0 OR n_covered = len(fields) THEN 'complete' ELSE 'partial' END AS coverage, CASE WHEN contradictions > 0 THEN 'low' ELSE grounding END AS confidence FROM j)
    SELECT answer_id, text_facts, structured_facts, risks, unknowns, contradictions, coverage, confidence, CASE WHEN contradictions > 0 THEN 'contradiction' ELSE 'grounding_' || grounding END AS reason,
    round(greatest(0.0, least(1.0, CASE confidence WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.62 ELSE 0.28 END + CASE coverage WHEN 'complete' THEN 0.08 ELSE -0.12 END - CASE WHEN contradictions > 0 THEN 0.25 ELSE 0 END)), 3)::DOUBLE AS score,
    CASE WHEN contradictions > 0 THEN 'contradictory' WHEN coverage = 'partial' THEN 'partial' ELSE 'sufficient' END AS sufficiency, CASE WHEN contradictions > 0 THEN 'contradiction' WHEN coverage = 'partial' THEN 'partial_answer' ELSE 'answer' END AS mode FROM g""",
)
def evidence_compiled(spark, sf_dir):
    """Every part as an answer: its name, type and brand as texts, its lines' discounts and taxes as facts."""
    p = table(spark, sf_dir, "part")
    grounding = F.when(F.col("p_size") <= 15, "high").when(F.col("p_size") <= 35, "medium").otherwise("low")
    asks = F.when(F.col("p_size") < 10, F.array().cast("array<string>")).when(F.col("p_retailprice") > 1500, F.array(F.lit("discount"), F.lit("warranty term"))).otherwise(F.array(F.lit("discount"), F.lit("tax")))
    requests = p.select(F.col("p_partkey").alias("answer_id"), grounding.alias("grounding"), asks.alias("fields"))
    channels = F.array(
        F.struct(F.lit("fact").alias("channel"), F.col("p_name").alias("text")), F.struct(F.lit("risk").alias("channel"), F.when(F.col("p_size") > 40, F.col("p_type")).alias("text")),
        F.struct(F.lit("unknown").alias("channel"), F.when(F.col("p_retailprice") < 1000, F.col("p_brand")).alias("text")),
    )
    texts = p.select(F.col("p_partkey").alias("answer_id"), F.lit(0).alias("at"), F.inline(channels))
    c = compiled(requests, texts, _readings(spark, sf_dir))
    return c.select("answer_id", *(F.col(n).cast("long").alias(n) for n in ("text_facts", "structured_facts", "risks", "unknowns", "contradictions")), "coverage", "confidence", "reason", "score", "sufficiency", "mode")
