"""Evidence: extraction from sentences and tables, bundles, coverage, findings and safety rails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.numbers import local_number, unit_of
from corvane.functions.text import _LOW, concept, plain_tokens, sentences
from corvane.session import table

#: Confidence of table facts and its levels.
FACT_BASE, FACT_VALUE, HIGH, MEDIUM = 0.45, 0.35, 0.78, 0.48
NUMBER = r"[0-9][0-9.,]*[0-9]|[0-9]"
#: Rails: id, pattern, severity.
RAILS = [("pii", r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", 2), ("secret", r"AKIA[A-Z0-9]{16}", 3), ("insult", r"(?i)\b(idiot|moron|worthless|loser)\b", 1)]


def evidence_items(docs: DataFrame) -> DataFrame:
    """doc_id, at, kind, text of the sentences that can serve as evidence."""
    s = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("at", "text"))
    kind = F.when(F.col("text").rlike("[0-9]"), "numeric").when(F.col("text").rlike(r"^([-*•]|[0-9]+[.)]) "), "step").when(F.length("text") >= 80, "statement")
    return s.withColumn("kind", kind).where("kind is not null")


def fact_confidence(label: Column, value: Column, unit: Column) -> Column:
    score = F.lit(FACT_BASE) + F.when(value.isNotNull(), FACT_VALUE).otherwise(0.0) + F.when(unit.isNotNull(), 0.1).otherwise(0.0) - F.when(F.length(label) < 3, 0.1).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 4)


def markdown_cells(tables: DataFrame) -> DataFrame:
    """id, row, col, header, cell, value of Markdown tables (id, markdown); the second line is the rule under the header."""
    lines = tables.select("id", F.split(F.trim("markdown"), "\n").alias("l")).where("size(l) > 2")

    def cells(line):
        return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))

    rows = lines.select("id", cells(F.element_at("l", 1)).alias("h"), F.posexplode(F.slice("l", 3, F.size("l") - 2)).alias("row", "line"))
    each = rows.select("id", "row", "h", F.posexplode(cells(F.col("line"))).alias("col", "cell"))
    return each.select("id", "row", "col", F.try_element_at("h", F.col("col") + 1).alias("header"), "cell", local_number(F.col("cell")).alias("value"))


#: Words that name no field.
FIELD_STOP = "a an and bu de field gore hangi icin ile in is kaynak mi mu ne nedir of olan the ve".split()
#: Fields that are looked for in documents: id, names.
FIELDS = [
    ("licence", ["licence terms", "licensed under", "license"]),
    ("rights", ["all rights reserved", "copyright notice"]),
    ("secret", ["secret access key", "password"]),
    ("contact", ["contact e-mail address of the person", "phone number"]),
]


def names_field(fact: Column, words: Column, field: Column) -> Column:
    """Whether a folded fact with its words speaks of a field: holds its name whole, or enough of the name's telling words.

    One or two telling words must all be there, of more three quarters; a name without any must be there whole.
    """
    wanted = concept(field)
    telling = F.filter(F.split(wanted, " "), lambda w: ~w.isin(FIELD_STOP) & ((F.length(w) >= 3) | ((F.length(w) == 2) & w.rlike("[0-9]"))))
    found = F.size(F.filter(telling, lambda w: F.array_contains(words, w)))
    enough = F.when(F.size(telling) <= 2, F.size(telling)).otherwise(F.ceil(F.size(telling) * 0.75))
    return (wanted != "") & (fact.contains(wanted) | ((F.size(telling) > 0) & (found >= enough)))


def requested_fields(facts: DataFrame, text: str, fields: list[tuple[str, list[str]]]) -> DataFrame:
    """facts with fields (ids of those a fact speaks of, in the order given) and coverage, their share; a null text speaks of none."""
    folded = facts.withColumn("_low", F.coalesce(concept(F.col(text)), F.lit(""))).withColumn("_words", F.split("_low", " "))
    hits = []
    for name, names in fields:
        hit = F.lit(False)
        for n in names:
            hit = hit | names_field(F.col("_low"), F.col("_words"), F.lit(n))
        hits.append(F.when(hit, name))
    found = folded.withColumn("fields", F.array_compact(F.array(*hits)))
    return found.withColumn("coverage", F.round(F.size("fields") / len(fields), 6)).drop("_low", "_words")


#: Rails by name, what breaking one does, and what the answer falls back to.
GATE = [
    ("EMPTY_ANSWER", "rewrite", "domain_safe"),
    ("MISSING_SOURCES", "rewrite", "low_grounding"),
    ("SUGGEST_MODE_NO_GROUNDED_SOURCES", "warn", "source_suggestion"),
    ("NO_SOURCE_MODE_WITH_SOURCES", "rewrite", "domain_safe"),
    ("TOO_MANY_CONTEXT_CHUNKS_FOR_3B", "warn", None),
    ("QUERY_SOURCE_MISMATCH", "rewrite", "source_suggestion"),
    ("NO_USABLE_FACTS", "rewrite", "low_grounding"),
    ("SOURCE_METADATA_MISMATCH", "rewrite", "privacy_safe"),
    ("PRIVATE_SOURCE_SCOPE_MISMATCH", "block", "privacy_safe"),
]
#: Most candidates that a small model's context should hold.
CONTEXT_MOST = 4


def safety_gate(answers: DataFrame) -> DataFrame:
    """answers with reasons (rails that ask for a rewrite or block), warnings, status (the gravest) and fallback.

    Signals of an answer: answer, retrieved (boolean), mode, grounding, candidates, failed (the sources don't fit the query),
    dropped (how many candidates didn't), usable (facts), and arrays of ids: sources, cited, collections, accessible. A null
    signal breaks no rail, but for a null answer, which is empty.
    """
    sources, cited = F.size(F.coalesce("sources", F.array())), F.size(F.coalesce("cited", F.array()))
    failed, dropped = F.coalesce("failed", F.lit(False)), F.coalesce("dropped", F.lit(0)) > 0
    broken = {
        "EMPTY_ANSWER": F.trim(F.coalesce("answer", F.lit(""))) == "",
        "MISSING_SOURCES": F.col("retrieved") & (sources == 0),
        "SUGGEST_MODE_NO_GROUNDED_SOURCES": (F.col("mode") == "suggest") & (sources == 0),
        "NO_SOURCE_MODE_WITH_SOURCES": (F.col("mode") == "no_source") & (sources > 0),
        "TOO_MANY_CONTEXT_CHUNKS_FOR_3B": F.col("candidates") > CONTEXT_MOST,
        "QUERY_SOURCE_MISMATCH": failed | dropped,
        "NO_USABLE_FACTS": F.col("retrieved") & (F.col("usable") == 0),
        "SOURCE_METADATA_MISMATCH": F.col("retrieved") & (cited > 0) & (sources > 0) & (F.size(F.array_except("cited", "sources")) > 0),
        "PRIVATE_SOURCE_SCOPE_MISMATCH": (F.size("accessible") > 0) & (F.size(F.array_except("collections", "accessible")) > 0),
    }
    marked = answers.withColumn(
        "_rails",
        F.array_compact(
            F.array(
                *[
                    F.when(
                        broken[name],
                        F.struct(
                            F.lit(name).alias("id"),
                            # candidates that were dropped from sources that fit otherwise only warn
                            (F.when(~failed, "warn").otherwise(does) if name == "QUERY_SOURCE_MISMATCH" else F.lit(does)).alias("does"),
                            F.lit(instead).cast("string").alias("instead"),
                        ),
                    )
                    for name, does, instead in GATE
                ]
            )
        ),
    )
    grave = F.filter("_rails", lambda r: r["does"] != "warn")
    ids = F.transform("_rails", lambda r: r["id"])

    def any_is(does):
        return F.exists("_rails", lambda r: r["does"] == does)

    status = F.when(any_is("block"), "block").when(any_is("rewrite"), "rewrite").when(F.size("_rails") > 0, "warn").otherwise("pass")
    fallback = (
        F.when(F.array_contains(ids, "PRIVATE_SOURCE_SCOPE_MISMATCH"), "privacy_safe")
        .when(F.col("mode") == "suggest", "source_suggestion")
        .when((F.col("grounding") == "low") | F.array_contains(ids, "NO_USABLE_FACTS"), "low_grounding")
        .when(F.size(grave) > 0, F.coalesce(F.try_element_at(F.transform(grave, lambda r: r["instead"]), F.lit(1)), F.lit("domain_safe")))
    )
    made = {"reasons": F.transform(grave, lambda r: r["id"]), "warnings": F.transform(F.filter("_rails", lambda r: r["does"] == "warn"), lambda r: r["id"])}
    return marked.withColumns(made | {"status": status, "fallback": fallback}).drop("_rails")


_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"


@query(
    "evidence_items",
    f"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS t FROM documents), k AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[0-9]') THEN 'numeric' WHEN regexp_matches(t, '^([-*•]|[0-9]+[.)]) ') THEN 'step' WHEN length(t) >= 80 THEN 'statement' END AS kind FROM s)
    SELECT doc_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL""",
)
def evidence_items_query(spark, sf_dir):
    return evidence_items(table(spark, sf_dir, "documents")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(
    "evidence_bundles",
    f"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS t, generate_subscripts({_SENT}, 1) - 1 AS i FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM s WHERE regexp_matches(t, '[0-9]'))
    SELECT doc_id, count(*) AS items, md5(string_agg(t, chr(10) ORDER BY i) FILTER (rn <= 8)) AS bundle_md5 FROM r GROUP BY 1""",
)
def evidence_bundles(spark, sf_dir):
    """The first eight numeric sentences of each document, in order."""
    i = evidence_items(table(spark, sf_dir, "documents")).where("kind = 'numeric'")
    g = i.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))
    text = F.array_join(F.transform(F.slice("x", 1, 8), lambda e: e["text"]), "\n")
    return g.select("doc_id", F.size("x").cast("long").alias("items"), F.md5(text.cast("binary")).alias("bundle_md5"))


@query(
    "evidence_numeric_facts",
    f"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '{NUMBER}')) AS x FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT x) AS distinct_values, max(length(x)) AS longest FROM n GROUP BY 1""",
)
def evidence_numeric_facts(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("x"))
    return n.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("x").alias("distinct_values"), F.max(F.length("x")).cast("long").alias("longest"))


@query(
    "evidence_table_facts",
    """SELECT p_partkey, unnest(['name', 'size', 'price']) AS header, unnest([CAST(NULL AS DOUBLE), CAST(p_size AS DOUBLE), p_retailprice]) AS value, unnest([0.45, 0.8, 0.8]::DOUBLE[]) AS confidence FROM part""",
)
def evidence_table_facts(spark, sf_dir):
    """Parts written as Markdown tables, read back as typed facts."""
    md = F.concat(F.lit("| name | size | price |\n|---|---|---|\n| "), F.regexp_replace("p_name", "[0-9|]", "x"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" | "), F.format_number("p_retailprice", 2), F.lit(" |"))
    cells = markdown_cells(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), md.alias("markdown")))
    conf = fact_confidence(F.col("header"), F.col("value"), unit_of(F.lit("")))
    return cells.select(F.col("id").alias("p_partkey"), "header", "value", conf.alias("confidence"))


@query(
    "evidence_field_coverage",
    """WITH f AS (SELECT conv_id, count(DISTINCT role) AS found FROM conversations GROUP BY 1) SELECT conv_id, round(found / 3.0, 6) AS coverage, CASE WHEN found >= 3 THEN 'complete' WHEN found = 2 THEN 'partial' ELSE 'thin' END AS sufficiency FROM f""",
)
def evidence_field_coverage(spark, sf_dir):
    f = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("n"))
    return f.select("conv_id", F.round(F.col("n") / 3.0, 6).alias("coverage"), F.when(F.col("n") >= 3, "complete").when(F.col("n") == 2, "partial").otherwise("thin").alias("sufficiency"))


@query(
    "evidence_answer_findings",
    """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(text) < 40 THEN 'short' END, CASE WHEN length(text) > 800 THEN 'long' END, CASE WHEN NOT regexp_matches(text, '[.!?]$') THEN 'cut-off' END, CASE WHEN regexp_matches(text, '@') THEN 'contact' END], lambda x: x IS NOT NULL), ',') AS findings FROM conversations WHERE role = 'assistant'""",
)
def evidence_answer_findings(spark, sf_dir):
    t = F.col("text")
    found = F.array_compact(F.array(F.when(F.length(t) < 40, "short"), F.when(F.length(t) > 800, "long"), F.when(~t.rlike(r"[.!?]\z"), "cut-off"), F.when(t.rlike("@"), "contact")))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.array_join(found, ",").alias("findings"))


@query(
    "evidence_safety_rails",
    "SELECT doc_id, "
    + "greatest("
    + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {s} ELSE 0 END" for _, p, s in RAILS)
    + ") AS severity, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{i}' END" for i, p, _ in RAILS)
    + "], lambda x: x IS NOT NULL), ',') AS rails FROM documents",
)
def evidence_safety_rails(spark, sf_dir):
    t = F.col("text")
    severity = F.greatest(*[F.when(t.rlike(p), s).otherwise(0) for _, p, s in RAILS])
    rails = F.array_compact(F.array(*[F.when(t.rlike(p), i) for i, p, _ in RAILS]))
    return table(spark, sf_dir, "documents").select("doc_id", severity.alias("severity"), F.array_join(rails, ",").alias("rails"))


_NAMES = ", ".join(f"('{i}', {nr}, '{n}')" for nr, (i, names) in enumerate(FIELDS) for n in names)


@query(
    "evidence_requested_fields",
    f"""WITH f(id, nr, name) AS (VALUES {_NAMES}), n AS (SELECT id, nr, replace(name, '-', ' ') AS name FROM f),
    k AS (SELECT *, list_filter(string_split(name, ' '), lambda x: NOT list_contains(string_split('{" ".join(FIELD_STOP)}', ' '), x) AND (length(x) >= 3 OR regexp_matches(x, '^.?[0-9].?$') AND length(x) = 2)) AS telling FROM n),
    t AS (SELECT doc_id, coalesce({_LOW}, '') AS low FROM documents), w AS (SELECT *, string_split(low, ' ') AS ws FROM t),
    m AS (SELECT doc_id, id, nr, bool_or(contains(low, name) OR len(telling) > 0 AND len(list_filter(telling, lambda x: list_contains(ws, x))) >= CASE WHEN len(telling) <= 2 THEN len(telling) ELSE ceil(len(telling) * 0.75) END) AS hit FROM w, k GROUP BY 1, 2, 3)
    SELECT doc_id, coalesce(string_agg(id, ',' ORDER BY nr) FILTER (hit), '') AS fields, round(count(*) FILTER (hit) / {len(FIELDS)}.0, 6) AS coverage FROM m GROUP BY 1""",
)
def evidence_requested_fields(spark, sf_dir):
    """Which fields each document speaks of."""
    found = requested_fields(table(spark, sf_dir, "documents"), "text", FIELDS)
    return found.select("doc_id", F.array_join("fields", ",").alias("fields"), "coverage")


@query(
    "evidence_safety_gate",
    """WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
    s AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS answer, length(coalesce(q, '')) % 2 = 0 AS retrieved, length(text) % 3 AS m, list_distinct(regexp_extract_all(coalesce(q, ''), '[0-9]+')) AS sources,
      list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS cited, len(regexp_extract_all(coalesce(q, ''), '[.!?]')) AS candidates, len(regexp_extract_all(coalesce(text, ''), '[.!?]')) AS usable FROM c WHERE role = 'assistant'),
    r AS (SELECT *, list_filter([CASE WHEN answer = '' THEN 'EMPTY_ANSWER' END, CASE WHEN retrieved AND len(sources) = 0 THEN 'MISSING_SOURCES' END, CASE WHEN m = 1 AND len(sources) > 0 THEN 'NO_SOURCE_MODE_WITH_SOURCES' END,
      CASE WHEN retrieved AND usable = 0 THEN 'NO_USABLE_FACTS' END, CASE WHEN retrieved AND len(cited) > 0 AND len(sources) > 0 AND NOT list_has_all(sources, cited) THEN 'SOURCE_METADATA_MISMATCH' END], lambda x: x IS NOT NULL) AS reasons,
      list_filter([CASE WHEN m = 2 AND len(sources) = 0 THEN 'SUGGEST_MODE_NO_GROUNDED_SOURCES' END, CASE WHEN candidates > 4 THEN 'TOO_MANY_CONTEXT_CHUNKS_FOR_3B' END], lambda x: x IS NOT NULL) AS warnings FROM s)
    SELECT conv_id, turn, array_to_string(reasons, ',') AS reasons, array_to_string(warnings, ',') AS warnings, CASE WHEN len(reasons) > 0 THEN 'rewrite' WHEN len(warnings) > 0 THEN 'warn' ELSE 'pass' END AS status,
      CASE WHEN m = 2 THEN 'source_suggestion' WHEN list_contains(reasons, 'NO_USABLE_FACTS') THEN 'low_grounding' WHEN len(reasons) = 0 THEN NULL WHEN reasons[1] = 'MISSING_SOURCES' THEN 'low_grounding' WHEN reasons[1] = 'SOURCE_METADATA_MISMATCH' THEN 'privacy_safe' ELSE 'domain_safe' END AS fallback FROM r""",
)
def evidence_safety_gate(spark, sf_dir):
    """Assistant turns as answers to the turn before, whose numbers stand for source ids and whose sentences for candidates."""
    asked = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    turns = table(spark, sf_dir, "conversations").withColumn("q", asked).where("role = 'assistant'")
    said = F.coalesce("text", F.lit(""))

    def every(text, pattern):
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    signals = turns.select(
        "conv_id",
        "turn",
        said.alias("answer"),
        (F.length("q") % 2 == 0).alias("retrieved"),
        F.element_at(F.array(F.lit("auto"), F.lit("no_source"), F.lit("suggest")), F.length("text") % 3 + 1).alias("mode"),
        F.lit("medium").alias("grounding"),
        F.size(every(F.col("q"), "[.!?]")).alias("candidates"),
        F.lit(False).alias("failed"),
        F.lit(0).alias("dropped"),
        F.size(every(said, "[.!?]")).alias("usable"),
        F.array_distinct(every(F.col("q"), "[0-9]+")).alias("sources"),
        F.array_distinct(every(said, "[0-9]+")).alias("cited"),
        F.array().cast("array<string>").alias("collections"),
        F.array().cast("array<string>").alias("accessible"),
    )
    return safety_gate(signals).select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"), "status", "fallback")


@query(
    "evidence_brief",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT source, md5(string_agg('[' || rn || '] ' || substr(text, 1, 120), chr(10) ORDER BY rn)) AS brief_md5 FROM r WHERE rn <= 3 GROUP BY 1""",
)
def evidence_brief(spark, sf_dir):
    from corvane.operators.joins import top_n

    top = top_n(table(spark, sf_dir, "documents"), "source", 3, F.desc("n_chars"), "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("text", 1, 120))
    g = top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))), lambda x: x["s"]), "\n").alias("b"))
    return g.select("source", F.md5(F.col("b").cast("binary")).alias("brief_md5"))


@query(
    "evidence_language_quality",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1) AS w FROM documents)
    SELECT doc_id, CAST(len(list_filter([w[i] = w[i + 1] for i in range(1, len(w))], lambda x: x)) AS INTEGER) AS repeats FROM w""",
)
def evidence_language_quality(spark, sf_dir):
    """How often a word follows itself."""
    w = table(spark, sf_dir, "documents").select("doc_id", plain_tokens(F.col("text")).alias("w"))
    same = F.filter(F.zip_with(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)
    return w.select("doc_id", F.size(same).alias("repeats"))
