"""Quality of parses, documents, profiles and instruction pairs; automatic metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import plain_tokens
from corvane.session import table


def count_of(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


#: Marks of broken encodings and control characters, of structure and of tables, and noise.
MOJIBAKE, CONTROL, REPLACEMENT = "[ÄÅÃÂÐÞþð]", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "\ufffd"
SYMBOLS = "[^\\p{L}\\p{N}\\s.,;:!?()\\[\\]{}'\"%/@#\\-+_=|]"
STRUCTURE = [
    r"(?m)^#{1,6}\s+\S",
    r"(?m)^\s*[-*]\s+\S",
    r"(?m)^\s*\d+[.)]\s+\S",
    r"\|[^|\n]+\|",
    r"(?i)\b(topic|tags|summary|soru|cevap|kaynak|madde|risk|özet|ozet)\s*:",
]
#: The second one is delimited(), since Java's engine recurses for each of its repetitions.
TABLES = [
    r"\|[^|\n]+\|[^|\n]+\|",
    r"(?m)^\s*[^\n|;]+(?:[;,\t]\s*[^\n|;]+){3,}$",
    r"(?i)\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?\s*(?:TL|TRY|USD|EUR|%)\b",
    r"(?i)\b(?:gelir|gider|aktif|pasif|kar|zarar|özkaynak|ozkaynak|nakit|hasılat|hasilat)\b",
]
#: What a pattern that begins with a word's edge can go on with: looked at before the edge, which is dear, and implied by what follows it.
FIRSTS = {STRUCTURE[4]: "[tsckmröo]", TABLES[2]: "[0-9]", TABLES[3]: "[gakpznöoh]"}
CLEAN, USABLE = 76, 48
#: Limits of OCR and table risk.
OCR_MEDIUM, OCR_HIGH, TABLE_MEDIUM, TABLE_HIGH = 12, 35, 35, 65


def holds(text: Column, pattern: str, first: str | None = None) -> Column:
    """Whether text has the pattern, which can begin with the characters of first at its first bound; word characters are ASCII's and lines end at line feeds only, as elsewhere they do."""
    word = "[A-Za-z0-9_]"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    first = first or FIRSTS.get(pattern)
    ahead = f"(?={first})" if first else ""
    return text.rlike(pattern.replace(r"\b", ahead + edge, 1).replace(r"\b", edge).replace("(?m)", "(?dm)").replace("(?i)", "(?iu)"))


def delimited(text: Column) -> Column:
    """Whether lines of text have four cells or more between ; , or tabs (the second pattern of TABLES), in one pass over the lines.

    Cells are not empty and have no ; and no |, but may have commas and tabs. A line that ends in a separator goes on in the next.
    """

    def cells(x: Column) -> Column:
        """The separators of a line, as many as leave a cell on either side; null where a cell is empty or has a |."""
        n = F.size(F.regexp_extract_all(x, F.lit(r"[^;][,\t](?=[^;])"), F.lit(0))) + F.length(x) - F.length(F.replace(x, F.lit(";")))
        return F.when((x != "") & ~x.rlike(r"\||;;|^;|;$"), n)

    def step(state: Column, line: Column) -> Column:
        hit = state["hit"] | F.coalesce(state["n"] + cells(line) >= 3, F.lit(False))
        # the separator at the end is the first or the last of those that only white space follows
        cuts = [F.when(line.rlike(p), F.regexp_replace(line, p, "")) for p in (r"[;,\t]\s*$", r"[;,\t][^\S\t]*$")]
        n = F.greatest(*[F.coalesce(state["n"] + cells(cut) + 1, F.lit(0)) for cut in cuts])
        return F.struct(F.least(F.when(line.rlike(r"^\s*$"), F.greatest(state["n"], n)).otherwise(n), F.lit(3)).alias("n"), hit.alias("hit"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("hit"))
    return F.aggregate(F.split(text, "\n"), start, step)["hit"]


def parse_signals(rows: DataFrame, text: str = "text", kind: str = "kind", chunks: str = "chunks", average: str = "average", names: list[str] | None = None) -> DataFrame:
    """Adds one struct, signals: what parse_quality() weighs of a text of some kind that was cut into chunks of average length; those of names only, if given.

    The struct leaves a generator, behind which each pattern is looked for once, however often what follows names its signal.
    """
    clean, cut = _free(rows, "_clean"), _free(rows, "_lines")
    t = F.col(clean)
    n = F.length(t)

    def share(pattern):
        return F.when(n > 0, count_of(t, pattern) / n).otherwise(0.0)

    trimmed = F.trim(F.coalesce(F.col(text), F.lit("")))
    split = F.filter(F.transform(F.split(trimmed, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    lines = F.col(cut)
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 18))
    structure = sum(holds(t, p).cast("int") for p in STRUCTURE) + (F.col(kind) == "JSON").cast("int")
    signals = {
        "length": n,
        "chunks": F.col(chunks),
        "average": F.col(average).cast("double"),
        "replaced": share(REPLACEMENT),
        "mojibake": count_of(t, MOJIBAKE),
        "control": share(CONTROL),
        "symbols": share(SYMBOLS),
        "lines": F.size(lines),
        "short_lines": F.when(F.size(lines) > 0, short / F.size(lines)).otherwise(0.0),
        "structure": structure,
        "tables": sum((delimited(t) if i == 1 else holds(t, p)).cast("int") for i, p in enumerate(TABLES)),
        "digits": share("[0-9]"),
        "kind": F.col(kind),
    }
    kept = [c.alias(k) for k, c in signals.items() if names is None or k in names]
    prepared = rows.drop("signals").withColumns({clean: trimmed, cut: split})
    return prepared.select("*", F.explode(F.array(F.struct(*kept))).alias("signals")).drop(clean, cut)


#: The signals of which the OCR risk is made.
OCR_SIGNALS = ["replaced", "mojibake", "control", "symbols"]


def ocr_score(signals: str = "signals") -> Column:
    """OCR risk of 0 to 100 from parse_signals()."""
    s = {k: F.col(f"{signals}.{k}") for k in OCR_SIGNALS}
    score = s["replaced"] * 10000 + s["mojibake"] * 3 + s["control"] * 4000 + F.greatest(F.lit(0.0), s["symbols"] - 0.08) * 300
    return F.least(F.lit(100), F.floor(score + 0.5)).cast("int")


def _free(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name = f"_{name}"
    return name


def parse_quality(signals: str = "signals") -> tuple[Column, Column, Column]:
    """(score of 0 to 100, OCR risk of 0 to 100, warnings) from parse_signals(): 72, more for structure, less for noise."""
    s = {k: F.col(f"{signals}.{k}") for k in ("length", "chunks", "average", "replaced", "mojibake", "control", "symbols", "lines", "short_lines", "structure", "tables", "digits", "kind")}
    ocr = ocr_score(signals)
    # (condition, points, warning): of rows in one list the first that holds counts
    ladders = [
        [(s["kind"].isin("JSON", "MARKDOWN"), 5, None)],
        [(s["structure"] >= 2, 10, None), (s["structure"] == 1, 4, None)],
        [(s["tables"] >= 2, 5, "table_like_content")],
        [(s["length"] < 160, -26, "very_short_text"), (s["length"] < 420, -10, None)],
        [(s["chunks"] == 0, -42, "no_chunks"), ((s["chunks"] == 1) & (s["average"] < 260), -14, "single_tiny_chunk")],
        [(s["replaced"] > 0.001, -30, "replacement_char_detected")],
        [(s["mojibake"] >= 8, -28, "mojibake_detected"), (s["mojibake"] >= 3, -14, "possible_mojibake")],
        [(s["control"] > 0.002, -18, "high_control_char_ratio")],
        [(s["symbols"] > 0.08, -16, "high_symbol_noise")],
        [((s["short_lines"] > 0.58) & (s["lines"] >= 8), -12, "fragmented_lines")],
        [(ocr >= OCR_HIGH, 0, "ocr_risk_high"), (ocr >= OCR_MEDIUM, 0, "ocr_risk_medium")],
        [((s["digits"] > 0.18) & (s["tables"] == 0) & (s["length"] > 400), -8, "dense_numbers_without_table_structure")],
        [((s["structure"] == 0) & (s["length"] > 700), -6, "low_structural_signal")],
    ]

    def first(ladder, at, default):
        out = None
        for step in ladder:
            value = F.lit(step[at]).cast("string" if at == 2 else "int")
            out = F.when(step[0], value) if out is None else out.when(step[0], value)
        return out.otherwise(default)

    score = F.lit(72) + sum(first(x, 1, 0) for x in ladders)
    warnings = F.array_compact(F.array(*[first(x, 2, None) for x in ladders if any(step[2] for step in x)]))
    return F.least(F.greatest(score, F.lit(0)), F.lit(100)), ocr, warnings


def level(score: Column, good: float, usable: float, names=("clean", "usable", "noisy")) -> Column:
    return F.when(score >= good, names[0]).when(score >= usable, names[1]).otherwise(names[2])


def risk(score: Column, medium: int, high: int) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score > 0, "low").otherwise("none")


def ingestion_report(score: Column, ocr: Column, warnings: Column, signals: str = "signals", thin: Column | None = None) -> dict[str, Column]:
    """table_risk, ocr_risk, thin_source, strict_eligible, warnings; thin: whether the source itself is known to be thin."""
    tables, digits = F.col(f"{signals}.tables"), F.col(f"{signals}.digits")
    table_score = F.when(tables >= 2, 70).when(tables == 1, 38).when(digits > 0.18, 52).otherwise(0)
    table_risk, ocr_risk = risk(table_score, TABLE_MEDIUM, TABLE_HIGH), risk(ocr, OCR_MEDIUM, OCR_HIGH)
    poor = (score < USABLE) | F.array_contains(warnings, "very_short_text") | F.array_contains(warnings, "fragmented_lines")
    poor = poor | thin if thin is not None else poor
    own = F.array_compact(
        F.array(
            F.when(table_risk.isin("high", "medium"), F.concat(F.lit("table_risk_"), table_risk)),
            F.when(ocr_risk.isin("high", "medium"), F.concat(F.lit("ocr_risk_"), ocr_risk)),
            F.when(poor, "thin_source"),
        )
    )
    every = F.slice(F.array_distinct(F.concat(warnings, own)), 1, 20)
    return {"table_risk": table_risk, "ocr_risk": ocr_risk, "thin_source": poor, "strict_eligible": ~poor, "warnings": every}


def _sources(spark, sf_dir, names: list[str] | None = None) -> DataFrame:
    """documents and page sources with their kind, number of chunks of 1,200 characters and signals."""
    t = F.trim(F.coalesce(F.col("text"), F.lit("")))
    kind = F.when(t.startswith("{"), "JSON").when(t.rlike("^#{1,6} "), "MARKDOWN").otherwise("TEXT")
    pages = table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.col("html").alias("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").union(pages).withColumns({"kind": kind, "chunks": F.ceil(F.length(t) / 1200).cast("int")})
    return parse_signals(rows.withColumn("average", F.when(F.col("chunks") > 0, F.length(t) / F.col("chunks")).otherwise(0.0)), names=names)


def _documents(spark, sf_dir) -> DataFrame:
    """The sources, scored."""
    rows = _sources(spark, sf_dir)
    score, ocr, warnings = parse_quality()
    return rows.select("doc_id", "signals", score.alias("score"), ocr.alias("ocr"), warnings.alias("warnings"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(t, {_sql(pattern)}))"


_SIGNALS = f"""src AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -page_id - 1, html FROM pages)),
raw AS (SELECT doc_id, t, length(t) AS n, CASE WHEN starts_with(t, '{{') THEN 'JSON' WHEN regexp_matches(t, '^#{{1,6}} ') THEN 'MARKDOWN' ELSE 'TEXT' END AS kind,
  {_n(REPLACEMENT)} AS rep, {_n(MOJIBAKE)} AS moji, {_n(CONTROL)} AS ctl, {_n(SYMBOLS)} AS sym, {_n("[0-9]")} AS dig,
  list_filter(list_transform(string_split_regex(t, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS lines,
  {" + ".join(f"CASE WHEN regexp_matches(t, {_sql(p)}) THEN 1 ELSE 0 END" for p in STRUCTURE)} AS st,
  {" + ".join(f"CASE WHEN regexp_matches(t, {_sql(p)}) THEN 1 ELSE 0 END" for p in TABLES)} AS tb FROM src),
sig AS (SELECT doc_id, n, kind, st + CASE WHEN kind = 'JSON' THEN 1 ELSE 0 END AS st, tb, moji, len(lines) AS nl, CAST(ceil(n / 1200.0) AS INTEGER) AS ch,
  CASE WHEN n > 0 THEN rep / n::DOUBLE ELSE 0 END AS rep, CASE WHEN n > 0 THEN ctl / n::DOUBLE ELSE 0 END AS ctl, CASE WHEN n > 0 THEN sym / n::DOUBLE ELSE 0 END AS sym,
  CASE WHEN n > 0 THEN dig / n::DOUBLE ELSE 0 END AS dig, CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: length(x) <= 18)) / len(lines)::DOUBLE ELSE 0 END AS sl FROM raw),
risk AS (SELECT *, CASE WHEN ch > 0 THEN n / ch::DOUBLE ELSE 0 END AS av, CAST(least(100, floor(rep * 10000 + moji * 3 + ctl * 4000 + greatest(0, sym - 0.08) * 300 + 0.5)) AS INTEGER) AS ocr FROM sig),
q AS (SELECT doc_id, ocr, tb, dig, least(100, greatest(0, 72 + CASE WHEN kind IN ('JSON', 'MARKDOWN') THEN 5 ELSE 0 END + CASE WHEN st >= 2 THEN 10 WHEN st = 1 THEN 4 ELSE 0 END + CASE WHEN tb >= 2 THEN 5 ELSE 0 END
    - CASE WHEN n < 160 THEN 26 WHEN n < 420 THEN 10 ELSE 0 END - CASE WHEN ch = 0 THEN 42 WHEN ch = 1 AND av < 260 THEN 14 ELSE 0 END - CASE WHEN rep > 0.001 THEN 30 ELSE 0 END
    - CASE WHEN moji >= 8 THEN 28 WHEN moji >= 3 THEN 14 ELSE 0 END - CASE WHEN ctl > 0.002 THEN 18 ELSE 0 END - CASE WHEN sym > 0.08 THEN 16 ELSE 0 END - CASE WHEN sl > 0.58 AND nl >= 8 THEN 12 ELSE 0 END
    - CASE WHEN dig > 0.18 AND tb = 0 AND n > 400 THEN 8 ELSE 0 END - CASE WHEN st = 0 AND n > 700 THEN 6 ELSE 0 END)) AS score,
  list_filter([CASE WHEN tb >= 2 THEN 'table_like_content' END, CASE WHEN n < 160 THEN 'very_short_text' END, CASE WHEN ch = 0 THEN 'no_chunks' WHEN ch = 1 AND av < 260 THEN 'single_tiny_chunk' END,
    CASE WHEN rep > 0.001 THEN 'replacement_char_detected' END, CASE WHEN moji >= 8 THEN 'mojibake_detected' WHEN moji >= 3 THEN 'possible_mojibake' END, CASE WHEN ctl > 0.002 THEN 'high_control_char_ratio' END,
    CASE WHEN sym > 0.08 THEN 'high_symbol_noise' END, CASE WHEN sl > 0.58 AND nl >= 8 THEN 'fragmented_lines' END, CASE WHEN ocr >= 35 THEN 'ocr_risk_high' WHEN ocr >= 12 THEN 'ocr_risk_medium' END,
    CASE WHEN dig > 0.18 AND tb = 0 AND n > 400 THEN 'dense_numbers_without_table_structure' END, CASE WHEN st = 0 AND n > 700 THEN 'low_structural_signal' END], lambda x: x IS NOT NULL) AS w FROM risk)"""


@query(
    "quality_parse",
    f"WITH {_SIGNALS} SELECT doc_id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 76 THEN 'clean' WHEN score >= 48 THEN 'usable' ELSE 'noisy' END AS level, array_to_string(w, ',') AS warnings FROM q",
)
def quality_parse(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", "score", level(F.col("score"), CLEAN, USABLE).alias("level"), F.array_join("warnings", ",").alias("warnings"))


@query(
    "quality_ocr_risk",
    f"WITH {_SIGNALS} SELECT doc_id, ocr AS ocr_score, CASE WHEN ocr >= 35 THEN 'high' WHEN ocr >= 12 THEN 'medium' WHEN ocr > 0 THEN 'low' ELSE 'none' END AS risk FROM q",
)
def quality_ocr_risk(spark, sf_dir):
    ocr = ocr_score()
    return _sources(spark, sf_dir, OCR_SIGNALS).select("doc_id", ocr.alias("ocr_score"), risk(ocr, OCR_MEDIUM, OCR_HIGH).alias("risk"))


@query(
    "quality_ingestion_report",
    f"""WITH {_SIGNALS}, r AS (SELECT doc_id, score, ocr, w, CASE WHEN tb >= 2 THEN 'high' WHEN tb = 1 THEN 'medium' WHEN dig > 0.18 THEN 'medium' ELSE 'none' END AS table_risk,
      CASE WHEN ocr >= 35 THEN 'high' WHEN ocr >= 12 THEN 'medium' WHEN ocr > 0 THEN 'low' ELSE 'none' END AS ocr_risk, score < 48 OR list_contains(w, 'very_short_text') OR list_contains(w, 'fragmented_lines') AS thin FROM q),
    e AS (SELECT *, list_concat(w, list_filter([CASE WHEN table_risk <> 'none' THEN 'table_risk_' || table_risk END, CASE WHEN ocr_risk IN ('high', 'medium') AND NOT list_contains(w, 'ocr_risk_' || ocr_risk) THEN 'ocr_risk_' || ocr_risk END,
      CASE WHEN thin THEN 'thin_source' END], lambda x: x IS NOT NULL)) AS every FROM r)
    SELECT doc_id, table_risk, ocr_risk, thin AS thin_source, NOT thin AS strict_eligible, array_to_string(every, ',') AS warnings FROM e""",
)
def quality_ingestion_report(spark, sf_dir):
    d = _documents(spark, sf_dir)
    found = ingestion_report(F.col("score"), F.col("ocr"), F.col("warnings"))
    return d.select("doc_id", *[c.alias(k) for k, c in found.items() if k != "warnings"], F.array_join(found["warnings"], ",").alias("warnings"))


@query(
    "quality_task_readiness",
    """SELECT conv_id, CASE WHEN count(*) FILTER (role = 'assistant') >= 3 THEN 'ready' WHEN count(*) FILTER (role = 'assistant') >= 1 THEN 'partial' ELSE 'missing' END AS answers, count(*) FILTER (role = 'system') > 0 AS has_system FROM conversations GROUP BY 1""",
)
def quality_task_readiness(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("a"), F.count_if(F.col("role") == "system").alias("s"))
    return g.select("conv_id", F.when(F.col("a") >= 3, "ready").when(F.col("a") >= 1, "partial").otherwise("missing").alias("answers"), (F.col("s") > 0).alias("has_system"))


@query(
    "quality_profile_health",
    """WITH g AS (SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, avg(n_chars) AS m FROM documents GROUP BY 1)
    SELECT source, round(least(40.0, docs / 50.0 * 40) + least(30.0, langs / 4.0 * 30) + least(30.0, m / 2000 * 30), 3) AS score, CASE WHEN least(40.0, docs / 50.0 * 40) + least(30.0, langs / 4.0 * 30) + least(30.0, m / 2000 * 30) >= 78 THEN 'healthy' ELSE 'usable' END AS level FROM g""",
)
def quality_profile_health(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_distinct("lang").alias("langs"), F.avg("n_chars").alias("m"))

    def points(x, full, most):
        return F.least(F.lit(float(most)), F.col(x) / full * most)

    s = points("docs", 50.0, 40) + points("langs", 4.0, 30) + points("m", 2000, 30)
    return g.select("source", (F.floor(s * 1000 + 0.5) / 1000).alias("score"), F.when(s >= 78, "healthy").otherwise("usable").alias("level"))


@query(
    "quality_instruction_pairs",
    """WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q, role FROM conversations)
    SELECT conv_id, turn, least(40, CAST(length(text) // 20 AS INTEGER)) + CASE WHEN length(q) > 30 THEN 30 ELSE 0 END + CASE WHEN regexp_matches(text, '[.!?]$') THEN 30 ELSE 0 END AS score FROM p WHERE role = 'assistant' AND q IS NOT NULL""",
)
def quality_instruction_pairs(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("q", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    s = F.least(F.lit(40), F.floor(F.length("text") / 20).cast("int")) + F.when(F.length("q") > 30, 30).otherwise(0) + F.when(F.col("text").rlike(r"[.!?]\z"), 30).otherwise(0)
    return c.where("role = 'assistant' and q is not null").select("conv_id", "turn", s.alias("score"))


@query(
    "quality_auto_metadata",
    """WITH w AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1) AS w FROM documents)
    SELECT doc_id, CASE WHEN len(w) > 800 THEN 'report' WHEN len(w) > 200 THEN 'article' ELSE 'note' END AS kind, CASE lang WHEN 'en' THEN 'international' ELSE 'local' END AS audience, CAST(len(list_distinct(w)) AS INTEGER) AS vocabulary FROM w""",
)
def quality_auto_metadata(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", "lang", plain_tokens(F.col("text")).alias("w"))
    n = F.size("w")
    return w.select(
        "doc_id", F.when(n > 800, "report").when(n > 200, "article").otherwise("note").alias("kind"), F.when(F.col("lang") == "en", "international").otherwise("local").alias("audience"), F.size(F.array_distinct("w")).alias("vocabulary")
    )


#: Profiles of cards: topic, words with their weights, tags.
PROFILES = [
    ("licence", {"licensed": 3, "license": 3, "copyright": 2, "reserved": 2}, ["rights", "terms"]),
    ("insult", {"idiot": 3, "scum": 3, "worthless": 2, "trash": 1}, ["tone"]),
    ("credentials", {"token": 3, "password": 3, "secret": 2, "key": 1}, ["security", "keys"]),
    ("contact", {"mail": 2, "phone": 2, "call": 1, "tel": 1}, ["people"]),
]


def card(words: Column, profiles=PROFILES) -> Column:
    """Struct of topic, score, tags: the profile with the most weight among an array of words, of equals the first; null without any."""
    weights = [sum(F.when(F.array_contains(words, w), n).otherwise(0) for w, n in part.items()) for _, part, _ in profiles]
    best = F.greatest(*weights)
    made = F.lit(None)
    for (topic, _, tags), weight in reversed(list(zip(profiles, weights, strict=True))):
        made = F.when((best > 0) & (weight == best), F.struct(F.lit(topic).alias("topic"), best.alias("score"), F.array(*map(F.lit, tags)).alias("tags"))).otherwise(made)
    return made


_WEIGHED = ", ".join(f"('{t}', {i}, '{w}', {n}, '{'|'.join(tags)}')" for i, (t, part, tags) in enumerate(PROFILES) for w, n in part.items())


@query(
    "quality_cards",
    f"""WITH p(topic, nr, word, weight, tags) AS (VALUES {_WEIGHED}),
    w AS (SELECT doc_id, n_chars, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'))) AS word FROM documents),
    s AS (SELECT doc_id, topic, nr, tags, n_chars, sum(weight) AS score FROM w JOIN p USING (word) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, nr) AS rn FROM s)
    SELECT doc_id, topic, CAST(score AS INTEGER) AS score, 'A text of ' || n_chars || ' characters about ' || topic || ' (' || replace(tags, '|', ', ') || ').' AS summary FROM b WHERE rn = 1""",
)
def quality_cards(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", card(plain_tokens(F.col("text"))).alias("c")).where("c is not null")
    summary = F.concat(F.lit("A text of "), F.col("n_chars").cast("string"), F.lit(" characters about "), "c.topic", F.lit(" ("), F.array_join("c.tags", ", "), F.lit(")."))
    return d.select("doc_id", "c.topic", "c.score", summary.alias("summary"))
