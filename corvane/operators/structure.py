"""Document structure: blocks, artifacts, chunks and their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import sentences
from corvane.session import table

MAX_CHARS = 900


def block_kind(text: Column) -> Column:
    """code, table, heading, list, definition or paragraph, by the first that fits."""
    t = F.trim(text)
    return (
        F.when(t.startswith("```"), "code")
        .when(t.rlike(r"^\|.*\|"), "table")
        .when(t.rlike(r"^#{1,6} "), "heading")
        .when(t.rlike(r"^([-*•]|[0-9]+[.)]) "), "list")
        .when(t.rlike(r"^[^:\n]{2,60}: \S"), "definition")
        .otherwise("paragraph")
    )


def packed(pieces: Column, limit: int, joiner: str) -> Column:
    """Texts of pieces joined in order, each of at most limit characters where its pieces allow it.

    The fold keeps the texts that are done, and the one that is still growing with its length (-1 before the first piece), which is joined once a piece.
    """
    none = F.array().cast("array<string>")

    def state(done, last, n):
        return F.struct(done.alias("done"), last.alias("last"), n.cast("int").alias("n"))

    def add(s, piece):
        n = s["n"] + F.length(piece) + len(joiner)
        return F.when(s["n"] < 0, state(none, piece, F.length(piece))).when(
            n <= limit, state(s["done"], F.concat(s["last"], F.lit(joiner), piece), n)
        ).otherwise(state(F.concat(s["done"], F.array(s["last"])), piece, F.length(piece)))

    return F.aggregate(pieces, state(none, F.lit(""), F.lit(-1)), add, lambda s: F.when(s["n"] < 0, none).otherwise(F.concat(s["done"], F.array(s["last"]))))


def split_long(text: Column, limit: int) -> Column:
    """The text, or its sentences packed to limit, or, for sentences over it, their words packed."""
    by_sentence = F.flatten(
        F.transform(sentences(text), lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(packed(F.split(s, " "), limit, " ")))
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed(by_sentence, limit, " "))


def chunks(docs: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """doc_id, chunk_index, content of docs (doc_id, text): paragraphs packed greedily, long ones split first.

    All of it happens in one row's expression, with no shuffle.
    """
    paragraphs = F.filter(F.transform(F.split("text", r"\n\s*\n|\n"), lambda p: F.trim(p)), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: split_long(p, limit)))
    return docs.select("doc_id", F.posexplode(packed(pieces, limit, "\n\n")).alias("chunk_index", "content"))


def table_chunks(markdown: Column, rows: int) -> Column:
    """A Markdown table cut every so many rows, its two header lines before each part."""
    lines = F.split(F.trim(markdown), "\n")
    body = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    starts = F.sequence(F.lit(1), F.greatest(F.size(body), F.lit(1)), F.lit(rows))
    return F.transform(starts, lambda i: F.array_join(F.concat(F.slice(lines, 1, 2), F.slice(body, i, F.lit(rows))), "\n"))


def record_chunks(markdown: Column) -> Column:
    """A text of '## ' records cut before each, the lines above the first repeated in every part."""
    parts = F.split(markdown, r"(?m)^(?=## )")
    return F.when(F.size(parts) <= 1, parts).otherwise(
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda p: F.concat(F.element_at(parts, 1), p))
    )


def numbered(rows: DataFrame, key: str, order: str, ties: list[str]) -> DataFrame:
    """Adds part, the place from 0 among the rows of a key by order and ties, and size, the rows of the key.

    The rows are dealt into ranges of order, a number, between bounds that are fixed first; each range is numbered by itself, and
    only its size for each key is added up in one place. Rows with equal order share a range.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    bounds = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)]).alias("b")).first().b or []
    ranged = rows.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<long>"), lambda b: b < F.col(order))))
    sizes = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("size"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order, *ties))
    return ranged.withColumn("_at", inside).join(bases, [key, "_range"]).withColumn("part", F.col("_at") - 1 + F.col("_base")).drop("_range", "_at", "_base")


def artifacts(docs: DataFrame) -> DataFrame:
    """doc_id, artifact, kind, first_line, lines, title of docs: blocks of lines between blank lines or headings."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    w = Window.partitionBy("doc_id").orderBy("i")
    head = F.col("t").rlike("^#{1,6} ") | ((F.length("t") < 60) & F.col("t").rlike(r"[^.,;:]$") & (F.col("t") != ""))
    marked = lines.withColumns({"head": head, "gap": F.coalesce(F.lag("t").over(w), F.lit("")) == ""})
    carried = marked.withColumns(
        {
            "artifact": F.sum((F.col("head") | F.col("gap")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "title": F.last(F.when(F.col("head"), F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).where("t != ''")
    return carried.groupBy("doc_id", "artifact").agg(
        F.min("i").alias("first_line"), F.count("*").alias("lines"), block_kind(F.min_by("t", "i")).alias("kind"), F.min_by("title", "i").alias("title")
    )


@query("structure_chunks")
def structure_chunks(spark, sf_dir):
    c = chunks(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "chunk_index", F.length("content").alias("chars"), F.md5(F.col("content").cast("binary")).alias("md5"))


@query(
    "structure_artifacts",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i FROM documents),
    m AS (SELECT *, regexp_matches(t, '^#{1,6} ') OR (length(t) < 60 AND regexp_matches(t, '[^.,;:]$') AND t <> '') AS head, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY i), '') = '' AS gap FROM l),
    c AS (SELECT *, CAST(sum(CASE WHEN head OR gap THEN 1 ELSE 0 END) OVER w AS BIGINT) AS artifact, last_value(CASE WHEN head THEN t END IGNORE NULLS) OVER w AS title FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    g AS (SELECT doc_id, artifact, min(i) AS first_line, count(*) AS lines, trim(arg_min(t, i)) AS f, arg_min(title, i) AS title FROM (SELECT * FROM c WHERE t <> '') GROUP BY ALL)
    SELECT doc_id, artifact, first_line, lines, CASE WHEN starts_with(f, '```') THEN 'code' WHEN regexp_matches(f, '^\\|.*\\|') THEN 'table' WHEN regexp_matches(f, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(f, '^([-*•]|[0-9]+[.)]) ') THEN 'list' WHEN regexp_matches(f, '^[^:\\n]{2,60}: \\S') THEN 'definition' ELSE 'paragraph' END AS kind, md5(coalesce(title, '')) AS title_md5 FROM g""",
)
def structure_artifacts(spark, sf_dir):
    return artifacts(table(spark, sf_dir, "documents")).select("doc_id", "artifact", "first_line", "lines", "kind", F.md5(F.coalesce("title", F.lit("")).cast("binary")).alias("title_md5"))


@query("structure_chunk_contract")
def structure_chunk_contract(spark, sf_dir):
    """Chunks with why they were cut and what is wrong with them."""
    c = chunks(table(spark, sf_dir, "documents"))
    n = F.length("content")
    why = F.when(n > MAX_CHARS, "oversized").when(n > MAX_CHARS * 0.8, "limit").otherwise("end")
    wrong = F.array_compact(F.array(F.when(n < 20, "tiny"), F.when(n > MAX_CHARS, "too-long"), F.when(~F.col("content").rlike(r"[\p{L}]"), "no-words")))
    return c.select("doc_id", "chunk_index", why.alias("split_reason"), F.array_join(wrong, ",").alias("warnings"), F.greatest(F.lit(1), F.ceil(n / 4)).cast("long").alias("tokens"))


@query(
    "structure_enrichment",
    """SELECT doc_id, md5(CASE WHEN lang = 'en' AND n_chars > 500 THEN 'Topic: ' || source || chr(10) || 'Tags: ' || lang || chr(10) ELSE '' END || substr(text, 1, 200)) AS enriched_md5 FROM documents""",
)
def structure_enrichment(spark, sf_dir):
    head = F.when((F.col("lang") == "en") & (F.col("n_chars") > 500), F.concat(F.lit("Topic: "), "source", F.lit("\nTags: "), "lang", F.lit("\n"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(head, F.substring("text", 1, 200)).cast("binary")).alias("enriched_md5"))


@query(
    "structure_html_blocks",
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<li[ >]')) AS INTEGER) AS items, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS paragraphs, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title FROM pages""",
)
def structure_html_blocks(spark, sf_dir):
    def n(tag):
        return F.size(F.regexp_extract_all("html", F.lit(f"<{tag}[ >]"), F.lit(0)))

    return table(spark, sf_dir, "pages").select("page_id", n("li").alias("items"), n("p").alias("paragraphs"), F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("title"))


@query(
    "structure_table_chunks",
    """WITH r AS (SELECT l_orderkey, '|' || l_linenumber || '|' || l_returnflag || '|' AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS rn FROM lineitem)
    SELECT l_orderkey, CAST((rn - 1) // 3 AS INTEGER) AS part, md5('|line|flag|' || chr(10) || '|-|-|' || chr(10) || string_agg(line, chr(10) ORDER BY rn)) AS chunk_md5 FROM r GROUP BY ALL""",
)
def structure_table_chunks(spark, sf_dir):
    """Orders' lines as Markdown tables, cut every three rows with the header before each part."""
    line = F.concat(F.lit("|"), F.col("l_linenumber").cast("string"), F.lit("|"), "l_returnflag", F.lit("|"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("s")))).alias("r"))
    md = F.concat(F.lit("|line|flag|\n|-|-|\n"), F.array_join(F.transform("r", lambda x: x["s"]), "\n"))
    parts = rows.select("l_orderkey", F.posexplode(table_chunks(md, 3)).alias("part", "c"))
    return parts.select("l_orderkey", "part", F.md5(F.col("c").cast("binary")).alias("chunk_md5"))


@query(
    "structure_record_chunks",
    """SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS part, md5('# ' || source || chr(10) || '## ' || doc_id || chr(10) || lang || CASE WHEN lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) IS NULL THEN '' ELSE chr(10) END) AS chunk_md5 FROM documents""",
)
def structure_record_chunks(spark, sf_dir):
    """Sources as texts of records, cut before each record with the lines above the first repeated."""
    rows = table(spark, sf_dir, "documents").where("source is not null and doc_id is not null and lang is not null")
    parts = numbered(rows.select("source", "doc_id", "lang"), "source", "doc_id", ["lang"])
    end = F.when(F.col("part") == F.col("size") - 1, "").otherwise("\n")
    md = F.concat(F.lit("# "), "source", F.lit("\n## "), F.col("doc_id").cast("string"), F.lit("\n"), "lang", end)
    return parts.select("source", F.col("part").cast("int").alias("part"), F.md5(md.cast("binary")).alias("chunk_md5"))
