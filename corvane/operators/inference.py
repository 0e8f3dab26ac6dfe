"""Artifacts inferred from whole texts: headings as a path, page marks, urls and footers, blocks by kind; chunks that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.operators.artifact_graph import diagnostics, graph_nodes
from corvane.operators.quality import holds
from corvane.operators.structure import MAX_CHARS, packed, split_long
from corvane.session import table
from corvane.storage import stored

#: Months of footers, words of definitions, points of kinds, kinds that are no chunks.
MONTHS = "ocak|şubat|subat|mart|nisan|mayıs|mayis|haziran|temmuz|ağustos|agustos|eylül|eylul|ekim|kasım|kasim|aralık|aralik"
PAGE = r"(?i)^#{0,6}\s*Page\s+(\d+)\s*$"
HEADING = r"^(#{1,6})\s+(.+)$"
URL = r"(?i)^https?://\S+$"
WEEK = r"(?i)^hafta\s+\d+(?:\s*[-–]\s*\d+)?$"
DATED = rf"(?i)\b(?:{MONTHS})\s+20\d{{2}}\b"
RIGHTS = [r"(?i)^©\s*copyright\b", r"(?i)^copyright\s+20\d{2}\b", r"(?i)^her hakk[ıi] sakl[ıi]d[ıi]r\.?$", r"(?i)^all rights reserved\.?$"]
DEFINITION = r"\b(?:nedir|ne demek|denir|ifade eder|tanımlanır|tanimlanir|bütünüdür|butunudur)\b"
ORDERED, MARKED = r"^\s*\d+[.)]\s+\S", r"^\s*(?:[-*+]\s+|\d+[.)]\s+)\S"
MARK = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)"
#: First characters of trimmed lines with these patterns.
STARTS = {PAGE: "#pP", URL: "hH", WEEK: "hH"}
SCORES = {
    "page_marker": 2, "title": 24, "heading": 30, "url": 1, "footer": 3, "definition": 92,
    "table": 84, "list": 84, "code_block": 84, "procedure": 84, "paragraph": 68,
}
SCAFFOLD = ["footer", "page_marker", "url", "title", "heading"]
FOOTER_CHARS, LEVELS = 140, 6
#: White space that is trimmed off lines.
SPACES = " \t\r\x0b\x0c\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _begins(line: Column, pattern: str) -> Column:
    """Whether a trimmed line has a pattern of whole lines, which is looked for only where the first character can begin it."""
    return F.substring(line, 1, 1).isin(*STARTS[pattern]) & (holds(line, pattern) if pattern == WEEK else line.rlike(pattern))


def footer(line: Column) -> Column:
    """Whether a trimmed line is a page mark, a week or a short line with a month and year. İ is no letter i here, though Java folds it to one."""
    plain = F.replace(line, F.lit("İ"), F.lit("¤"))
    return _begins(line, PAGE) | _begins(line, WEEK) | ((F.length(line) <= FOOTER_CHARS) & holds(plain, DATED))


def low_value(line: Column) -> Column:
    """Whether a trimmed line only tells of rights, a page, a date or an address."""
    found = footer(line) | _begins(line, URL)
    for pattern in RIGHTS:
        found = found | holds(line, pattern)
    return found


def without_lead(lines: Column) -> Column:
    """Lines of a block but for a first one that ends in a colon with two or more after it."""
    return F.when((F.size(lines) >= 3) & F.element_at(lines, 1).endswith(":"), F.slice(lines, F.lit(2), F.size(lines) - 1)).otherwise(lines)


def kind_of_block(lines: Column) -> Column:
    """code_block, table, procedure, list, definition or paragraph, by the first that fits, of a block's trimmed lines."""
    text, body = F.array_join(lines, "\n"), without_lead(lines)
    fence = F.substring(text, 1, 3)
    code = fence.isin("```", "~~~") & (F.right(text, F.lit(3)) == fence) & (F.length(text) >= 6)
    rows = F.exists(lines, lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) >= 2))
    listed = (F.size(body) >= 2) & F.forall(body, lambda x: x.rlike(MARKED))
    return (
        F.when(code, "code_block").when(rows, "table").when(F.size(F.filter(body, lambda x: x.rlike(ORDERED))) >= 2, "procedure")
        .when(listed, "list").when(holds(F.lower(F.translate(text, "Iİ", "ıi")), DEFINITION, "[nditb]"), "definition").otherwise("paragraph")
    )


def inferred(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, place, id, kind, text, title, page, level, path, items, score, lines: the artifacts of each whole text, in order from 0.

    A line that marks a page, a heading (title at level 1), a url and a footer are artifacts of their own; other lines make blocks up to
    a blank line or one of these. title is the last heading, page the last page number other than 0; path holds the headings that are open: a heading closes
    those of its level and below. Texts are taken as normalised already; key tells them apart. A null, empty or blank text is one empty paragraph
    with score 0. A page number beyond 18 digits leaves the page before.

    Lines are dealt by key once; the open headings are a scan over them, the last heading of each level that no later one of a smaller level closes.
    """
    whole = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    blank = F.btrim(whole, F.lit(SPACES + "\n")) == ""
    # a null line tells of a blank text: a column beside the lines would be worked out from the whole text for each of them
    cut = F.when(blank, F.array(F.lit(None).cast("string"))).otherwise(F.split(whole, "\n"))
    lines = docs.select(F.col(key).alias("doc_id"), F.posexplode(cut).alias("i", "t"))
    lines = lines.select("doc_id", "i", F.col("t").isNull().alias("blank"), F.coalesce(trimmed(F.col("t")), F.lit("")).alias("t"))
    hashes = F.when(F.startswith("t", F.lit("#")), F.length(F.regexp_extract("t", HEADING, 1))).otherwise(0)
    kind = (
        F.when(F.col("blank"), "content").when(F.col("t") == "", "blank").when(_begins(F.col("t"), PAGE), "page_marker").when(hashes == 1, "title")
        .when(hashes > 1, "heading").when(_begins(F.col("t"), URL), "url").when(footer(F.col("t")), "footer").otherwise("content")
    )
    told = lines.withColumns({"line": kind, "depth": F.when(kind.isin("title", "heading"), hashes)})
    bare = trimmed(F.regexp_replace(F.regexp_replace(F.regexp_extract("t", HEADING, 2), r"[ \t]+", " "), r"^#{1,6}\s*", ""))
    number = F.when(F.col("line") == "page_marker", F.regexp_extract("t", PAGE, 1).try_cast("long"))
    told = told.withColumns({"head": F.when(F.col("depth").isNotNull(), F.when(low_value(bare), "").otherwise(bare)), "number": F.when(number != 0, number)})
    ordered = Window.partitionBy("doc_id").orderBy("i")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.when(F.col("line") == "content", F.coalesce(F.lag("line").over(ordered), F.lit("")) != "content").otherwise(F.col("line") != "blank")
    heads = {f"h{n}": F.last(F.when(F.col("depth") == n, F.struct("i", "head")), ignorenulls=True).over(so_far) for n in range(1, LEVELS + 1)}
    scanned = told.withColumns({"starts": starts}).withColumns(
        {
            "place": F.sum(F.col("starts").cast("long")).over(so_far) - 1, "title": F.last("head", ignorenulls=True).over(so_far),
            "page": F.last("number", ignorenulls=True).over(so_far), "last_level": F.last("depth", ignorenulls=True).over(so_far), **heads,
        }
    ).where("line <> 'blank'")
    open_heads = []
    for n in range(1, LEVELS + 1):
        above = F.greatest(*(F.coalesce(F.col(f"h{m}.i"), F.lit(-1)) for m in range(1, n)), F.lit(-1), F.lit(-1))
        open_heads.append(F.when(F.col(f"h{n}.i") > above, F.col(f"h{n}.head")))
    at = scanned.withColumn("path", F.when(F.col("starts"), F.array_compact(F.array(*open_heads))))
    grouped = at.groupBy("doc_id", "place").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("lines"),
        *(F.first(c, ignorenulls=True).alias(c) for c in ("line", "head", "path")), F.first("title").alias("title"), F.first("page").alias("page"), F.first("last_level").alias("last_level"),
    )
    block = F.col("line") == "content"
    text_of = F.when(block, F.array_join("lines", "\n")).when(F.col("line") == "page_marker", F.regexp_replace(F.col("lines")[0], r"^#+\s*", ""))
    shaped = grouped.withColumns({"text": F.coalesce(text_of, "head", F.col("lines")[0]), "kind": F.when(block, kind_of_block(F.col("lines"))).otherwise(F.col("line"))})
    stripped = F.filter(F.transform(without_lead(F.col("lines")), lambda x: trimmed(F.regexp_replace(x, MARK, ""))), lambda x: x != "")
    points = F.create_map(*(F.lit(x) for pair in SCORES.items() for x in pair))
    return shaped.select(
        "doc_id", "place", F.concat(F.lit("artifact-"), F.col("place").cast("string")).alias("id"), "kind", "text", "title", "page",
        F.when(block | F.col("line").isin("title", "heading"), F.col("last_level")).cast("int").alias("level"), "path",
        F.when(F.col("kind").isin("list", "procedure") & (F.size(stripped) > 0), stripped).alias("items"),
        F.when(block & (F.col("text") == ""), 0).otherwise(points[F.col("kind")]).alias("score"), "lines",
    )


def markdown_tables(artifacts: DataFrame) -> DataFrame:
    """The tables of inferred() as structured artifacts for graph_nodes(): cells of lines between pipes, ruler lines left out."""
    rows = F.filter("lines", lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) >= 2) & ~x.rlike(r"^\|[\s:|-]*-[\s:|-]*\|$"))
    cut = F.transform(
        rows,
        lambda x, i: F.struct(
            (i + 1).cast("string").alias("row_id"),
            F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), r"\|"), lambda c, j: F.struct((j + 1).cast("string").alias("column_id"), trimmed(c).alias("text"))).alias("cells"),
        ),
    )
    tables = artifacts.where("kind = 'table'")
    return tables.select("doc_id", "place", "kind", F.concat(F.lit("table-"), F.col("place").cast("string")).alias("id"), F.col("id").alias("artifact_id"), "text", cut.alias("rows"))


def text_graph(artifacts: DataFrame) -> DataFrame:
    """graph_nodes() of inferred(), which is stored: its tops, items, tables and owners are read one by one."""
    artifacts = stored(artifacts, "inferred")
    return graph_nodes(artifacts, markdown_tables(artifacts))


def artifact_chunks(artifacts: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """doc_id, chunk_index, artifact_id, kind, split_index, title, page, path, content, tokens, score of inferred(); scaffold has no chunks.

    An artifact is one chunk; over limit characters a table is cut between rows with its first two lines before each part, anything else
    between lines, sentences or words. A single word or table row over the limit stays whole. A document without anything but scaffold or blanks has none.
    """
    head = F.concat(F.array_join(F.slice("lines", 1, 2), "\n"), F.lit("\n"))
    body = F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0)))
    ruled = (F.col("kind") == "table") & (F.size("lines") > 2) & F.col("lines")[1].rlike(r"^\|[\s:|-]*-[\s:|-]*\|$")
    by_row = F.transform(packed(body, F.greatest(limit - F.length(head), F.lit(1)), "\n"), lambda x: F.concat(head, x))
    by_line = packed(F.flatten(F.transform("lines", lambda x: split_long(x, limit))), limit, "\n")
    pieces = F.when(F.length("text") <= limit, F.array("text")).when(ruled, by_row).otherwise(by_line)
    # no filter, which would work out kind and text once more
    kept = F.when(~F.col("kind").isin(SCAFFOLD) & (F.col("text") != ""), pieces)
    cut = artifacts.select(
        "doc_id", "place", F.col("id").alias("artifact_id"), "kind", "title", "page", "path", "score", F.posexplode(kept).alias("split_index", "content")
    )
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "split_index")) - 1
    return cut.withColumns({"chunk_index": at, "tokens": F.greatest(F.lit(1), F.ceil(F.length("content") / 4)).cast("long")}).drop("place")


def _md5(c: str | Column) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TRIM = "' ' || chr(9) || chr(13) || chr(11) || chr(12) || '" + SPACES[5:] + "'"
_FOOT = f"(regexp_matches(t, {_quoted(PAGE)}) OR regexp_matches(t, {_quoted(WEEK)}) OR (length(t) <= {FOOTER_CHARS} AND regexp_matches(t, {_quoted(DATED)})))"
_LOW = " OR ".join([_FOOT, f"regexp_matches(t, {_quoted(URL)})", *(f"regexp_matches(t, {_quoted(p)})" for p in RIGHTS)])
_HEADS = ", ".join(f"max(CASE WHEN depth = {n} THEN i END) OVER w AS h{n}" for n in range(1, LEVELS + 1))
_OPEN = ", ".join(
    "CASE WHEN h{0} > greatest(-1{1}) THEN h{0} END".format(n, "".join(f", coalesce(h{m}, -1)" for m in range(1, n))) for n in range(1, LEVELS + 1)
)
_BODY = "(CASE WHEN len(ls) >= 3 AND ends_with(ls[1], ':') THEN ls[2:] ELSE ls END)"


@query(
    "structure_inferred_artifacts",
    f"""WITH l AS (SELECT doc_id, trim(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), {_TRIM} || chr(10)) = '' AS b, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents),
    x AS (SELECT doc_id, b, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT doc_id, b, CASE WHEN b THEN [''] ELSE l END AS l FROM l)),
    y AS (SELECT doc_id, b, i, trim(t, {_TRIM}) AS t FROM x),
    k AS (SELECT *, length(regexp_extract(t, {_quoted(HEADING)}, 1)) AS n FROM y),
    m AS (SELECT *, CASE WHEN b THEN 'content' WHEN t = '' THEN 'blank' WHEN regexp_matches(t, {_quoted(PAGE)}) THEN 'page_marker' WHEN n = 1 THEN 'title' WHEN n > 1 THEN 'heading' WHEN regexp_matches(t, {_quoted(URL)}) THEN 'url' WHEN {_FOOT} THEN 'footer' ELSE 'content' END AS line FROM k),
    d AS (SELECT * EXCLUDE (t), t AS t0, CASE WHEN line IN ('title', 'heading') THEN n END AS depth, trim(regexp_replace(regexp_replace(regexp_extract(t, {_quoted(HEADING)}, 2), '[ \\t]+', ' ', 'g'), '^#{{1,6}}\\s*', ''), {_TRIM}) AS t, CASE WHEN line = 'page_marker' THEN nullif(try_cast(regexp_extract(t, {_quoted(PAGE)}, 1) AS BIGINT), 0) END AS number FROM m),
    e AS (SELECT doc_id, i, t0 AS t, line, depth, number, CASE WHEN depth IS NOT NULL THEN CASE WHEN {_LOW} THEN '' ELSE t END END AS head,
      CASE WHEN line = 'content' THEN coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY i), '') <> 'content' ELSE line <> 'blank' END AS starts FROM d),
    s AS (SELECT *, CAST(sum(CAST(starts AS INTEGER)) OVER w AS BIGINT) - 1 AS place, last_value(head IGNORE NULLS) OVER w AS title, last_value(number IGNORE NULLS) OVER w AS page, last_value(depth IGNORE NULLS) OVER w AS level, {_HEADS}
      FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    g AS (SELECT doc_id, place, list(t ORDER BY i) AS ls, min(line) AS line, min(head) AS head, min(title) AS title, min(page) AS page, min(level) AS level, max(CASE WHEN starts THEN len(list_filter([{_OPEN}], lambda h: h IS NOT NULL)) END) AS n_open FROM s WHERE line <> 'blank' GROUP BY ALL),
    c AS (SELECT *, array_to_string(ls, chr(10)) AS bt, CASE WHEN line <> 'content' THEN line
      WHEN substr(array_to_string(ls, chr(10)), 1, 3) IN ('```', '~~~') AND right(array_to_string(ls, chr(10)), 3) = substr(array_to_string(ls, chr(10)), 1, 3) AND length(array_to_string(ls, chr(10))) >= 6 THEN 'code_block'
      WHEN len(list_filter(ls, lambda z: starts_with(z, '|') AND ends_with(z, '|') AND length(z) >= 2)) > 0 THEN 'table'
      WHEN len(list_filter({_BODY}, lambda z: regexp_matches(z, {_quoted(ORDERED)}))) >= 2 THEN 'procedure'
      WHEN len({_BODY}) >= 2 AND len(list_filter({_BODY}, lambda z: NOT regexp_matches(z, {_quoted(MARKED)}))) = 0 THEN 'list'
      WHEN regexp_matches(lower(translate(array_to_string(ls, chr(10)), 'Iİ', 'ıi')), {_quoted(DEFINITION)}) THEN 'definition' ELSE 'paragraph' END AS kind FROM g),
    f AS (SELECT *, CASE WHEN line = 'content' THEN bt WHEN line = 'page_marker' THEN regexp_replace(ls[1], '^#+\\s*', '') ELSE coalesce(head, ls[1]) END AS out FROM c)
    SELECT doc_id, place, kind, md5(out) AS text_md5, md5(coalesce(title, '-')) AS title_md5, page, CASE WHEN line IN ('content', 'title', 'heading') THEN CAST(level AS INTEGER) END AS level, CAST(n_open AS INTEGER) AS open_headings,
    CAST(CASE WHEN kind IN ('list', 'procedure') THEN len(list_filter({_BODY}, lambda z: trim(regexp_replace(z, {_quoted(MARK)}, ''), {_TRIM}) <> '')) ELSE 0 END AS INTEGER) AS items,
    CAST(CASE WHEN line = 'content' AND out = '' THEN 0 ELSE CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SCORES.items())} END END AS INTEGER) AS score FROM f""",
)
def structure_inferred_artifacts(spark, sf_dir):
    """The artifacts of all documents."""
    a = inferred(table(spark, sf_dir, "documents"))
    return a.select(
        "doc_id", "place", "kind", _md5("text").alias("text_md5"), _md5(F.coalesce("title", F.lit("-"))).alias("title_md5"), "page", "level",
        F.size("path").alias("open_headings"), F.coalesce(F.array_size("items"), F.lit(0)).alias("items"), "score",
    )


@query("structure_artifact_chunks")
def structure_artifact_chunks(spark, sf_dir):
    """Chunks of all documents that follow their artifacts."""
    c = artifact_chunks(inferred(table(spark, sf_dir, "documents")))
    return c.select("doc_id", "chunk_index", "artifact_id", "kind", "split_index", "page", F.size("path").alias("open_headings"), "tokens", "score", _md5("content").alias("md5"))


@query("graph_document_diagnostics")
def graph_document_diagnostics(spark, sf_dir):
    """Nodes, edges and kinds of the graphs of all documents."""
    d = diagnostics(text_graph(inferred(table(spark, sf_dir, "documents"))))
    return d.select("doc_id", "nodes", "edges", "roots", "orphans", "renamed", F.to_json("kinds").alias("kinds"))
