"""Sources: text, Markdown, JSON, JSONL, CSV, HTML, Parquet, uploads, instruction data and relations."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.catalog import query
from corvane.functions.numbers import local_number, value_type
from corvane.session import table

#: Parsers by file ending: the smallest priority that is available serves.
CAPABILITIES = [("txt", "text", 1, True), ("md", "markdown", 1, True), ("json", "json", 1, True), ("csv", "csv", 1, True), ("html", "html", 1, True), ("html", "text", 2, True), ("pdf", "external", 1, False), ("xlsx", "spreadsheet", 1, False)]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file, .txt and .md alike."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """path, json: the canonical form of each file; null for one that is no JSON."""
    raw = read_text(spark, path)
    return raw.select("path", F.to_json(F.try_parse_json("text")).alias("json"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a line, with _corrupt_record for lines that don't fit the schema."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def sniff_delimiter(text: Column) -> Column:
    """The one of , ; and tab that the first twelve lines hold most of; a comma if they hold none."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 12), "\n")
    counts = F.array(*[F.struct(F.size(F.split(head, f"[{d}]")).alias("n"), F.lit(-i).alias("i"), F.lit(d.replace("\\t", "\t")).alias("d")) for i, d in enumerate([",", ";", "\\t"])])
    return F.element_at(F.sort_array(counts, asc=False), 1)["d"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all files of path, each cut at its own file's delimiter; columns by name, null where a file lacks one.

    The driver gets the paths and delimiters, one row for each distinct header and delimiter, and no content.
    """
    heads = read_text(spark, path).select(F.input_file_name().alias("file"), sniff_delimiter(F.col("text")).alias("d"))
    found = None
    for d in sorted(r.d for r in heads.select("d").distinct().collect()):
        files = [r.file for r in heads.where(F.col("d") == d).select("file").distinct().collect()]
        part = spark.read.csv(files, sep=d, header=True, quote='"', escape='"', multiLine=True)
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found if found is not None else spark.read.csv(path, header=True)


def column_letters(i: int) -> str:
    """A, B, to Z, AA, AB and so on for columns numbered from 0."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, address, header, text, kind, value: every cell of rows with its A1 address; rows are numbered by key."""
    parts = F.array(*[F.struct(F.lit(column_letters(i)).alias("letter"), F.lit(c).alias("header"), F.col(c).cast("string").alias("text")) for i, c in enumerate(columns)])
    each = rows.select(key, F.explode(parts).alias("c"))
    address = F.concat("c.letter", (F.col(key) + 2).cast("string"))
    return each.select(key, address.alias("address"), "c.header", "c.text", value_type(F.col("c.text")).alias("kind"), local_number(F.col("c.text")).alias("value"))


class _Text(HTMLParser):
    """Text of an HTML page: blocks become lines, script and style go."""

    BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "tr", "br", "ul", "ol", "section", "article", "nav", "footer", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(StringType())
def html_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text of HTML pages; null stays null."""

    def one(html):
        if html is None:
            return None
        p = _Text()
        p.feed(html)
        lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
        return "\n".join(x for x in lines if x)

    for batch in pages:
        yield batch.map(one, na_action=None)


def choose_parser(files: DataFrame) -> DataFrame:
    """files (path) with parser: the available one of least priority for the ending, else null."""
    caps = files.sparkSession.createDataFrame(CAPABILITIES, "ending string, parser string, priority int, available boolean")
    usable = caps.where("available").groupBy("ending").agg(F.min_by("parser", "priority").alias("parser"))
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("ending", ending).join(F.broadcast(usable), "ending", "left")


def upload_problems(path: Column, content: Column, most: int = 20_000_000) -> Column:
    """What speaks against an upload: its magic bytes, UTF-8, JSON or size."""
    magic, text = F.hex(F.substring(content, 1, 4)), F.try_validate_utf8(content.cast("string"))
    low = F.lower(path)
    return F.array_compact(
        F.array(
            F.when(F.length(content) > most, "too-large"),
            F.when(F.length(content) == 0, "empty"),
            F.when(low.endswith(".pdf") & (magic != "25504446"), "not-pdf"),
            F.when(low.rlike(r"\.(docx|xlsx|pptx)$") & (magic != "504B0304"), "not-zip"),
            F.when(low.rlike(r"\.(txt|md|csv|json)$") & (text.isNull() | F.contains(text, F.lit("\0"))), "not-text"),
            F.when(low.endswith(".json") & F.try_parse_json(text).isNull(), "not-json"),
        )
    )


def land(files: DataFrame, raw_path: str, quarantine_path: str) -> None:
    """Writes uploads (path, content) by their SHA-256, each content once, and those with problems apart."""
    marked = files.withColumns({"sha256": F.sha2("content", 256), "bytes": F.length("content"), "problems": upload_problems(F.col("path"), F.col("content"))})
    marked.where("size(problems) > 0").write.mode("append").parquet(quarantine_path)
    marked.where("size(problems) = 0").groupBy("sha256").agg(F.min(F.struct("path", "bytes", "content")).alias("f")).select("sha256", "f.*").write.mode("append").parquet(raw_path)


def read_projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of Parquet files, rows with a null left out; both reach the scan."""
    return spark.read.parquet(path).select(*columns).dropna()


def read_relation(spark: SparkSession, url: str, name: str, properties: dict[str, str], column: str, low: int, high: int, parts: int) -> DataFrame:
    """A relation over JDBC, read in ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def instruction_pairs(rows: DataFrame) -> DataFrame:
    """conv_id, system, instruction, output of turns (conv_id, turn, role, text): texts of a role joined in order."""
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def of(role):
        return F.array_join(F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: x["text"]), "\n\n")

    return listed.select("conv_id", of("system").alias("system"), of("user").alias("instruction"), of("assistant").alias("output"))


@query(
    "source_parser_choice",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'text' WHEN 2 THEN NULL ELSE 'csv' END AS parser FROM pages""",
)
def source_parser_choice(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ["a.html", "b.TXT", "c.xlsx", "d.csv"])), (F.col("page_id") % 4 + 1).cast("int"))
    return choose_parser(table(spark, sf_dir, "pages").select("page_id", names.alias("path"))).select("page_id", "parser")


@query(
    "source_upload_validation",
    """SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS INTEGER) AS bytes, CASE WHEN strlen(text) > 20000 THEN 'too-large' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN CASE WHEN strlen(text) > 20000 THEN ',' ELSE '' END || 'not-pdf' ELSE '' END AS problems FROM documents""",
)
def source_upload_validation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.when(F.col("doc_id") % 3 == 0, "x.pdf").otherwise("x.txt").alias("path"))
    return d.select("doc_id", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), F.array_join(upload_problems(F.col("path"), F.col("content"), 20000), ",").alias("problems"))


@query(
    "source_typed_cells",
    """SELECT o_orderkey, 'A' || (o_orderkey + 2) AS address, 'number' AS kind, o_totalprice AS value FROM orders UNION ALL
    SELECT o_orderkey, 'B' || (o_orderkey + 2), 'date', NULL FROM orders UNION ALL SELECT o_orderkey, 'C' || (o_orderkey + 2), 'text', NULL FROM orders""",
)
def source_typed_cells(spark, sf_dir):
    """Orders as spreadsheet rows: an address, kind and number for each cell."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    c = cells(o, "o_orderkey", ["price", "day", "o_orderpriority"])
    return c.select("o_orderkey", "address", "kind", F.when(F.col("kind") == "number", F.col("value")).alias("value"))


@query("source_projected", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IS NOT NULL AND c_name IS NOT NULL")
def source_projected(spark, sf_dir):
    return read_projected(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_name"])


@query(
    "source_instruction_pairs",
    """SELECT conv_id, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) FILTER (role = 'user'), '')) AS instruction_md5, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS output_md5 FROM conversations GROUP BY 1""",
)
def source_instruction_pairs(spark, sf_dir):
    p = instruction_pairs(table(spark, sf_dir, "conversations"))
    return p.select("conv_id", F.md5(F.col("instruction").cast("binary")).alias("instruction_md5"), F.md5(F.col("output").cast("binary")).alias("output_md5"))


@query("source_html_text")
def source_html_text(spark, sf_dir):
    """Page texts by the standard library's parser: tests hold them against small pages."""
    t = table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))
    return t.select("page_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("source_vector_scan", "SELECT label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY 1")
def source_vector_scan(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query(
    "source_relational_chunks",
    """SELECT d.doc_id, d.source, l.quality, l.toxic, e.label, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id DESC) AS newest FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def source_relational_chunks(spark, sf_dir):
    d, lab, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "embeddings")
    joined = d.join(lab, "doc_id", "left").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    return joined.select("doc_id", "source", "quality", "toxic", "label", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id"))).alias("newest"))
