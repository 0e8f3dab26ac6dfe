"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index stores the postings (row, position) of the training tokens that occur in the benchmark, written once
to the shared folder. A window of benchmark words is looked up from its rarest term in the training data: each
of that term's postings, less the term's offset in the window, is a place where the window could begin. The
places are then intersected with the offset-adjusted postings of the other terms; what keeps all is a match.

Words: A-Z are lower-cased and words are runs of 0-9, A-Z, a-z and characters above U+007F.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, number_rows, unused

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A benchmark with at most so many distinct words is sent to every task; a larger one is joined by word.
BROADCAST_TERMS = 200_000
#: The like for the terms of its windows.
BROADCAST_WINDOWS = 500_000


def _sent(side: DataFrame, most: int) -> DataFrame:
    """side, to be sent to every task if it has at most so many rows: then a frequent key of the other side needs no shuffle."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def _folded(word: Column) -> Column:
    """A-Z lower-cased, other characters as they are; only words that lower() changes are translated."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """item_id, window_id, offset, word: all windows of size words; an item of fewer words is one window, of none none.

    Windows with the same words share a window_id within an item; a null text has no words.
    """
    words = benchmark.select("item_id", F.transform(_words(F.col("text")), _folded).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("w")).distinct()
    return cut.select("item_id", F.sha2(F.to_json("w"), 256).alias("window_id"), F.posexplode("w").alias("offset", "word"))


def build_index(docs: DataFrame, terms: DataFrame, row: str | None = None) -> DataFrame:
    """The stored index: doc_id, row, n_words, pos, term_id for each occurrence of a term (term_id, word) in docs.

    row numbers the rows of docs, so that repeated doc_ids stay apart; a column of docs may give it. Each row of docs also has an entry
    with no term (at its first position, null if it has no words), which carries n_words.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    listed = docs.select(F.col("doc_id").cast("long"), number.alias("row"), _words(F.col("text")).alias("w"))
    tokens = listed.select("doc_id", "row", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    found = tokens.withColumn("word", _folded(F.col("word"))).join(_sent(terms, BROADCAST_TERMS), "word", "left")
    found = found.where("term_id is not null or pos is null or pos = 0").drop("word")
    return materialize(found, "postings")


def _starts(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """window, row, base of the exact matches; wanted: window, offset, term_id, n (terms of the window).

    The rarest term's postings give the places; the next rarest ones thin them out term by term, and the
    rest is counted in one join.
    """
    counts = materialize(index.where("term_id is not null").groupBy("term_id").agg(F.count("*").alias("df")), "frequencies")
    ranked = wanted.join(_sent(counts, BROADCAST_TERMS), "term_id", "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("df", F.lit(0)), "offset"))
    )
    missing = ranked.where("df is null").select("window").distinct()  # a word that no document has
    ranked = materialize(ranked.join(missing, "window", "left_anti").select("window", "offset", "term_id", "n", "rank"), "ranked")
    postings = index.where("term_id is not null").select("row", "pos", "term_id", "n_words")
    rarest = _sent(ranked.where("rank = 1").withColumnRenamed("offset", "at"), BROADCAST_WINDOWS)
    places = (
        postings.join(rarest, "term_id")
        .withColumn("base", F.col("pos") - F.col("at"))
        .where((F.col("base") >= 0) & (F.col("base") + F.col("n") <= F.col("n_words")))
        .select("window", "row", "base")
    )
    held = postings.select("row", "pos", "term_id")  # shuffled once in a plan, for all that are met with it
    second = _sent(ranked.where("rank = 2").select("window", "offset", "term_id", "n"), BROADCAST_WINDOWS)
    thinned = (
        places.join(second, "window")
        .select("window", "row", "base", "n", "term_id", (F.col("base") + F.col("offset")).alias("pos"))
        .join(held, ["row", "pos", "term_id"], "left_semi")
    )
    rest = _sent(ranked.where("rank > 2").select("window", "offset", "term_id"), BROADCAST_WINDOWS)
    found = (
        thinned.where("n > 2")
        .select("window", "row", "base", "n")
        .join(rest, "window")
        .select("window", "row", "base", "n", "term_id", (F.col("base") + F.col("offset")).alias("pos"))
        .join(held, ["row", "pos", "term_id"], "left_semi")
        .groupBy("window", "row", "base")
        .agg(F.count("*").alias("kept"), F.first("n").alias("n"))
        .where("kept = n - 2")
        .select("window", "row", "base")
    )
    sizes = {r.n for r in ranked.where("n <= 2").select("n").distinct().collect()}
    if 2 in sizes:
        found = found.union(thinned.where("n = 2").select("window", "row", "base"))
    if 1 in sizes:
        found = found.union(places.join(_sent(ranked.where("n = 1").select("window"), BROADCAST_WINDOWS), "window", "left_semi"))
    return found


def _prepare(docs: DataFrame, benchmark: DataFrame, size: int, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, wanted, items): items links each window to the items that have it."""
    cut = materialize(windows(benchmark, size), "windows")
    numbered = cut.select("window_id").distinct().select("window_id", F.monotonically_increasing_id().alias("window"))
    numbered = materialize(numbered, "windows")
    terms = materialize(cut.select("word").distinct().select("word", F.monotonically_increasing_id().cast("long").alias("term_id")), "terms")
    sizes = Window.partitionBy("window")
    wanted = cut.select("window_id", "offset", "word").distinct().join(numbered, "window_id").join(terms, "word")
    wanted = wanted.select("window", "offset", "term_id", F.count("*").over(sizes).alias("n"))
    items = cut.select("item_id", "window_id").distinct().join(numbered, "window_id").select("item_id", "window")
    return build_index(docs, terms, row), materialize(wanted, "wanted"), materialize(items, "items")


def exact_matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, index): matches has item_id, doc_id, row, base, n for every place of every window."""
    index, wanted, items = _prepare(docs, benchmark, size, row)
    lengths = wanted.select("window", "n").distinct()
    owners = index.where("pos is null or pos = 0").groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    starts = _starts(index, wanted).join(lengths, "window").join(owners, "row")
    return starts.join(items, "window").select("item_id", "doc_id", "row", "base", "n"), index


def proximity_matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 5) -> DataFrame:
    """item_id, doc_id, row, at: windows all of whose distinct terms occur, in any order, within size + slop words.

    at is a posting of the window's rarest term. It is met with the postings of the other terms at most
    size + slop away (both sides are cut into position cells of that width), and a span is accepted if
    some stretch of size + slop words around it holds every distinct term.
    """
    index, wanted, items = _prepare(docs, benchmark, size)
    reach = size + slop
    terms = wanted.groupBy("window", "term_id").agg(F.min("offset").alias("offset"))
    counts = index.where("term_id is not null").groupBy("term_id").agg(F.count("*").alias("df"))
    sized = Window.partitionBy("window")
    ranked = terms.join(counts, "term_id", "left").select(
        "window", "term_id", F.count("*").over(sized).alias("k"), F.row_number().over(sized.orderBy(F.coalesce("df", F.lit(0)), "offset")).alias("rank")
    )
    postings = index.where("term_id is not null").select("row", "doc_id", "pos", "term_id", F.floor(F.col("pos") / reach).alias("cell"))
    seeds = postings.join(ranked.where("rank = 1").select("window", "term_id", "k"), "term_id").select(
        "window", "k", "row", "doc_id", F.col("pos").alias("at"), F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("cell")
    )
    near = (
        seeds.join(ranked.select("window", "term_id"), "window")
        .join(postings.drop("doc_id"), ["row", "cell", "term_id"])
        .where(F.abs(F.col("pos") - F.col("at")) < reach)
    )
    spans = near.select("*", F.explode(F.sequence(F.greatest(F.col("at") - reach + 1, F.col("pos") - reach + 1), F.least("at", "pos"))).alias("first"))
    full = spans.groupBy("window", "k", "row", "doc_id", "at", "first").agg(F.count_distinct("term_id").alias("held")).where("held = k")
    return full.join(items, "window").select("item_id", "doc_id", "row", "at").distinct()


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, row: str | None = None) -> DataFrame:
    """doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    A document word inside any occurrence of a window is hit. items_sha256 digests the ids of the items with
    occurring windows, as strings, sorted and joined by commas (none: of the empty string). A null text has
    no words; an empty benchmark hits nothing; repeated doc_ids have a row each. row: a column of docs that numbers them.
    """
    matches, index = exact_matches(docs, benchmark, size, row)
    matches = materialize(matches, "matches")
    hit = (
        matches.select("row", "base", "n")
        .distinct()
        .select("row", F.explode(F.sequence("base", F.col("base") + F.col("n") - 1)).alias("pos"))
        .groupBy("row", "pos")
        .agg(F.lit(1).alias("one"))
        .groupBy("row")
        .agg(F.count("*").alias("n_hit"))
    )
    items = matches.select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    rows = index.where("pos is null or pos = 0").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    found = rows.join(hit, "row", "left").join(items, "row", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        "row",
        F.greatest(F.col("n_words"), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs without those whose own text holds a benchmark window."""
    row = unused(docs, "_row")
    numbered = number_rows(docs, row, "zstd")
    bad = report(numbered, benchmark, size, row).where("contaminated").select(F.col("row").alias(row))
    return numbered.join(bad, row, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what each document holds of the benchmark's 10-word windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")


_CLASS = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_CLASS}')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n
),
hits AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM spots) JOIN win USING (n, s)
),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
