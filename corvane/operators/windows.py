"""Window operators, ordered picks and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.session import table
from corvane.storage import stored


def islands(lines: DataFrame, key: str, order: str, boundary) -> DataFrame:
    """Adds block: it grows by one at each row that is a boundary."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(boundary.cast("int")).over(w))


def scaled(rows: DataFrame, key: str, score: str, out: str) -> DataFrame:
    """Min-max within key; 0.5 where all scores are equal."""
    w = Window.partitionBy(key)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn(out, F.when(high - low < 1e-9, 0.5).otherwise((F.col(score) - low) / (high - low)))


def numbered_ranges(rows: DataFrame, key: str, lead: list[str], last: str) -> DataFrame:
    """Adds rank, the place of each row within key by lead and then last, a number: no task holds more than a range of rows.

    Rows of equal key and lead are dealt into ranges of last between bounds that are fixed first; only the ranges' sizes are
    added up in one place.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    bounds = rows.agg(F.percentile_approx(last, [i / n for i in range(1, n)]).alias("b")).first().b or []
    below = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<long>")
    cell = [key, *lead, "_range"]
    ranged = rows.withColumn("_range", F.size(F.filter(below, lambda b: b < F.col(last))))
    before = Window.partitionBy(key).orderBy(*lead, "_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy(*cell).agg(F.count("*").alias("_n")).select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(last))
    return ranged.withColumn("_at", inside).join(bases, cell).withColumn("rank", F.col("_at") + F.col("_base")).drop("_range", "_at", "_base")


def balanced_sample(rows: DataFrame, source: str, order: list, cap: int, n: int) -> DataFrame:
    """n rows taken from the sources in turn, cap of each at most."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("turn") <= cap)
    return ranked.orderBy("turn", source).limit(n)


def first_of_equals(rows: DataFrame, key: list, order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i FROM documents"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))


@query(
    "window_latest_version",
    """SELECT o_custkey, o_orderkey, version + 1 AS next_version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def window_latest_version(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), (F.count("*") + 1).alias("next_version"))


@query(
    "window_id_suffixes",
    """SELECT event_id, event_type || CASE WHEN rn = 1 THEN '' ELSE '-' || rn END AS uid FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)""",
)
def window_id_suffixes(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    ev = table(spark, sf_dir, "events").withColumn("n", n)
    return ev.select("event_id", F.concat("event_type", F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("-"), F.col("n").cast("string")))).alias("uid"))


@query(
    "window_index_integrity",
    """SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS duplicate, l_linenumber <> dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS gap FROM lineitem""",
)
def window_index_integrity(spark, sf_dir):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber")) > 1).alias("duplicate"),
        (F.col("l_linenumber") != F.dense_rank().over(by)).alias("gap"),
    )


@query(
    "window_carry_forward",
    f"""SELECT doc_id, i AS line, last_value(CASE WHEN length(t) < 60 AND t <> '' THEN md5(t) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading_md5 FROM ({_LINES})""",
)
def window_carry_forward(spark, sf_dir):
    """The last short line before each line, as its heading."""
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when((F.length("t") < 60) & (F.col("t") != ""), F.md5(F.col("t").cast("binary")))
    return _lines(spark, sf_dir).select("doc_id", F.col("i").alias("line"), F.last(head, ignorenulls=True).over(w).alias("heading_md5"))


@query(
    "window_blocks",
    f"""SELECT doc_id, block, count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT *, CAST(sum(CASE WHEN length(t) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block FROM ({_LINES})) GROUP BY ALL""",
)
def window_blocks(spark, sf_dir):
    b = islands(_lines(spark, sf_dir), "doc_id", "i", F.length("t") < 60)
    return b.groupBy("doc_id", "block").agg(F.count("*").alias("lines"), F.sum(F.length("t")).alias("chars"))


@query(
    "window_neighbourhood",
    f"""SELECT doc_id, i AS line, max(CASE WHEN contains(lower(t), 'licen') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS near FROM ({_LINES})""",
)
def window_neighbourhood(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(-8, 8)
    return _lines(spark, sf_dir).select("doc_id", F.col("i").alias("line"), F.max(F.contains(F.lower("t"), F.lit("licen")).cast("int")).over(w).alias("near"))


@query(
    "window_min_max",
    """SELECT event_id, round(CASE WHEN h - l < 1e-9 THEN 0.5 ELSE (value - l) / (h - l) END, 9) AS scaled FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS l, max(value) OVER (PARTITION BY user_id) AS h FROM events)""",
)
def window_min_max(spark, sf_dir):
    return scaled(table(spark, sf_dir, "events"), "user_id", "value", "scaled").select("event_id", F.round("scaled", 9).alias("scaled"))


@query(
    "window_round_robin",
    """SELECT doc_id, source, rn AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 5 ORDER BY rn, source LIMIT 60""",
)
def window_round_robin(spark, sf_dir):
    return balanced_sample(table(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), "doc_id"], 5, 60).select("doc_id", "source", "turn")


@query(
    "window_topic_cap",
    """SELECT lang, count(*) FILTER (rn <= 50) AS kept, count(*) FILTER (rn > 50) AS over_cap FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) GROUP BY 1""",
)
def window_topic_cap(spark, sf_dir):
    """A cap for each topic, with what it drops accounted for."""
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return c.select("lang", F.least("n", F.lit(50)).cast("long").alias("kept"), F.greatest(F.col("n") - 50, F.lit(0)).cast("long").alias("over_cap"))


@query(
    "window_split",
    """SELECT conv_id, CASE WHEN rn <= 20 THEN 'dev' ELSE 'train' END AS part FROM (SELECT conv_id, row_number() OVER (ORDER BY md5(CAST(conv_id AS VARCHAR)), conv_id) AS rn FROM (SELECT DISTINCT conv_id FROM conversations))""",
)
def window_split(spark, sf_dir):
    """The twenty first by hash are held out: found by a bounded top-k, joined back, with no global window."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    dev = c.orderBy(F.md5(F.col("conv_id").cast("string").cast("binary")), "conv_id").limit(20).select(F.col("conv_id").alias("dev"))
    return c.join(F.broadcast(dev), c.conv_id == dev.dev, "left").select("conv_id", F.when(F.col("dev").isNotNull(), "dev").otherwise("train").alias("part"))


@query(
    "window_bucket_quota",
)
def window_bucket_quota(spark, sf_dir):
    """Up to three rows of each bucket by score, in the buckets' order, no row twice, then filled to 20 by score.

    The pick is greedy across buckets, so it runs on what any bucket or the fill could take: its first rows by score,
    a number that the quotas bound.
    """
    from collections.abc import Iterator

    import pandas as pd

    quota, n = 3, 20
    o = table(spark, sf_dir, "orders")
    tags = F.array_compact(F.array(F.when(F.col("o_totalprice") > 300000, "large"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_orderstatus") == "F", "filled"), F.lit("rest")))
    each = o.select("o_orderkey", "o_totalprice", F.posexplode(tags).alias("at", "bucket"))
    order = Window.partitionBy("bucket").orderBy(F.desc("o_totalprice"), "o_orderkey")
    near = each.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n + 4 * quota)

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        chosen: dict[int, str] = {}
        for bucket in ("large", "urgent", "filled"):
            got = 0
            for r in rows[rows.bucket == bucket].sort_values("rn").itertuples():
                if got < quota and r.o_orderkey not in chosen:
                    chosen[r.o_orderkey] = bucket
                    got += 1
        for r in rows[rows.bucket == "rest"].sort_values("rn").itertuples():
            if len(chosen) < n:
                chosen.setdefault(r.o_orderkey, "fill")
        yield pd.DataFrame({"o_orderkey": list(chosen), "taken_as": list(chosen.values())})

    return near.select("o_orderkey", "bucket", "rn").repartition(1).mapInPandas(pick, "o_orderkey long, taken_as string")


@query("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24")
def sort_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(24).select("o_orderkey", "o_totalprice")


@query(
    "sort_tie_breaks",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, floor(o_totalprice / 50000) DESC, o_orderkey) AS rank FROM orders""",
)
def sort_tie_breaks(spark, sf_dir):
    """Every row ranked within its status, which are few: rows are dealt into ranges of the order and counted range by range."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (-F.floor(F.col("o_totalprice") / 50000)).alias("band"), "o_orderkey")
    return numbered_ranges(rows, "o_orderstatus", ["o_orderpriority", "band"], "o_orderkey").select("o_orderkey", F.col("rank").cast("int").alias("rank"))


def collated_ranks(rows: DataFrame, key: str, name: str, locale: str = "tr") -> DataFrame:
    """key, name, rank: the place of each row's name within its key in a language's order (ç after c, ı before i, case last), equal names by their bytes.

    The collation is part of the sort key, so ranges, sorts and window order all follow it. Rows are dealt into stored ranges and
    numbered there; only the ranges' sizes are added up in one place.
    """
    place = F.collate(F.col(name), locale)
    ranged = stored(rows.select(key, name).repartitionByRange(key, place, name).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    bases = sizes.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    at = F.row_number().over(Window.partitionBy("_range", key).orderBy(place, name))
    both = ranged.withColumn("_at", at).join(bases, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return both.select(key, name, (F.col("_at") + F.col("_base")).alias("rank"))


@query(
    "sort_collated",
    """WITH w AS (SELECT DISTINCT lang, unnest(string_split_regex(text, '[^\\p{L}]+')) AS word FROM documents)
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY word COLLATE tr, word) AS rank FROM w WHERE word <> ''""",
)
def sort_collated(spark, sf_dir):
    """All words of a language's documents in Turkish order."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where("word != ''").distinct()
    return collated_ranks(words, "lang", "word").withColumn("rank", F.col("rank").cast("long"))


@query(
    "sort_keyset_page",
    "SELECT event_id FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20', 0) ORDER BY ts DESC, event_id DESC LIMIT 26",
)
def sort_keyset_page(spark, sf_dir):
    cursor = F.struct(F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit(0).cast("long").alias("event_id"))
    return table(spark, sf_dir, "events").where(F.struct("ts", "event_id") < cursor).orderBy(F.desc("ts"), F.desc("event_id")).limit(26).select("event_id")


@query(
    "sort_two_stage",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders), s AS (SELECT *, length(o_orderpriority) * o_totalprice AS full_score FROM c WHERE rn <= 8)
    SELECT o_custkey, arg_max(o_orderkey, full_score) AS best FROM s GROUP BY 1""",
)
def sort_two_stage(spark, sf_dir):
    """A cheap score keeps eight rows a key; only they get the full one. Of equal ones the first by the cheap score stays."""
    cheap = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rn <= 8")
    return cheap.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(F.length("o_orderpriority") * F.col("o_totalprice"), -F.col("rn"))).alias("best"))


@query("sort_fifo", "SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 10")
def sort_fifo(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'signup'").orderBy("ts", "event_id").limit(10).select("event_id")


@query(
    "sort_absolute_impact",
    "WITH s AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS d, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CAST(d AS BIGINT) AS d, n FROM s ORDER BY abs(d) DESC, n DESC, user_id LIMIT 15",
)
def sort_absolute_impact(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "error", -1).otherwise(1)).alias("d"), F.count("*").alias("n"))
    return s.orderBy(F.desc(F.abs("d")), F.desc("n"), "user_id").limit(15)


@query(
    "set_union_channels",
    "SELECT event_type, 1 AS priority, count(*) AS n FROM events WHERE value > 50 GROUP BY 1 UNION ALL SELECT event_type, 2, count(*) FROM events WHERE value <= 50 GROUP BY 1",
)
def set_union_channels(spark, sf_dir):
    ev = table(spark, sf_dir, "events")

    def part(where, priority):
        return ev.where(where).groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.lit(priority).alias("priority"), "n")

    return part("value > 50", 1).unionByName(part("value <= 50", 2))


@query(
    "set_ordered_distinct",
    """WITH w AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w, generate_subscripts(string_split_regex(lower(text), '[^a-z]+'), 1) AS i FROM benchmark),
    f AS (SELECT item_id, w, min(i) AS i FROM w WHERE w <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS rn FROM f)
    SELECT item_id, string_agg(w, ' ' ORDER BY rn) AS words FROM r WHERE rn <= 10 GROUP BY 1""",
)
def set_ordered_distinct(spark, sf_dir):
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda t: t != ""))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(w, 1, 10), " ").alias("words")).where("words != ''")


@query("set_exact_duplicates", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def set_exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query(
    "set_merge_within_document",
    f"""SELECT doc_id, md5(lower(trim(t))) AS k, min(i) AS first_line, count(*) AS n FROM ({_LINES}) WHERE trim(t) <> '' GROUP BY ALL""",
)
def set_merge_within_document(spark, sf_dir):
    k = F.md5(F.lower(F.trim("t")).cast("binary"))
    return _lines(spark, sf_dir).where("trim(t) != ''").groupBy("doc_id", k.alias("k")).agg(F.min("i").alias("first_line"), F.count("*").alias("n"))


@query(
    "set_duplicate_uploads",
    "SELECT doc_id, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS existing FROM documents",
)
def set_duplicate_uploads(spark, sf_dir):
    """Each upload and the first document of its source with the same text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = d.groupBy("source", "h").agg(F.min("doc_id").alias("existing"))
    return d.join(first, ["source", "h"]).select("doc_id", "existing")


@query(
    "set_array_operations",
    """WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT event_type) FILTER (value > 60) AS x, list(DISTINCT event_type) FILTER (value < 40) AS y FROM events GROUP BY user_id, CAST(ts AS DATE))
    SELECT user_id, CAST(day AS VARCHAR) AS day, array_to_string(list_sort(list_intersect(coalesce(x, []), coalesce(y, []))), ',') AS both_kinds, array_to_string(list_sort(list_filter(coalesce(x, []), lambda e: NOT list_contains(coalesce(y, []), e))), ',') AS only_high FROM a""",
)
def set_array_operations(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("x"), F.collect_set(F.when(F.col("value") < 40, F.col("event_type"))).alias("y")
    )
    return a.select("user_id", F.col("day").cast("string").alias("day"), F.array_join(F.array_sort(F.array_intersect("x", "y")), ",").alias("both_kinds"), F.array_join(F.array_sort(F.array_except("x", "y")), ",").alias("only_high"))
