"""Joins: lookups, membership, siblings, laterals, fuzzy matches, fusion and graph edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import plain_tokens, trigrams
from corvane.session import table
from corvane.storage import stored

#: Rows of the smaller side's keys that go to every task; trigrams of a name that meets others on triples.
MOST_SENT, MOST_TRIPLED = 1_000_000, 16
#: Ids of one name that go through a join as one array.
BLOCK = 256


def top_n(rows: DataFrame, parent: str, n: int, *order) -> DataFrame:
    """The first n rows of each parent."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("rank") <= n)


def fuse(channels: dict[str, DataFrame], key: list[str], score: str) -> DataFrame:
    """Rows that several channels found, as one each: the channels, the best score and how many found it."""
    named = [df.select(*key, F.col(score).alias("score"), F.lit(name).alias("channel")) for name, df in channels.items()]
    together = named[0]
    for df in named[1:]:
        together = together.unionByName(df)
    return together.groupBy(*key).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))


def small(keys: DataFrame, name: str) -> DataFrame:
    """keys, stored; up to MOST_SENT rows go to every task of a join, so that the other side is not shuffled."""
    held = stored(keys, name)
    return F.broadcast(held) if held.count() <= MOST_SENT else held


def similar_names(left: DataFrame, right: DataFrame, least: float, of=trigrams) -> DataFrame:
    """l, r, jaccard of the distinct names (l) and (r) that share enough trigrams: an equality join on three of them at once, then counted.

    Sets of n trigrams in one order that share k share their first three common ones among the first n - k + 3, and k is least * n or more. So names
    of up to MOST_TRIPLED trigrams meet on triples of these few. A longer name, and one that may have to share fewer than three, meets on single ones among the first n - k + 1.
    A name's trigrams set bits of one number; bits that the other lacks are as many trigrams or more that are not shared, which most pairs that meet have too many of.
    """

    def keyed(names, c):
        n = f"n_{c}"
        hashes = F.sort_array(F.transform(F.array_distinct(of(F.col(c))), lambda t: F.xxhash64(t)))
        sets = names.select(c).distinct().select(c, hashes.alias("g")).withColumn(n, F.size("g"))
        bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))
        bits = F.aggregate("g", F.lit(0).cast("long"), lambda s, t: s.bitwiseOR(bit(t)))
        sets = sets.where(F.col(n) > 0).withColumns({"k": F.ceil(F.col(n) * least - 1e-9).cast("int"), f"bits_{c}": bits})
        first = F.least(n, F.col(n) - F.col("k") + 3)

        def rest(i, last):
            return F.sequence(i + 1, first - last)

        triples = F.transform(
            F.sequence(F.lit(0), first - 3),
            lambda i: F.flatten(F.transform(rest(i, 2), lambda j: F.transform(rest(j, 1), lambda x: F.xxhash64(F.get("g", i), F.get("g", j), F.get("g", x))))),
        )
        none = F.array().cast("array<bigint>")
        alone = (F.col("k") < 3) | (F.col(n) + 1e-9 >= least * (MOST_TRIPLED + 1))
        ones = F.when(alone, F.slice("g", F.lit(1), F.col(n) - F.col("k") + 1)).otherwise(none)
        threes = F.when((F.col(n) >= 3) & (F.col(n) <= MOST_TRIPLED), F.flatten(triples)).otherwise(none)
        return sets.select(c, n, f"bits_{c}", F.explode(F.concat(ones, threes)).alias("key"))

    met = keyed(right, "r").join(small(keyed(left, "l"), "trigram-keys"), "key")
    share = F.ceil((F.col("n_l") + F.col("n_r")) * (least / (1 + least)) - 1e-9)

    def lacks(x, y):
        return F.bit_count(F.col(f"bits_{x}").bitwiseAND(F.bitwise_not(f"bits_{y}")))

    near = (F.least("n_l", "n_r") >= share) & (lacks("l", "r") <= F.col("n_l") - share) & (lacks("r", "l") <= F.col("n_r") - share)
    pairs = met.where(near).groupBy("l", "r").agg(F.max(F.col("n_l") + F.col("n_r")).alias("all"))
    counted = pairs.select("l", "r", F.size(F.array_intersect(of(F.col("l")), of(F.col("r")))).alias("n"), "all")
    return counted.select("l", "r", (F.col("n") / (F.col("all") - F.col("n"))).alias("jaccard")).where(F.col("jaccard") >= least)


def blocks(rows: DataFrame, sizes: DataFrame, name: str, ids: str) -> DataFrame:
    """name, ids (array of structs): the ids of each name in arrays of about BLOCK, dealt by ranges of names; a name of many rows has blocks in many ranges.

    sizes: name, k, the number of a name's blocks.
    """
    dealt = rows.join(small(sizes.where("k > 1"), "often"), name, "left").select(name, ids, F.pmod(F.xxhash64(ids), F.coalesce("k", F.lit(1))).alias("block"))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartitionByRange(n, name, "block").groupBy(name, "block").agg(F.collect_list(F.struct(ids)).alias(f"{ids}s")).drop("block")


def trigram_candidates(left: DataFrame, right: DataFrame, least: float, of=trigrams, digits: int | None = None) -> DataFrame:
    """left_id, right_id, jaccard (rounded to digits) of names (id, name) that share enough trigrams.

    Distinct names are compared, and the pairs of them stored; ids come back in blocks, which are joined on the names and unfolded last. So copies of
    a name cost no more than their rows in the result, and these come as each id of a left block with all ids of a right one: a file's columns are runs
    and repeated stretches, which take next to no room.
    """
    a = left.where("name is not null").select(F.col("id").alias("left_id"), F.col("name").alias("l"))
    b = right.where("name is not null").select(F.col("id").alias("right_id"), F.col("name").alias("r"))
    of_l, of_r = (stored(x.groupBy(c).agg(F.ceil(F.count("*") / BLOCK).alias("k")), "names") for x, c in ((a, "l"), (b, "r")))
    pairs = similar_names(of_l, of_r, least, of)
    pairs = stored(pairs if digits is None else pairs.withColumn("jaccard", F.round("jaccard", digits)), "similar-names")
    asked = stored(blocks(a, of_l, "l", "left_id").join(pairs, "l").drop("l"), "left-blocks")
    sent = (asked.agg(F.sum(F.size("left_ids"))).first()[0] or 0) <= MOST_SENT
    met = blocks(b, of_r, "r", "right_id").join(F.broadcast(asked) if sent else asked, "r")
    return met.select("jaccard", "right_ids", F.inline("left_ids")).select("left_id", F.inline("right_ids"), "jaccard")


@query(
    "join_lookup_chain",
    """SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def join_lookup_chain(spark, sf_dir):
    li, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("join_optional_embedding", "SELECT doc_id, label, coalesce(len(embedding), 0) AS dims FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def join_optional_embedding(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, d.doc_id == e.vec_id, "left").select("doc_id", "label", F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("dims"))


@query("join_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_membership(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey")


@query("join_not_accessible", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_not_accessible(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, o.o_custkey == c.c_custkey, "left_anti").select("c_custkey")


@query(
    "join_siblings",
    """SELECT a.l_orderkey, a.l_linenumber, string_agg(CAST(b.l_linenumber AS VARCHAR), ',' ORDER BY b.l_linenumber) AS siblings
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey % 4 = b.l_suppkey % 4 AND a.l_linenumber < b.l_linenumber GROUP BY ALL""",
)
def join_siblings(spark, sf_dir):
    """Later lines of the same order and part of it: the chunks that continue one."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).alias("part"), "l_linenumber")
    later = li.select("l_orderkey", "part", F.col("l_linenumber").alias("next"))
    met = li.join(later, ["l_orderkey", "part"]).where("next > l_linenumber")
    return met.groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.array_sort(F.collect_list("next")), ",").alias("siblings"))


@query(
    "join_lateral_latest",
    """SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""",
)
def join_lateral_latest(spark, sf_dir):
    return top_n(table(spark, sf_dir, "orders"), "o_custkey", 5, F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query(
    "join_fuzzy_names",
    """WITH g AS (SELECT p_partkey AS id, list_distinct([substr(' ' || lower(p_name) || ' ', i, 3) for i in range(1, greatest(length(p_name), 1) + 1)]) AS g FROM part),
    l AS (SELECT * FROM g WHERE id % 50 = 0)
    SELECT l.id AS left_id, g.id AS right_id, round(CAST(len(list_intersect(l.g, g.g)) AS DOUBLE) / len(list_distinct(list_concat(l.g, g.g))), 6) AS jaccard
    FROM l, g WHERE CAST(len(list_intersect(l.g, g.g)) AS DOUBLE) / len(list_distinct(list_concat(l.g, g.g))) >= 0.58""",
)
def join_fuzzy_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return trigram_candidates(p.where("id % 50 = 0"), p, 0.58, digits=6)


@query(
    "join_expected_actual",
    """WITH e AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS expected FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
    a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS actual FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT user_id, array_to_string(list_filter(expected, lambda x: NOT list_contains(coalesce(actual, []), x)), ',') AS missing FROM e LEFT JOIN a USING (user_id)""",
)
def join_expected_actual(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    mid = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    e = ev.where(F.col("ts") < mid).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("expected"))
    a = ev.where(F.col("ts") >= mid).groupBy("user_id").agg(F.collect_set("event_type").alias("actual"))
    gone = F.array_except("expected", F.coalesce("actual", F.array().cast("array<string>")))
    return e.join(a, "user_id", "left").select("user_id", F.array_join(gone, ",").alias("missing"))


@query(
    "join_artifact_graph",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM l)
    SELECT doc_id, i AS line, CAST(len(string_split(t, '. ')) AS BIGINT) AS children FROM p WHERE t <> ''""",
)
def join_artifact_graph(spark, sf_dir):
    """Lines as nodes and their sentences as children: two levels, by exploding and counting edges."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where("t != ''")
    edges = lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.explode(F.split("t", r"\. ")).alias("child"))
    return edges.groupBy("doc_id", "line").agg(F.count("*").alias("children"))


_POST = "SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1))) AS t FROM documents"


@query(
    "join_channel_fusion",
    f"""WITH p AS ({_POST}), q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 3))) AS t FROM benchmark),
    a AS (SELECT item_id, doc_id, CAST(count(*) AS DOUBLE) AS s FROM p JOIN q USING (t) GROUP BY ALL HAVING count(*) >= 5),
    b AS (SELECT item_id, doc_id, CAST(count(*) AS DOUBLE) AS s FROM p JOIN q USING (t) WHERE length(t) > 6 GROUP BY ALL),
    u AS (SELECT *, 'words' AS c FROM a UNION ALL SELECT *, 'long' FROM b)
    SELECT item_id, doc_id, max(s) AS score, string_agg(c, ',' ORDER BY c) AS channels FROM u GROUP BY ALL""",
)
def join_channel_fusion(spark, sf_dir):
    """Two channels of matching words, merged to a row for each item and document."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    p = docs.select("doc_id", F.explode(F.array_distinct(plain_tokens(F.col("text")))).alias("t"))
    q = bench.select("item_id", F.explode(F.array_distinct(plain_tokens(F.col("text")))).alias("t")).where("length(t) > 3")
    met = p.join(q, "t")
    words = met.groupBy("item_id", "doc_id").agg(F.count("*").cast("double").alias("s")).where("s >= 5")
    long_ = met.where("length(t) > 6").groupBy("item_id", "doc_id").agg(F.count("*").cast("double").alias("s"))
    return fuse({"words": words, "long": long_}, ["item_id", "doc_id"], "s").withColumn("channels", F.array_join("channels", ","))


@query(
    "join_hidden_eval_anti",
    """SELECT doc_id FROM documents WHERE md5(lower(trim(text))) NOT IN (SELECT md5(lower(trim(text))) FROM benchmark)""",
)
def join_hidden_eval_anti(spark, sf_dir):
    key = F.md5(F.lower(F.trim("text")).cast("binary"))
    d = table(spark, sf_dir, "documents").select("doc_id", key.alias("k"))
    return d.join(table(spark, sf_dir, "benchmark").select(key.alias("k")), "k", "left_anti").select("doc_id")


@query(
    "join_applied_adjustments",
    """SELECT a.event_id, a.user_id, b.n FROM events a JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) b USING (user_id) WHERE a.event_type = 'error'""",
)
def join_applied_adjustments(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    applied = ev.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    return ev.where("event_type = 'error'").join(applied, "user_id").select("event_id", "user_id", "n")
