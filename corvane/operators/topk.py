"""Top-k retrieval over a stored index whose blocks have upper bounds, so that most postings are never scored.

A score is a sum over the terms that a query and a document share: weight * impact + extra. The index keeps postings by
shard of documents, term and level of impact, and for each term and level the largest impact. A query's k-th score is
first bounded from below by scoring some documents of its best levels in full. A document that reaches this bound must
have one of the terms without which the largest impacts of the rest don't reach it (MaxScore), in a level that can make up
for what is missing (block-max). What documents get from such levels is summed; those that can still reach the bound are scored in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.storage import stored

#: Documents of a shard, about: no block has more.
SHARD_DOCS = 65_536
#: Levels of impact for each doubling of it.
STEPS = 4
#: So many times k postings of a query's best levels, at least, are looked through for the documents, so many times k, whose scores bound its k-th from below.
LOOKED, SEEDS = 100, 4
#: Terms are not read that together give less than this share of the k-th score. A larger share (up to 1) reads fewer postings and scores more documents in full.
SPARED = 0.2
#: Scores are told apart to six places; a document this near the bound is scored too.
MARGIN = 1e-6
#: Query terms of at most so many rows go to every task.
MOST_TERMS = 200_000


@dataclass
class Index:
    """blocks: shard, term, level, docs, impacts; levels: term, level, n, top; tops: term, df, top; shards: how many."""

    blocks: DataFrame
    levels: DataFrame
    tops: DataFrame
    shards: int


def _shard(doc: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(shards)).cast("int")


def build(postings: DataFrame, n_docs: int, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of postings (doc_id, term, impact > 0), one row for each document and term; stored, in order of term."""
    shards = max(1, -(-n_docs // shard_docs))
    rows = postings.select("term", "doc_id", "impact", F.floor(F.log2("impact") * STEPS).cast("int").alias("level"), _shard(F.col("doc_id"), shards).alias("shard"))
    held = rows.groupBy("shard", "term", "level").agg(F.collect_list(F.struct("doc_id", "impact")).alias("p"))
    arrays = held.select("term", "shard", "level", F.col("p.doc_id").alias("docs"), F.col("p.impact").alias("impacts"))
    blocks = stored(arrays.repartitionByRange("term", "shard").sortWithinPartitions("term", "shard"), "blocks")
    own = blocks.select("term", "level", F.size("docs").cast("long").alias("n"), F.array_max("impacts").alias("top"))
    levels = stored(own.groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top")), "levels")
    tops = stored(levels.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top")), "tops")
    return Index(blocks, levels, tops, shards)


def joined(indexes: list[Index]) -> Index:
    """One index of several of the same documents, whose terms differ."""
    first = indexes[0]
    blocks, levels, tops = first.blocks, first.levels, first.tops
    for other in indexes[1:]:
        blocks, levels, tops = blocks.unionByName(other.blocks), levels.unionByName(other.levels), tops.unionByName(other.tops)
    return Index(blocks, levels, tops, first.shards)


def bounded_terms(terms: DataFrame, index: Index) -> DataFrame:
    """terms (query_id, term, family, weight, extra, cap) that the index has, with most (the largest they can give) and rest.

    cap bounds what a family's terms give together (null: nothing does). rest is the bound of all other terms of the query;
    below is the bound of the term and all before it, those of capped families first, then by what they can give.
    """
    few = F.broadcast(terms) if terms.count() <= MOST_TERMS else terms
    found = index.tops.select("term", "top").join(few, "term").withColumn("most", F.col("weight") * F.col("top") + F.col("extra"))
    free = F.when(F.col("cap").isNull(), F.col("most")).otherwise(0.0)
    held = F.when(F.col("cap").isNotNull(), F.col("most")).otherwise(0.0)
    query = Window.partitionBy("query_id")
    order = query.orderBy(F.col("cap").isNull(), "most", "term").rowsBetween(Window.unboundedPreceding, 0)
    cap = F.coalesce(F.max("cap").over(query), F.lit(0.0))
    capped = F.sum(held).over(query)
    sums = found.withColumns(
        {
            "below": F.least(F.sum(held).over(order), cap) + F.sum(free).over(order),
            "rest": F.least(capped - held, cap) + F.sum(free).over(query) - free,
            "capped": F.least(capped, cap),
            "free": F.sum(free).over(query),
        }
    )
    return stored(sums.drop("top"), "terms")


def scored(pairs: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """query_id, doc_id, scores (family to sum) of pairs (query_id, doc_id); only blocks that hold one of them are opened."""
    wanted = pairs.join(terms.select("query_id", "term", "family", "weight", "extra"), "query_id").withColumn("shard", _shard(F.col("doc_id"), index.shards))
    opened = index.blocks.join(wanted.select("shard", "term").distinct(), ["shard", "term"], "left_semi")
    each = opened.select("term", F.inline(F.arrays_zip("docs", "impacts"))).withColumnRenamed("docs", "doc_id")
    given = wanted.join(each, ["term", "doc_id"]).withColumn("x", F.col("weight") * F.col("impacts") + F.col("extra"))
    return given.groupBy("query_id", "doc_id", "family").agg(F.sum("x").alias("x"))


def _total(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "doc_id").agg(F.sum("x").alias("score"))


def partial(levels: DataFrame, index: Index) -> DataFrame:
    """query_id, doc_id, x: what the documents of levels (query_id, term, level, weight, extra, share) get from them; share: of how many shards."""
    blocks = index.blocks.join(levels, ["term", "level"]).where(F.col("shard") < F.col("share"))
    each = blocks.select("query_id", "weight", "extra", F.inline(F.arrays_zip("docs", "impacts")))
    return each.groupBy("query_id", F.col("docs").alias("doc_id")).agg(F.sum(F.col("weight") * F.col("impacts") + F.col("extra")).alias("x"))


def thresholds(terms: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, least: a score that k documents reach; none for a query with fewer documents.

    The documents that get most from each query's best levels are scored in full. Of a level that very many documents
    have, only as many shards are looked through as give enough.
    """
    choice = index.levels.join(terms.select("query_id", "term", "weight", "extra"), "term")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.col("weight") * F.col("top") + F.col("extra")), "term", "level")
    ranked = choice.withColumn("before", F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    share = F.ceil(F.lit(2.0 * LOOKED * k * index.shards) / F.col("n"))
    some = ranked.where(F.col("before") < LOOKED * k).select("query_id", "term", "level", "weight", "extra", share.alias("share"))
    order = Window.partitionBy("query_id").orderBy(F.desc("x"), "doc_id")
    pairs = partial(some, index).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SEEDS * k).select("query_id", "doc_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    sums = _total(scored(pairs, terms, index)).withColumn("rank", F.row_number().over(order))
    return sums.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))


def candidates(terms: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, doc_id of all documents that may be among the k best, stored.

    Terms are read but for those that together give a small part of the threshold; a document stays if what it gets from them and the bound of
    the others together reach the threshold.
    """
    least = stored(thresholds(terms, index, k), "thresholds")
    bound = F.coalesce(F.col("least"), F.lit(float("-inf"))) - MARGIN
    known = terms.join(least, "query_id", "left").withColumn("bound", bound)
    spared = F.col("below") < SPARED * F.col("bound")
    others = known.groupBy("query_id", "bound").agg(F.coalesce(F.max(F.when(spared, F.col("below"))), F.lit(0.0)).alias("others"))
    levels = index.levels.join(known.where(~spared), "term")
    own = F.col("weight") * F.col("top") + F.col("extra")
    reach = F.when(F.col("cap").isNull(), own + F.col("rest")).otherwise(F.least(own + F.col("rest"), F.col("capped") + F.col("free")))
    kept = levels.where(reach >= F.col("bound")).select("query_id", "term", "level", "weight", "extra", F.lit(index.shards).alias("share"))
    sums = partial(kept, index).join(F.broadcast(others) if others.count() <= MOST_TERMS else others, "query_id")
    return stored(sums.where(F.col("x") + F.col("others") >= F.col("bound")).select("query_id", "doc_id"), "candidates")


def top_k(terms: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, doc_id, parts (map of family to sum), score rounded to six places, rank: the k best documents of each query.

    terms: query_id, term, family, weight, extra >= 0 and cap. Ties go to the smaller doc_id. The result equals that of scoring every document
    that shares a term. Each task keeps k rows of a query before they are shuffled.
    """
    known = bounded_terms(terms, index)
    parts = scored(candidates(known, index, k), known, index)
    sums = parts.groupBy("query_id", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("family", "x"))).alias("parts"), F.round(F.sum("x"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
