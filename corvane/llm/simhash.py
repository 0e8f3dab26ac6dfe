"""SimHash near-duplicates found with pivot distance tables.

The table holds, for each distinct 64-bit fingerprint, its Hamming distances to many fixed reference fingerprints: one
base, several in each of four groups, and some more. A group's references are the base with half of the bits of a quarter
of the word flipped, so the coordinate of one less that of the base moves only with that quarter's bits. Two fingerprints
that differ in at most 2 bits differ in at most two quarters: these differences are equal in some two groups, and an
equality join on them, the cells, misses no pair. Unequal quarters can have equal coordinates; of the pairs
that meet, those are discarded whose largest difference between any two coordinates is over the limit (a distance to a
reference moves by one for each bit at most), and the rest are verified bit by bit.

A cell of more than max_cell fingerprints, such as near copies in thousands make, would have too many pairs. It gets
references of its own, its members' one-bit neighbours: what lies within one bit of the same reference is within two bits
of each other. Any two that differ in 2 bits or fewer meet so, and each is linked to the smallest that it meets: linear
in the cell's size and exact. Equal fingerprints are one entry of the table from the start.

The pipeline's stage searches wider, by five-word shingles and a similarity of 0.8: similar.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import components, materialize

BLOCKS, BLOCK_BITS = 4, 16


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed 64 bits) of whole texts.

    A-Z are lower-cased, words are runs of other characters than space and \\t to \\r; shingles count as often
    as they occur; fewer words than a shingle's make one shingle, none (an empty or null text) the fingerprint 0.
    A bit is 1 if set in over half of the shingles' XXH64 (seed 42).
    """

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from xxhash import xxh64_intdigest

        def one(text: str | None) -> int:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if not words:
                return 0
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            k = min(words_per_shingle, len(words))
            starts = np.concatenate([[0], ends[: len(words) - k]]).tolist()
            hashes = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
            ones = np.zeros(64, np.int64)
            for i in range(0, len(hashes), 1 << 16):
                ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0].astype(np.int64))

        for batch in texts:
            yield pd.Series([one(t) for t in batch], dtype="int64")

    return docs.select(F.col("doc_id").cast("long"), of("text").alias("fp"))


def references(per_group: int, more: int) -> list[int]:
    """Fixed reference fingerprints, the same in every run: the base, per_group of each group, and more at random."""
    rng = np.random.default_rng(64)
    base = int(rng.integers(0, 1 << 64, dtype=np.uint64))
    out = [base]
    for g in range(BLOCKS):
        for _ in range(per_group):
            flipped = rng.permutation(BLOCK_BITS)[: BLOCK_BITS // 2] + g * BLOCK_BITS
            out.append(base ^ sum(1 << int(i) for i in flipped))
    return out + rng.integers(0, 1 << 64, more, dtype=np.uint64).tolist()


def pivot_table(fps: DataFrame, per_group: int = 6, more: int = 7) -> DataFrame:
    """Adds dist, the distances to all references, and cell_0 to cell_3, the groups' coordinates less the base's."""
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in references(per_group, more)]
    out = fps.withColumn("dist", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in signed]))
    for g in range(BLOCKS):
        moved = F.slice("dist", 2 + g * per_group, per_group)
        out = out.withColumn(f"cell_{g}", F.transform(moved, lambda d: d - F.col("dist")[0]))
    return out


def _cells(fps: DataFrame, per_group: int, more: int) -> DataFrame:
    """fp, dist, cell: each fingerprint in the cells of every two groups, stored."""
    table = pivot_table(fps, per_group, more)
    pairs = list(combinations(range(BLOCKS), 2))
    keys = F.array(*[F.xxhash64(F.lit(k), f"cell_{x}", f"cell_{y}") for k, (x, y) in enumerate(pairs)])
    return materialize(table.select("fp", "dist", F.explode(keys).alias("cell")), "cells")


def candidates(met: DataFrame, sizes: DataFrame, max_cell: int) -> DataFrame:
    """a, b, gap, bits of the pairs that meet in a cell of at most max_cell: largest coordinate difference, and bits that differ."""
    few = met.join(sizes.where(F.col("count") <= max_cell).select("cell"), "cell", "left_semi")
    other = few.select("cell", F.col("fp").alias("b"), F.col("dist").alias("dist_b"))
    gap = F.array_max(F.zip_with("dist", "dist_b", lambda p, q: F.abs(p - q)))
    paired = few.withColumnRenamed("fp", "a").join(other, "cell").where(F.col("a") < F.col("b"))
    return paired.select("a", "b", gap.alias("gap"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"))


def links(fps: DataFrame, max_bits: int = 2, per_group: int = 6, more: int = 7, max_cell: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links of at most 2 bits."""
    if max_bits > 2:
        raise ValueError("four groups find differences of at most 2 bits")
    met = _cells(fps, per_group, more)
    sizes = met.groupBy("cell").count().where("count > 1")
    paired = candidates(met, sizes, max_cell).where(F.col("gap") <= max_bits).where(F.col("bits") <= max_bits).select("a", "b")
    many = met.join(sizes.where(F.col("count") > max_cell).select("cell"), "cell", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)])
    halfway = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("half"))
    if max_bits < 2:  # a fingerprint itself must be one end
        halfway = halfway.join(many.select(F.col("fp").alias("half")), "half", "left_semi")
    least = halfway.groupBy("half").agg(F.min("fp").alias("a"), F.max("fp").alias("_top")).where("a < _top").select("half", "a")
    starred = halfway.join(least, "half").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return paired.union(starred).distinct()


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links, itself included) for every row of docs.

    Rows that repeat a doc_id are one document with each of their fingerprints linked; a null doc_id gets the
    smallest doc_id of its component, or null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    groups = components(links(first.select("fp"), **options))
    repeated = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b")
    if not repeated.isEmpty():  # only where rows repeat a doc_id
        same = prints.join(repeated.select("doc_id", "a"), "doc_id").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
        groups = components(same.union(groups.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    root = F.coalesce("component", "fp")
    placed = first.join(groups, first.fp == groups.node, "left").select("fp", "first_doc", root.alias("root"))
    least = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = placed.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document's fingerprint and component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
