"""Alignment of the tokens of two tokenizers by relational operations.

Neither tokenizer's tokens span a space that stands between a character other than a space and one that is no white space, so a text
falls apart there into units, each with the space before it. A bucket of documents has its distinct units once, with
their ids and the byte each token ends at. The ends that both sides have are the cuts: an intersection of two arrays where a unit has
few tokens; those of long units are posexploded, an equi-join on unit and end finds the cuts, a running count of them numbers the groups. A
group's ids meet each other, counted, as its links. Units then join back to the documents of their bucket; all tables are bucketed by bucket, so documents
are shuffled once and nothing else of their size is.
"""

from __future__ import annotations

import contextlib
import json
import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, table_path

#: Bytes of text that a bucket of documents holds, about, and the most buckets there are.
BUCKET_BYTES, MOST_BUCKETS = 12_000_000, 50_000
#: Units whose tokens are looked up in one call of a library.
TOGETHER = 2_000
#: A table of pair counts of at most so many rows goes to every task; a larger one is joined.
MOST_PAIRS = 2_000_000
#: Bytes of a bucket's units that a task may hold in a hash table.
MOST_BUILD = 256_000_000
SALTS = 16
#: Where both tokenizers cut for certain.
CUT = r" (?<=[^ ] )(?=\P{IsWhite_Space})"
#: Tokens of a side up to which a unit's cuts are found in its row.
FEW = 1_000


class Vocabulary:
    """ids(text) and the bytes of each id, of a tokenizers file (A) or a sentencepiece model (B, which sets a space before)."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            entries = library.get_vocab()
            # printable Latin-1 stands for itself, the other bytes for the characters from 256 on
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
            spec = json.loads(library.to_str())
            special = {t["content"] for t in spec["added_tokens"]}
            self.bytes = [b""] * (max(entries.values()) + 1)
            for entry, i in entries.items():
                self.bytes[i] = entry.encode() if entry in special else bytes(byte_of[c] for c in entry)
            self.ids = self._by_ranks(spec, special) or (lambda text: library.encode(text, add_special_tokens=False).ids)
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)

            def of(i: int) -> bytes:
                piece = model.id_to_piece(i)
                return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

            self.bytes = [of(i) for i in range(model.vocab_size())]
            self.ids = lambda text: model.encode(text[1:])
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def _by_ranks(self, spec: dict, special: set[str]):
        """ids by tiktoken, five times as fast on words not seen before, if the file's merges stand in the order of their ids."""
        import public_tokenizers
        import tiktoken

        entries, merges = spec["model"]["vocab"], spec["model"]["merges"]
        steps = ("".join(m if isinstance(m, list) else m.split(" ")) for m in merges)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or any(entries[m] != 256 + i for i, m in enumerate(steps)):
            return None
        ranks = {self.bytes[i]: i for e, i in entries.items() if e not in special}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, tokens of each unit, whether their bytes are the unit's) of units with their spaces."""
        ids, counts, ok = [], np.zeros(len(units), np.int64), np.zeros(len(units), bool)
        joined = "".join(units)
        raw = joined.encode()
        apart = any(u[-1] == " " or u[1:2] == " " for u in units)
        found = None if apart else self.ids(joined)
        if found is not None and b"".join([self.bytes[i] for i in found]) == raw:
            ends = np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
            reached = np.cumsum(self.sizes[found])
            last = np.searchsorted(reached, ends)
            if (reached[last] == ends).all():
                return np.array(found, np.int32), np.diff(last + 1, prepend=0), ~ok
        if len(units) > 1:
            half = len(units) // 2
            parts = [self.tokens(units[:half]), self.tokens(units[half:])]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        found = self.ids(joined)
        same = b"".join([self.bytes[i] for i in found]) == raw
        ids, counts[0], ok[0] = found if same else [], len(found) if same else 0, same
        return np.array(ids, np.int32), counts, ok


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each file and process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


#: So Spark reads a bucketed table by its buckets below a generator too, and joins by more than bucket where rows lie by bucket.
BY_BUCKET = {
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@contextlib.contextmanager
def by_bucket(spark: SparkSession):
    """What is run inside does not shuffle the tables of bucketed() again for keys that begin with bucket."""
    before = {k: spark.conf.get(k) for k in BY_BUCKET}
    try:
        for k, v in BY_BUCKET.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df as a stored table bucketed by bucket: later joins and groupings by it need no shuffle."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "bucket").option("path", table_path(df.sparkSession, name)).option("compression", "zstd").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, row, doc_id, text stored by bucket; the number of buckets): a bucket's number hashes to a bucket of its own."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    n = min(MOST_BUCKETS, max(1, math.ceil(size / BUCKET_BYTES), min(spark.sparkContext.defaultParallelism, size // 100_000)))
    numbers = spark.range(40 * n).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("i")).agg(F.min("id").cast("int").alias("bucket"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("i", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    # at most MOST_BUCKETS rows of two numbers; a number that hits no bucket shares one
    placed = rows.join(F.broadcast(numbers), "i", "left").withColumn("bucket", F.coalesce("bucket", F.col("i")))
    return bucketed(placed.select("bucket", "row", "doc_id", "text").repartition(n, "bucket"), "documents", n), n


def _parts() -> Column:
    return F.split("text", CUT, -1)


def tokenized(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """bucket, part, a, b, end_a, end_b, ok: the ids of the distinct units of each bucket and the bytes up to their ends; part is a unit without its space."""

    def look_up(batches):
        import pyarrow as pa

        both = vocabulary(path_a), vocabulary(path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                units = [f" {p}" for p in some.column("part").to_pylist()]
                (ids_a, n_a, ok_a), (ids_b, n_b, ok_b) = (v.tokens(units) for v in both)
                lists, ends = [], []
                for v, ids, n in zip(both, (ids_a, ids_b), (n_a, n_b), strict=True):
                    at, reached = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(v.sizes[ids])])
                    for out, values in ((lists, ids), (ends, reached[1:] - np.repeat(reached[at[:-1]], n))):
                        out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32())))
                yield pa.RecordBatch.from_arrays([some.column("bucket"), some.column("part"), *lists, *ends, pa.array(ok_a & ok_b)], ["bucket", "part", "a", "b", "end_a", "end_b", "ok"])

    distinct = rows.where("text <> ''").select("bucket", F.explode(_parts()).alias("part")).distinct()
    return distinct.mapInArrow(look_up, "bucket int, part string, a array<int>, b array<int>, end_a array<int>, end_b array<int>, ok boolean")


def cuts(units: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """bucket, unit, cuts: of each unit (bucket, unit, a, b, ok) the numbered groups' last tokens of either side."""
    spark = units.sparkSession

    def ends(side: str, path: str) -> DataFrame:
        # as many rows as the vocabulary
        sizes = spark.createDataFrame([(i, len(b)) for i, b in enumerate(vocabulary(path).bytes)], "id int, size int")
        tokens = units.where("ok").select("bucket", "unit", F.posexplode(side).alias(f"at_{side}", "id")).join(F.broadcast(sizes), "id")
        before = Window.partitionBy("bucket", "unit").orderBy(f"at_{side}").rowsBetween(Window.unboundedPreceding, 0)
        return tokens.select("bucket", "unit", f"at_{side}", F.sum("size").over(before).alias("end"))

    met = ends("a", path_a).join(ends("b", path_b), ["bucket", "unit", "end"])
    group = F.row_number().over(Window.partitionBy("bucket", "unit").orderBy("end"))
    numbered = met.select("bucket", "unit", F.struct(group.alias("g"), "at_a", "at_b").alias("cut"))
    return numbered.groupBy("bucket", "unit").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))


def cuts_of_few() -> Column:
    """The cuts of a unit with few tokens, from its ends."""

    def at(side: str, end: Column) -> Column:
        return (F.array_position(f"end_{side}", end) - 1).cast("int").alias(f"at_{side}")

    return F.transform(F.array_intersect("end_a", "end_b"), lambda e: F.struct(at("a", e), at("b", e)))


def linked(joined: DataFrame, *more: str) -> DataFrame:
    """bucket, part, ok, n_a, n_b, n_groups, n_links, label, pairs (a, b, n) and more columns of units with their cuts; single ones, whose tokens all end alike, need none."""

    def stretch(side: str):
        def of(cut: Column, i: Column) -> Column:
            first = F.coalesce(F.get("cuts", i - 1)[f"at_{side}"] + 1, F.lit(0))
            return F.slice(side, first + 1, cut[f"at_{side}"] - first + 1)

        return of

    # most units fall apart into pairs of one token each: theirs need no stretches
    groups = F.transform("cuts", lambda c, i: F.struct(stretch("a")(c, i).alias("a"), stretch("b")(c, i).alias("b")))
    none = F.array().cast("array<struct<a:array<int>,b:array<int>>>")
    some = joined.withColumn("groups", F.when(F.col("single"), none).otherwise(F.coalesce(groups, none)))

    def counted(ids: Column) -> Column:
        return F.transform(F.array_distinct(ids), lambda x: F.struct(x.alias("id"), F.size(F.filter(ids, lambda y: y == x)).alias("n")))

    def link(a: Column, b: Column, n: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), n.alias("n"))

    def meet(g: Column) -> Column:
        other = lambda x: F.transform(counted(g["b"]), lambda y: link(x["id"], y["id"], x["n"].cast("long") * y["n"]))
        more = F.flatten(F.transform(counted(g["a"]), other))
        return F.when((F.size(g["a"]) == 1) & (F.size(g["b"]) == 1), F.array(link(g["a"][0], g["b"][0], F.lit(1).cast("long")))).otherwise(more)

    def said(ids: Column) -> Column:
        return F.when(F.size(ids) == 1, ids[0].cast("string")).otherwise(F.array_join(ids.cast("array<string>"), ","))

    def either(one: Column, more: Column) -> Column:
        return F.when(F.col("single"), one).otherwise(more)

    links = F.aggregate("groups", F.lit(0).cast("long"), lambda t, g: t + F.size(g["a"]).cast("long") * F.size(g["b"]))
    labels = F.transform("groups", lambda g: F.concat(said(g["a"]), F.lit("|"), said(g["b"])))
    return some.select(
        *more,
        "bucket",
        "part",
        "ok",
        F.size("a").cast("long").alias("n_a"),
        F.size("b").cast("long").alias("n_b"),
        either(F.size("a"), F.coalesce(F.array_size("cuts"), F.lit(0))).cast("long").alias("n_groups"),
        either(F.size("a").cast("long"), links).alias("n_links"),
        F.array_join(either(F.zip_with("a", "b", lambda x, y: F.concat(x.cast("string"), F.lit("|"), y.cast("string"))), labels), ";").alias("label"),
        either(F.zip_with("a", "b", lambda x, y: link(x, y, F.lit(1).cast("long"))), F.flatten(F.transform("groups", meet))).alias("pairs"),
    )


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs (doc_id, text).

    Null and empty texts, and those whose tokens' bytes differ from space and text, have no tokens: zeros and ''. Each
    row is a document of its own, also where a doc_id repeats or is null. A text without a cut is one unit, however long.
    """
    rows, n = dealt(docs)
    with by_bucket(docs.sparkSession):
        units = tokenized(rows, path_a, path_b)
        few, alike = (F.size("a") <= FEW) & (F.size("b") <= FEW), F.col("end_a") == F.col("end_b")
        own = {"single": F.col("ok") & alike, "cuts": F.when(F.col("ok") & few & ~alike, cuts_of_few())}
        long_ = F.when(F.col("ok") & ~few & ~alike, F.struct("a", "b"))
        aligned = bucketed(linked(units.withColumns(own | {"long": long_}), "long"), "aligned", n)
        rest = aligned.where("long is not null").select("bucket", "part", "ok", "long.*")
        if not rest.isEmpty():
            units = bucketed(rest.withColumn("unit", F.monotonically_increasing_id()), "units", n)
            found = units.join(cuts(units, path_a, path_b), ["bucket", "unit"], "left").withColumn("single", F.lit(False))
            aligned = bucketed(aligned.where("long is null").drop("long").unionByName(linked(found)).repartition(n, "bucket"), "aligned", n)
        per_bucket = aligned.count() / n * 300
        hinted = aligned.hint("shuffle_hash") if per_bucket < MOST_BUILD else aligned
        said = rows.where("text <> ''").select("bucket", "row", F.posexplode(_parts()).alias("at", "part"))
        sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
        label = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), ";")
        whole = said.join(hinted.drop("pairs", "long"), ["bucket", "part"]).groupBy("bucket", "row")
        summed = whole.agg(F.bool_and("ok").alias("ok"), *sums, F.sha2(label.cast("binary"), 256).alias("groups_sha256"))
        texts = materialize(summed.drop("bucket"), "texts")
        held = said.join(hinted.select("bucket", "part", "pairs"), ["bucket", "part"])
        bad = texts.where("not ok").select("row")
        if not bad.isEmpty():
            held = held.join(bad, "row", "left_anti")
        each = held.select("bucket", "row", F.explode("pairs").alias("p")).groupBy("bucket", "row", "p.a", "p.b").agg(F.sum("p.n").alias("n"))
        links = materialize(each.select("row", "a", "b", "n"), "links")
    counts = links.groupBy("a", "b").agg(F.count("*").alias("count"))
    counts = materialize(counts.select("a", "b", "count", (F.col("count") == F.max("count").over(Window.partitionBy("a"))).cast("long").alias("best")), "counts")
    if counts.count() <= MOST_PAIRS:
        told = links.join(F.broadcast(counts), ["a", "b"])
    else:  # a pair that most documents hold is dealt over SALTS keys
        salted = counts.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        told = links.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "salt"])
    scores = told.groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = rows.select("row", "doc_id").join(texts.where("ok"), "row", "left").join(scores, "row", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the byte-level and the sentencepiece tokens of all documents, aligned."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
