"""Document scores by masked pseudo-likelihood.

A bidirectional window network (network.py) predicts every word of every document from the words on both sides of it;
a document's score is the sum of the log-probabilities of all its words. The vocabulary is the corpus's own: the most
frequent words, about half the square root of the corpus's length and so more of them in a larger corpus, are leaves of
the network. The other words fall into classes by their last two bytes, which are leaves too, and within its class a
word has a probability of its own, from the other documents: (c + m * s) / (C + m), with c its occurrences and C those of
its class outside of the row that is scored, s the probability of its spelling under the corpus's byte frequencies and m
the mean number of words that a class has once. So no document is evidence for itself.

1. Words of all texts are counted, the rows numbered and stored.
2. Rows are dealt into shards by a hash of doc_id and text, in the order of that hash; a shard has a fixed number of
   words, so that shards follow the corpus and not the cluster. They are stored as word ids.
3. In each round every shard trains the network, in numpy, on all its words from the last average; averages of the
   weights by words trained on begin the next round. They are added up block by block, in the order of the shards.
4. Words of classes go to buckets by their hash, where a word's occurrences are counted over all rows, and the logarithms
   go back as one sum a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import delete_table, materialize, number_rows, whole_groups
from corvane.llm.network import Network, windows
from corvane.llm.phrases import Hashes
from corvane.llm.tokens import text_slices

ENDINGS = 64
ROUNDS = 2
#: Branches of the network's choices: the vocabulary has their third power.
LEAST_BRANCHES, MOST_BRANCHES = 5, 64
#: Words of a shard; a network with many weights has longer ones.
SHARD_WORDS = 1 << 22
_BLOCK = 1 << 14
#: Buckets that words of classes are dealt into, at least; more for a corpus with more partitions.
LEAST_BUCKETS = 64
#: Bytes of words that are hashed at once.
_BYTES = 1 << 22
#: Bytes of a word's hash that are handed on; its bucket is another part of the hash.
_HASH = 5


@dataclass
class Vocabulary:
    """What is known of the corpus's words: the leaves by frequency, and what the rest needs."""

    branches: int
    known: list[str]
    spelling: np.ndarray  # log-probability of each byte, and of the end of a word
    class_totals: np.ndarray
    novel: float
    words: int

    @property
    def pad(self) -> int:
        return self.branches**3

    @property
    def classes_from(self) -> int:
        return self.pad - ENDINGS


def _split(texts):
    """(words of all texts one after the other, number of each text's words) of an Arrow array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    words = parts.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    held = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
    return pa.concat_arrays([words.filter(some)]), np.diff(held[at])


def word_counts(docs: DataFrame) -> DataFrame:
    """w, count of every word of all docs, stored."""

    def counted(batches):
        import pyarrow as pa

        for batch in text_slices(batches, ("text",), size=1 << 24):
            found = _split(batch.column("text"))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["w", "count"])

    words = docs.select(F.lower("text").alias("text")).mapInArrow(counted, "w string, count long")
    return materialize(words.groupBy("w").agg(F.sum("count").alias("count")), "counts")


def _flat(words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of an Arrow array of words that lie one after the other."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def endings(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each word: by its last two bytes."""
    starts = np.concatenate([[0], ends[:-1]])
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0)
    return (last * 29 + before) % ENDINGS


def vocabulary(counts: DataFrame, branches: int | None = None) -> Vocabulary:
    """Describes the words of counts. The driver gets the leaves' words, a histogram, and sums by byte and class."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    if branches is None:
        branches = min(max(round((0.5 * math.sqrt(total)) ** (1 / 3)), LEAST_BRANCHES), MOST_BRANCHES)
    most = branches**3 - ENDINGS
    # words are taken from the top in whole bins of equal or nearly equal counts, which fixes a count below which none is
    level = F.floor(F.log2("count") * 64)
    bins = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level)
    fits = np.cumsum([r.n for r in bins]) <= most
    lowest = bins[int(fits.sum()) - 1].level if fits.any() else math.inf
    top = counts.where(level >= lowest).collect() if fits.any() else []
    known = [r.w for r in sorted(top, key=lambda r: (-r["count"], r.w))]

    def sums(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        letters, classes, once = np.zeros(257), np.zeros(ENDINGS), 0
        leaves = pa.array(known, pa.string())
        for batch in batches:
            batch = batch.filter(pc.invert(pc.is_in(batch.column("w"), value_set=leaves)))
            if not batch.num_rows:
                continue
            data, ends = _flat(batch.column("w"))
            n = batch.column("count").to_numpy()
            letters[:256] += np.bincount(data, minlength=256)
            letters[256] += len(ends)
            classes += np.bincount(endings(data, ends), n, ENDINGS)
            once += int((n == 1).sum())
        out = np.concatenate([letters, classes, [once]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["i", "v"])

    rows = counts.select("w", "count").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(257 + ENDINGS + 1)
    for r in rows:
        out[r.i] = r.v
    spelling = np.log((out[:257] + 0.5) / (out[:257] + 0.5).sum())
    return Vocabulary(branches, known, spelling, out[257:-1], max(1.0, out[-1] / ENDINGS), total)


class Words:
    """Cuts texts into words and numbers them."""

    def __init__(self, vocabulary: Vocabulary):
        import pyarrow as pa

        self.v = vocabulary
        self.leaves = pa.array(vocabulary.known, pa.string())

    def cut(self, texts):
        """(words of all texts one after the other, number of each text's words, leaf of each word, whether it is a class)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words, sizes = _split(texts)
        leaf = pc.fill_null(pc.index_in(words, value_set=self.leaves), -1).to_numpy().copy()
        rare = leaf < 0
        if rare.any():
            leaf[rare] = self.v.classes_from + endings(*_flat(words.filter(pa.array(rare))))
        return words, sizes, leaf.astype(np.uint32 if self.v.pad > 65_535 else np.uint16), rare

    def rare(self, words):
        """Yields (first word, hashes, log-probabilities of the spelling) of some words at a time."""
        data, ends = _flat(words)
        starts = np.concatenate([[0], ends[:-1]])
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + _BYTES)))
            piece = data[starts[a] : ends[b - 1]]
            i, j = starts[a:b] - starts[a], ends[a:b] - starts[a]
            sums = np.concatenate([[0], np.cumsum(self.v.spelling[piece])])
            yield a, Hashes(piece).of(i, j), sums[j] - sums[i] + self.v.spelling[256]
            a = b


def shards(numbered: DataFrame, v: Vocabulary, shard_words: int | None = None) -> DataFrame:
    """The corpus as word ids, stored: shard, part, rows, docs, sizes (words of each row) and ids, one row for some documents.

    numbered: row, doc_id, text. A shard that a hash fills too much is cut into parts, whole documents each.
    """
    each = shard_words or max(SHARD_WORDS, 8 * len(Network(v.branches).flat))
    count = max(1, math.ceil(v.words / each))
    most = each * 5 // 4
    kind = "<u4" if v.pad > 65_535 else "<u2"

    def numbers(batches):
        import pyarrow as pa

        words = Words(v)
        for batch in text_slices(batches, ("row", "doc_id", "key", "text")):
            _, sizes, leaf, _ = words.cut(batch.column("text"))
            ends = np.cumsum(sizes)
            blobs = [leaf[a:b].astype(kind).tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "key")), pa.array(sizes.astype(np.int32)), pa.array(blobs, pa.binary())],
                ["row", "doc_id", "key", "size", "ids"],
            )

    def packed(batches):
        import pyarrow as pa

        held: list[dict] = []
        at = None

        def row(part):
            columns = [pa.array([[h[c] for h in held]], t) for c, t in (("row", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())))]
            blob = pa.array([b"".join(h["ids"] for h in held)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part], pa.int32()), *columns, blob], ["shard", "part", "rows", "docs", "sizes", "ids"])

        part = size = 0
        for batch in batches:
            for r in batch.select(["shard", "row", "doc_id", "size", "ids"]).to_pylist():
                if held and (r["shard"] != at or size + r["size"] > most):
                    yield row(part)
                    part, held, size = (part + 1 if r["shard"] == at else 0), [], 0
                at = r["shard"]
                held.append(r)
                size += r["size"]
        if held:
            yield row(part)

    keyed = numbered.select("row", "doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    ids = keyed.mapInArrow(numbers, "row long, doc_id long, key long, size int, ids binary")
    dealt = ids.withColumn("shard", F.pmod("key", F.lit(count)).cast("long")).repartition("shard").sortWithinPartitions("shard", "key", "doc_id", "ids")
    schema = "shard long, part int, rows array<long>, docs array<long>, sizes array<int>, ids binary"
    return materialize(dealt.mapInArrow(packed, schema), "shards")


def _documents(batch, v: Vocabulary):
    """Yields (places of some documents, their words, sizes) of each stored row of a batch of shards()."""
    kind = "<u4" if v.pad > 65_535 else "<u2"
    for sizes, blob in zip(batch.column("sizes").to_pylist(), batch.column("ids").to_pylist(), strict=True):
        ids, ends = np.frombuffer(blob, kind), np.cumsum(np.array(sizes, np.int64))
        a = 0
        while a < len(sizes):  # whole documents, some 2 ** 18 words at a time
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + (1 << 18))))
            cuts = np.concatenate([[before], ends[a:b]])
            yield a, [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
            a = b


def fit(packed: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The weights after rounds over all words of packed, which shards() gives."""
    context = packed.sparkSession.sparkContext
    flat = Network.initial(v.branches).flat
    for _ in range(rounds):
        start = context.broadcast(flat)

        def trained(batches, start=start):
            import pyarrow as pa

            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    network, seen = Network(v.branches, start.value.copy()), 0
                    squares = np.zeros_like(network.flat)
                    for _, ids in _documents(one, v):
                        target, around = windows(ids, v.pad)
                        network.train(squares, target, around)
                        seen += len(target)
                    if not seen:
                        continue
                    blocks = [network.flat[a : a + _BLOCK].tobytes() for a in range(0, len(network.flat), _BLOCK)]
                    n = len(blocks)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(n), pa.int32()), pa.array([one.column("shard")[0].as_py()] * n), pa.array([one.column("part")[0].as_py()] * n, pa.int32()), pa.array([float(seen)] * n), pa.array(blocks, pa.binary())],
                        ["block", "shard", "part", "seen", "weights"],
                    )

        def averaged(batches):  # a running sum: one shard's weights of a block are held at a time
            import pyarrow as pa

            def mean():
                return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())], ["block", "weights"])

            block, seen, total = None, 0.0, 0.0
            for batch in batches:
                for i in range(batch.num_rows):
                    at, n = batch.column("block")[i].as_py(), batch.column("seen")[i].as_py()
                    if at != block:
                        if block is not None:
                            yield mean()
                        block, seen, total = at, 0.0, 0.0
                    seen += n
                    total = total + n * np.frombuffer(batch.column("weights")[i].as_buffer(), "<f4").astype(np.float64)
            if block is not None:
                yield mean()

        by_shard = packed.select("shard", "part", "sizes", "ids").mapInArrow(trained, "block int, shard long, part int, seen double, weights binary")
        ordered = by_shard.repartition("block").sortWithinPartitions("block", "shard", "part")
        blocks = ordered.mapInArrow(averaged, "block int, weights binary").collect()  # one network, of bounded size
        if blocks:
            flat = np.frombuffer(b"".join(bytes(b.weights) for b in sorted(blocks, key=lambda b: b.block)), "<f4").copy()
        start.destroy()
    return flat


def network_scores(packed: DataFrame, v: Vocabulary, flat: np.ndarray) -> DataFrame:
    """row, doc_id, n_tokens, value: the summed log-probabilities of the leaves, less the classes' logarithms in each row."""
    weights = packed.sparkSession.sparkContext.broadcast(flat)

    def scored(batches):
        import pyarrow as pa

        network = Network(v.branches, weights.value)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows, docs = one.column("rows")[0].values, one.column("docs")[0].values
                for a, ids in _documents(one, v):
                    n = np.array([len(x) for x in ids], np.int64)
                    target, around = windows(ids, v.pad)
                    of = np.repeat(np.arange(len(ids)), n)
                    value = np.bincount(of, network.log_probabilities(target, around), len(ids)).astype(float)
                    rare = target >= v.classes_from
                    held, own = np.unique(of[rare] * ENDINGS + (target[rare].astype(np.int64) - v.classes_from), return_counts=True)
                    others = np.maximum(v.class_totals[held % ENDINGS] - own, 0)
                    value -= np.bincount(held // ENDINGS, own * np.log(others + v.novel), len(ids))
                    part = slice(a, a + len(ids))
                    yield pa.RecordBatch.from_arrays([rows[part], docs[part], pa.array(n), pa.array(value)], ["row", "doc_id", "n_tokens", "value"])

    return packed.select("rows", "docs", "sizes", "ids").mapInArrow(scored, "row long, doc_id long, n_tokens long, value double")


def class_scores(numbered: DataFrame, v: Vocabulary) -> DataFrame:
    """row, inside: the summed logarithms of c + m * s of a row's words of classes."""
    count = max(LEAST_BUCKETS, 2 * numbered.rdd.getNumPartitions())

    def hashed(batches):
        import pyarrow as pa

        cutter = Words(v)
        for batch in text_slices(batches, ("row", "text")):
            words, sizes, _, rare = cutter.cut(batch.column("text"))
            row = np.repeat(batch.column("row").to_numpy(), sizes)[rare]
            words = words.filter(pa.array(rare))
            for a, keys, spelled in cutter.rare(words):
                bucket = (keys >> np.uint64(40)) % np.uint64(count)
                order = np.argsort(bucket, kind="stable")
                bucket, keys, rows, spelled = bucket[order], keys[order], row[a : a + len(keys)][order], spelled[order].astype("<f2")
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                blobs = []
                for i, j in zip(cuts, cuts[1:], strict=False):  # byte by byte, so that what is alike lies together
                    low = keys[i:j].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH]
                    near = (rows[i:j] - rows[i]).astype("<i8").view(np.uint8).reshape(-1, 8)
                    blobs.append(low.T.tobytes() + near.T.tobytes() + spelled[i:j].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts[:-1]].astype(np.int64)), pa.array(rows[cuts[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "first", "words"]
                )

    def counted(batches):
        import pyarrow as pa

        for t in whole_groups(batches, ["bucket"]):
            keys, rows, spelled = [], [], []
            for first, blob in zip(t.column("first").to_pylist(), t.column("words").to_pylist(), strict=True):
                raw = np.frombuffer(blob, np.uint8)
                n = len(raw) // (_HASH + 10)
                key = np.zeros((n, 8), np.uint8)
                key[:, :_HASH] = raw[: _HASH * n].reshape(_HASH, n).T
                keys.append(key.view("<u8").ravel())
                rows.append(np.ascontiguousarray(raw[_HASH * n : (_HASH + 8) * n].reshape(8, n).T).view("<i8").ravel() + first)
                spelled.append(raw[(_HASH + 8) * n :].view("<f2"))
            key, row, log_spelled = np.concatenate(keys), np.concatenate(rows), np.concatenate(spelled)
            order = np.lexsort((row, key))
            key, row, log_spelled = key[order], row[order], log_spelled[order].astype(float)
            word = np.concatenate([[True], key[1:] != key[:-1]])
            pair = word | np.concatenate([[True], row[1:] != row[:-1]])
            starts = np.flatnonzero(pair)
            own = np.diff(np.concatenate([starts, [len(key)]]))
            total = np.bincount(np.cumsum(word) - 1)[(np.cumsum(word) - 1)[starts]]
            with np.errstate(divide="ignore"):
                value = own * np.logaddexp(np.log(total - own), math.log(v.novel) + log_spelled[starts])
            found, of = np.unique(row[starts], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(of, value))], ["row", "inside"])

    words = numbered.select("row", "text").mapInArrow(hashed, "bucket long, first long, words binary")
    by_bucket = words.repartition("bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(counted, "row long, inside double").groupBy("row").agg(F.sum("inside").alias("inside"))


def fit_and_score(docs: DataFrame, rounds: int = ROUNDS, branches: int | None = None, shard_words: int | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over all words), mean_log_prob (null without words) for every row of docs.

    Trains on and counts all rows of docs. Words are what spaces and line ends part, lower-cased. A null or empty
    text has no words and the score 0; rows that repeat a doc_id are documents of their own; very long texts
    are one document. Without rows the result is empty.
    """
    counts = word_counts(docs)
    v = vocabulary(counts, branches)
    delete_table(counts)
    numbered = number_rows(docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")), "row")
    packed = shards(numbered, v, shard_words)
    inside = materialize(class_scores(numbered, v), "inside")
    delete_table(numbered)
    by_row = network_scores(packed, v, fit(packed, v, rounds))
    log_prob = F.when(F.col("n_tokens") > 0, F.col("value") + F.coalesce("inside", F.lit(0.0))).otherwise(0.0)
    rows = by_row.join(inside, "row", "left").select("doc_id", "n_tokens", log_prob.alias("log_prob"))
    found = materialize(rows.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))), "scores")
    for table in (packed, inside):
        delete_table(table)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document's pseudo-log-likelihood under a network trained on all of them."""
    return fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
