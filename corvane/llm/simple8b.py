"""Token ids in Simple-8b blocks.

Each 64-bit word has a selector in its upper 4 bits and, below, as many ids of one width as fit: the first
is in the lowest bits. Selectors 0 and 1 stand for runs of 240 and 120 zeros and hold nothing else. An id of
2**60 or more is an escape: the word holds 0 in its place and the block lists its position and value.

A file is a Parquet table of blocks, written in ascending doc_id order: part, block, token_base (ids of
this part before the block), words, escapes, and the doc_id and number of ids of each document in it. A block
ends with the document that fills it, so every document lies in one block and each block is decoded alone: the
selectors' counts, added up, give the place of every word's ids, and all words of a selector are unpacked together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table_path
from corvane.llm.tokens import encoder, text_slices

#: Distinct pieces of text that a worker keeps with their ids: writing needs little memory beside them.
KEPT_PIECES = 1_000_000
#: Fixed values of the format: ids in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

BLOCK_SCHEMA = (
    "part int, block long, token_base long, words binary, escape_at binary, escape_value binary, "
    "doc_ids array<long>, doc_tokens array<long>"
)


#: Bits of each value below 2**16, where most ids are.
_BITS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
_STEP = COUNTS.astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 for 0."""
    if not len(values) or values.max() < 1 << 16:
        return _BITS[values]
    return np.array([int(v).bit_length() for v in values], np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escape_at, escape_value) of unsigned integers, greedily: most ids first."""
    n = len(values)
    bits = _bits(values)
    values = values.astype(np.uint64)
    at = np.flatnonzero(bits > 60)
    escaped = values[at]
    if len(at):
        values[at], bits[at] = 0, 0
    # the widest value of the next c ids, for every position, by doubling; past the end none fits
    spans = {1: np.concatenate([bits, np.full(240, 255, np.uint8)])}
    for p in (1, 2, 4, 8, 16, 32, 64):
        spans[2 * p] = np.maximum(spans[p][:-p], spans[p][p:])
    selector = np.zeros(n, np.uint8)
    for c, width in zip(COUNTS.tolist(), WIDTHS.tolist(), strict=True):  # if one selector fits, all after it do
        p = 1 << (c.bit_length() - 1)
        widest = np.maximum(spans[p][:n], spans[p][c - p : c - p + n]) if p < c else spans[p][:n]
        selector += widest > width
    jumps, chosen, i = _STEP[selector].tobytes(), [], 0
    while i < n:
        chosen.append(i)
        i += jumps[i]
    starts = np.array(chosen, np.int64)
    selectors = selector[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selectors):
        if WIDTHS[s]:
            rows = np.flatnonzero(selectors == s)
            first, word = starts[rows], words[rows]
            for k in range(COUNTS[s]):
                word |= values[first + k] << np.uint64(k * WIDTHS[s])
            words[rows] = word
    return words, at.astype(np.uint32), escaped


def decode(words: np.ndarray, at: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The values that encode() took; every selector's words are decoded together, each to its own place."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    starts = ends - COUNTS[selectors]
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint64)
    for s in np.unique(selectors):
        width = int(WIDTHS[s])
        if width:
            rows = np.flatnonzero(selectors == s)
            word, first, mask = words[rows], starts[rows], np.uint64((1 << width) - 1)
            for k in range(COUNTS[s]):
                out[first + k] = (word >> np.uint64(k * width)) & mask
    out[at] = escaped
    return out


def _cuts(offsets: np.ndarray, block_ids: int) -> list[int]:
    """Where blocks begin and end among documents: each is closed by the document that fills it."""
    cuts, n = [0], len(offsets) - 1
    while cuts[-1] < n:
        cuts.append(min(n, int(np.searchsorted(offsets, offsets[cuts[-1]] + block_ids, "left"))))
    return cuts


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, block_ids: int = 1 << 18) -> None:
    """Encodes docs (doc_id, text) and writes the file at path, part by part in ascending doc_id order.

    A null or empty text has the end id only. Rows that repeat a doc_id are kept, ordered by text; a null
    doc_id comes first. Other columns are not written.
    """

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema(
            [("part", pa.int32()), ("block", pa.int64()), ("token_base", pa.int64())]
            + [(c, pa.binary()) for c in ("words", "escape_at", "escape_value")]
            + [("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))]
        )
        part, number, base = TaskContext.get().partitionId(), 0, 0
        encode_texts = encoder(tokenizer_path, KEPT_PIECES).encode
        for batch in text_slices(batches):
            ids, offsets = encode_texts([t or "" for t in batch.column("text").to_pylist()])
            ids = np.insert(ids, offsets[1:], np.uint32(end_id))
            offsets = offsets + np.arange(len(offsets))
            doc_ids, held, rows = batch.column("doc_id").to_pylist(), np.diff(offsets).tolist(), []
            cuts = _cuts(offsets, block_ids)
            for i, j in zip(cuts, cuts[1:], strict=False):
                packed = [x.astype(x.dtype.newbyteorder("<")).tobytes() for x in encode(ids[offsets[i] : offsets[j]])]
                rows.append([part, number, base, *packed, doc_ids[i:j], held[i:j]])
                number, base = number + 1, base + int(offsets[j] - offsets[i])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file, with token_base counted from the start of the whole file.

    Only one total for each part is added up in one place and broadcast: as many rows as parts.
    """
    from pyspark.sql import Window

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return blocks.join(F.broadcast(bases), "part").withColumn("token_base", F.col("token_base") + F.col("_base")).drop("_base")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decodes a file: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers) of every document."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                ids = decode(
                    np.frombuffer(block["words"], "<u8"),
                    np.frombuffer(block["escape_at"], "<u4"),
                    np.frombuffer(block["escape_value"], "<u8"),
                ).astype("<u4")
                held = np.array(block["doc_tokens"], np.int64)
                ends = np.cumsum(held)
                payload = pa.Array.from_buffers(
                    pa.binary(), len(held), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32)), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc_ids"], pa.int64()), pa.array(ends - held + block["token_base"]), pa.array(held), payload],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return read_blocks(spark, path).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: writes all documents, reads the file back and returns the start, number and digest of each one's ids."""
    import public_tokenizers

    path = table_path(spark, "simple8b")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
