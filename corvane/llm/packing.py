"""Packing by power-of-two decomposition.

A document of n tokens becomes floor(n / max_length) pieces of max_length tokens and one piece for each set
bit of the rest, longest first. A piece is a sequence of its own in the bucket of its length, so every
sequence has a power-of-two length, none holds two documents and none is padded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.tokens import encoder, text_slices

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def piece_lengths(n: int, max_length: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens, longest first; max_length is a power of two."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all docs (doc_id, text): doc_id, start, length, doc_tokens, ids, sequence_id, offset, bucket.

    ids are little-endian unsigned 32-bit integers; a null or empty text has the end id only. Rows that
    repeat a doc_id are packed one by one; a null doc_id stays null. Other columns are not carried along.
    offset is 0: a piece fills its sequence. bucket is the sequence's length. No row leaves its partition.
    """
    piece_lengths(0, max_length)

    def pieces(batches):
        import pyarrow as pa

        encode = encoder(tokenizer_path).encode
        for batch in text_slices(batches):
            ids, offsets = encode([t or "" for t in batch.column("text").to_pylist()])
            n = np.diff(offsets) + 1
            with_end = np.insert(ids, offsets[1:], np.uint32(end_id)).astype("<u4")
            lengths = [piece_lengths(int(x), max_length) for x in n]
            of = np.repeat(np.arange(len(n)), [len(x) for x in lengths])
            length = np.array([y for x in lengths for y in x], np.int64)
            ends = np.cumsum(length)
            doc_start = np.cumsum(n) - n
            payload = pa.Array.from_buffers(
                pa.binary(), len(length), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32)), pa.py_buffer(with_end)]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), pa.array(ends - length - doc_start[of]), pa.array(length), pa.array(n[of]), payload],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, SCHEMA)
    return rows.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("bucket"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences with one folder for each bucket, so that a reader batches equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the pieces of all documents with a digest of their ids."""
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
