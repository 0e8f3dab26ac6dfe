"""Quality by a byte-level convolutional network (bytenet.py), trained on a bounded sample and run over all texts.

About max_labelled labelled training rows, chosen by a hash of doc_id among those of at most max_bytes, train the
network in one task, in the order of their ids and texts; only its weights, 24 KB, reach the driver. Every text is then scored whole,
in chunks, in the task that reads it: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bytenet import ByteNet, fit
from corvane.llm.tokens import text_slices

#: The training sample: about so many labelled rows, of so many bytes of text each at most.
MAX_LABELLED, MAX_BYTES = 8_000, 32_768
EPOCHS, THRESHOLD = 10, 0.5


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, label of the training sample; labels that repeat a doc_id count once, by their largest."""
    rows = labels.where("quality is not null and doc_id is not null").where(~held_out())
    each = rows.groupBy("doc_id").agg((F.max("quality") > 0).cast("double").alias("label"))
    rate = min(1.0, max_labelled / max(1, each.count()))
    chosen = each.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    # about max_labelled rows of two numbers
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, epochs: int = EPOCHS) -> tuple[np.ndarray | None, float]:
    """(weights, share of good rows); no weights if there are no rows, or rows of one class only."""

    def learn(batches):
        import pyarrow as pa

        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True))
        y = np.array([r[2] for r in rows])
        share = (y.sum() + 1) / (len(y) + 2)
        if 0 < y.sum() < len(y):
            weights = fit([r[1].encode("utf-8", "surrogatepass") for r in rows], y, epochs).flat.tobytes()
        else:
            weights = None
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary()), pa.array([share])], ["weights", "share"])

    made = training_rows(docs, labels, max_labelled, max_bytes).repartition(1).mapInArrow(learn, "weights binary, share double").first()
    if made is None:
        return None, 0.5
    return None if made.weights is None else np.frombuffer(bytes(made.weights), np.float32), made.share


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    A null text is an empty one, which is a chunk of padding; a text of any length is read whole. Rows that repeat a text
    score alike (to six decimals). Without labels of both classes every row has the share of good rows among those there are, 0.5 without any.
    """
    weights, share = train(docs, labels, max_labelled, max_bytes, epochs)

    def scored(batches):
        import pyarrow as pa

        net = None if weights is None else ByteNet(weights.copy())
        for batch in text_slices(batches, size=1_000_000):
            text = batch.column("text").cast(pa.large_binary())
            if net is None:
                p = np.full(len(text), share)
            else:
                ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
                sizes = np.where(text.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
                p = net.probabilities(raw, ends[:-1], sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "p"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    probability = F.round("p", 6)
    return rows.mapInArrow(scored, "doc_id long, p double").select(
        "doc_id", held_out().alias("held_out"), probability.alias("score"), (probability >= THRESHOLD).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's quality."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
