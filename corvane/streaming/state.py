"""Streams and state: read models folded from events, ledgers, windows and sessions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.session import table

#: Status that an event leaves behind, by its kind.
STATUS = {"signup": "pending", "view": "pending", "click": "active", "purchase": "approved", "error": "rejected"}


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Files that arrive in a folder as a stream; the query's checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def status_of(kind):
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), kind)


def read_model(events: DataFrame) -> DataFrame:
    """user_id, status, stake, seen of events: the last status, deposits less withdrawals, and how many events."""
    amount = F.floor("value").cast("decimal(28,0)")
    moved = F.when(F.col("event_type") == "purchase", amount).when(F.col("event_type") == "error", -amount).otherwise(0)
    return events.groupBy("user_id").agg(
        F.max_by(status_of(F.col("event_type")), F.struct("ts", "event_id")).alias("status"), F.sum(moved).cast("long").alias("stake"), F.count("*").alias("seen")
    )


def fold_stream(events: DataFrame) -> DataFrame:
    """The read model of a stream of events, kept as state by user: applyInPandasWithState.

    State is the last (ts, event_id), its status, the stake and the count; rows of a user may come in any order.
    """
    schema = "user_id long, status string, stake long, seen long"
    state = "ts long, event_id long, status string, stake long, seen long"

    def step(key, parts, held):
        ts, event_id, status, stake, seen = held.get if held.exists else (-(1 << 62), -1, "", 0, 0)
        for part in parts:
            for r in part.itertuples():
                amount = int(r.value // 1)
                stake += amount if r.event_type == "purchase" else -amount if r.event_type == "error" else 0
                seen += 1
                if (r.us, r.event_id) >= (ts, event_id):
                    ts, event_id, status = r.us, r.event_id, STATUS[r.event_type]
        held.update((ts, event_id, status, stake, seen))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "stake": [stake], "seen": [seen]})

    rows = events.select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, schema, state, "update", "NoTimeout")


def once(jobs: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once within the watermark: the ledger of what has been taken on."""
    return jobs.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Takes what has arrived, in micro-batches, and stops; a later run goes on from the checkpoint."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()


def ingest(batch: DataFrame, tries: int = 3) -> DataFrame:
    """Stage, attempt and readiness of documents (doc_id, text, attempt): failed ones go again until tries are used up."""
    bad = (F.col("text").isNull()) | (F.length(F.trim("text")) == 0)
    stage = F.when(bad & (F.col("attempt") + 1 < tries), "RETRY").when(bad, "FAILED").when(F.length("text") < 80, "PARTIAL_READY").otherwise("READY")
    return batch.select("doc_id", (F.col("attempt") + 1).alias("attempt"), stage.alias("stage"))


_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"


@query(
    "stream_read_model",
    f"""SELECT user_id, arg_max({_STATUS_SQL}, (ts, event_id)) AS status, CAST(sum(CASE event_type WHEN 'purchase' THEN floor(value) WHEN 'error' THEN -floor(value) ELSE 0 END) AS BIGINT) AS stake, count(*) AS seen FROM events GROUP BY 1""",
)
def stream_read_model(spark, sf_dir):
    return read_model(table(spark, sf_dir, "events"))


@query(
    "stream_windowed_counts",
    """SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def stream_windowed_counts(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.col("w.start").alias("window_start"), "n", "total")


@query(
    "stream_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def stream_sessions(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), "n")


@query("stream_ledger", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_ledger(spark, sf_dir):
    """The batch form of the ledger: the first job of each id."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query(
    "stream_ingest_stages",
    """SELECT doc_id, 1 AS attempt, CASE WHEN length(trim(text)) = 0 THEN 'RETRY' WHEN length(text) < 80 THEN 'PARTIAL_READY' ELSE 'READY' END AS stage FROM documents""",
)
def stream_ingest_stages(spark, sf_dir):
    return ingest(table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("attempt")))
