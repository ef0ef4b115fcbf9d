"""Sources polled into a log: once, or at intervals, with a revision for each poll.

A poll is a micro-batch: the trigger sets the pace, and the revision of a poll
is the first one plus the batch's number, so it grows and is the same again if
a batch is retried.  What a batch reads is written as the log's partition of
that revision, replacing what a failed attempt may have left.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import number_rows
from ..operators.revision import LOG_SCHEMA, snapshot
from ..sources import adapters
from ..sources.records import edges, ingest

#: Milliseconds between polls unless a source says otherwise.
INTERVAL = 5000


def poll_once(spark: SparkSession, spec: dict, log: str, revision: int, edge_log: str | None = None) -> dict:
    """One reading of a source into the log at ``log``; returns counts."""
    found = adapters.read(spark, spec)
    rows = ingest(found, spec["id"], int(time.time() * 1000), revision)
    path = f"{log}/source={spec['id'].replace(':', '_').replace('/', '_')}/batch={revision}"
    rows.write.mode("overwrite").parquet(path)
    out = {"source": spec["id"], "revision": revision, "facts": spark.read.schema(LOG_SCHEMA).parquet(path).count()}
    if edge_log:
        edges(found).write.mode("overwrite").parquet(f"{edge_log}/batch={revision}")
    return out


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").schema(LOG_SCHEMA).parquet(log)


def start(spark: SparkSession, spec: dict, log: str, checkpoint: str, first_revision: int = 1, on_error: str = "continue", stats: list | None = None) -> StreamingQuery:
    """Polls a source: ``poll_mode`` event reads once, interval reads every ``poll_interval_ms``.

    A failing poll is recorded in ``stats`` and, unless ``on_error`` is stop,
    the next one goes ahead.  Stop it with the query's ``stop``.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    interval = int(spec.get("poll_interval_ms") or INTERVAL)

    def batch(_: DataFrame, number: int) -> None:
        try:
            done = poll_once(spark, spec, log, first_revision + number)
        except Exception as e:
            if stats is not None:
                stats.append({"revision": first_revision + number, "error": str(e)})
            if on_error == "stop":
                raise
            return
        if stats is not None:
            stats.append(done)

    writer = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if str(spec.get("poll_mode", "event")) == "interval":
        return writer.trigger(processingTime=f"{interval} milliseconds").start()
    return writer.trigger(once=True).start()


def stream_records(spark: SparkSession, path: str, spec_id: str, log: str, checkpoint: str, first_revision: int = 1, available_now: bool = True) -> StreamingQuery:
    """Files of JSON lines that arrive in a folder, each micro-batch a revision of the log."""
    lines = spark.readStream.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")

    def batch(rows: DataFrame, number: int) -> None:
        # numbered by what they are, so that a batch that is retried numbers them alike
        records = number_rows(rows, ["path", "value"], "record_no").select("record_no", F.col("value").alias("body"))
        ingest(records, spec_id, 0, first_revision + number).write.mode("overwrite").parquet(f"{log}/source={spec_id.replace(':', '_')}/batch={first_revision + number}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{INTERVAL} milliseconds")).start()


def current(spark: SparkSession, log: str, frontier: int | None = None) -> DataFrame:
    """Facts of the log as of a revision.  Late rows count by their revision, whenever they came."""
    return snapshot(read_log(spark, log), frontier)
