"""Continuous ingestion of change rows into an append-only log that readers fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strata.operators.changes import fold_changes

# Fixed value: default interval between checkpoints.
CHECKPOINT_INTERVAL_MS = 60_000


def stream_files(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                 files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, interval_ms: int = CHECKPOINT_INTERVAL_MS,
                  partition_by: Sequence[str] = (), once: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet folder exactly once.

    Progress lives in ``checkpoint``; the file sink's own log keeps files of a failed batch out of
    readers' sight. ``once`` takes what is there, in batches, and stops.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval_ms} milliseconds")
    return writer.start(path)


def resume_stream(stream: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Go on after a stop: the same folder and checkpoint, so only unseen input is read."""
    return ingest_stream(stream, path, checkpoint, **options)


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def read_current(spark: SparkSession, path: str, keys: Sequence[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """The table as of the batches ingested so far."""
    return fold_changes(spark.read.parquet(path), keys, seq, op)
