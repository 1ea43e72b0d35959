"""Materialized tables: a query kept as a table, by full refresh or by a stream of closed windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.sources.tables import write_path
from strata.streaming.ingest import CHECKPOINT_INTERVAL_MS, ingest_stream
from strata.streaming.metrics import as_event_time


def windowed_counts(df: DataFrame, time: str, width: str = "1 day") -> DataFrame:
    """Rows per window; runs on batch and on watermarked streams."""
    return df.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "rows")


def materialize(spark: SparkSession, select: str | Callable[[], DataFrame], path: str) -> DataFrame:
    """Full refresh: the whole result replaces the table in ``path``."""
    rows = spark.sql(select) if isinstance(select, str) else select()
    write_path(rows, path, mode="overwrite")
    return spark.read.parquet(path)


def materialize_stream(stream: DataFrame, aggregate: Callable[[DataFrame, str], DataFrame], time: str, delay: str,
                       path: str, checkpoint: str, interval_ms: int = CHECKPOINT_INTERVAL_MS,
                       once: bool = False) -> StreamingQuery:
    """Incremental refresh: windows are appended when the watermark has passed their end.

    State holds the open windows only. Rows later than ``delay`` are left out.
    """
    return ingest_stream(aggregate(as_event_time(stream, time, delay), time), path, checkpoint, interval_ms, once=once)


def with_open_windows(closed: DataFrame, rows: DataFrame, aggregate: Callable[[DataFrame, str], DataFrame], time: str,
                      width: str = "1 day") -> DataFrame:
    """The closed windows of ``materialize_stream`` and, from the source rows after them, the open ones.

    One value, the end of the last closed window, decides which rows are read again.
    """
    end = closed.agg((F.max("window_start") + F.expr(f"INTERVAL {width}")).alias("end")).first()["end"]
    later = rows if end is None else rows.where(F.col(time) >= F.lit(end))
    return closed.unionByName(aggregate(later, time))
