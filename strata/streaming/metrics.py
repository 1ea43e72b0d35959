"""Lag and throughput, for batch and streaming DataFrames alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.times import micros_between


def lag_by_source(df: DataFrame, source: str, event_time: str, fetch_time: str) -> DataFrame:
    """Lag of each source in ms: at its newest fetch, and the largest so far."""
    lag_ms = F.floor(micros_between(event_time, fetch_time) / 1000).cast("bigint")
    return df.select(source, F.col(fetch_time).alias("_at"), lag_ms.alias("_lag")).groupBy(source).agg(
        F.max(F.struct("_at", "_lag")).alias("_last"), F.max("_lag").alias("max_lag_ms")).select(
        source, F.col("_last._lag").alias("lag_ms"), "max_lag_ms")


def as_event_time(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Event time and watermark of a stream; watermarks need a timestamp with zone (session zone UTC)."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def throughput(df: DataFrame, time: str, width: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """Rows and rows per second in fixed windows, per stage when ``by`` names it."""
    seconds = micros_between("w.start", "w.end")
    return df.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("w.start").alias("window_start"), *by, "rows",
        (F.col("rows").cast("double") / (seconds / 1_000_000)).alias("rows_per_second"))
