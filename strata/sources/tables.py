"""Warehouse tables: Parquet in the session catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def _spread(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of one table partition brought together, large partitions split by the adaptive planner.

    Without this every task would write a file into every partition.
    """
    return df.hint("rebalance", *partition_by) if partition_by else df


def write_path(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append") -> None:
    _spread(df, partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_table(df: DataFrame, name: str, keys: Sequence[str] = (), partition_by: Sequence[str] = (),
                mode: str = "append", buckets: int = 0, path: str | None = None) -> DataFrame:
    """Create database and table if missing and write ``df``; returns the table.

    Spark has no key constraint: the key list is kept as a table property, and ``buckets`` > 0
    stores the rows hashed by key so that later folds and joins on it need no shuffle.
    """
    spark = df.sparkSession
    database, _, _ = name.rpartition(".")
    if database:
        place = f" LOCATION '{path}-db'" if path else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")
    if buckets and keys:
        writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    else:
        writer = _spread(df, partition_by).write
    if path:
        writer = writer.option("path", path)
    writer.mode(mode).format("parquet").partitionBy(*partition_by).saveAsTable(name)
    if keys:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('strata.keys' = '{','.join(keys)}')")
    return spark.table(name)


def table_keys(spark, name: str) -> list[str]:
    """Key columns kept with the table; empty for an append-only table."""
    row = spark.sql(f"SHOW TBLPROPERTIES {name} ('strata.keys')").first()
    return row.value.split(",") if row and not row.value.startswith("Table ") else []
