"""Table upkeep: compaction, snapshot retention, orphan files, reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from strata.functions.catalog import NORMAL_BELOW
from strata.operators.quality import search
from strata.session import written
from strata.sources.files import data_files, list_files

# Compaction strategies, snapshots kept by default.
STRATEGIES = ("minor", "full")
RETAIN_LAST = 10

SHARE_FILES = 10_000  # small files of a folder that one task packs, about
SHARE_PACKS = 64      # and their bytes, in target sizes


def _sized_session(spark: SparkSession, target_mb: int) -> SparkSession:
    """A session of its own, so that the settings do not leak into the caller's queries.

    Partition values stay the text of their folder, so ``007`` comes out as ``007``.
    """
    sized = spark.newSession()
    size = str(target_mb * 1024 * 1024)
    sized.conf.set("spark.sql.files.maxPartitionBytes", size)
    sized.conf.set("spark.sql.files.openCostInBytes", "0")
    sized.conf.set("spark.sql.files.minPartitionNum", "1")
    sized.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    sized.conf.set("spark.sql.adaptive.enabled", "true")
    sized.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    return sized


def _content(rows: DataFrame) -> tuple[int, int | None]:
    """Row count and the sum of a hash over all values of each row, whatever the order of rows."""
    maps = {field.name for field in rows.schema.fields if "map<" in field.dataType.simpleString()}
    values = [F.to_json(F.struct(F.col(f"`{name}`"))) if name in maps else F.col(f"`{name}`") for name in sorted(rows.columns)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*values).cast("decimal(38,0)")).alias("h")).first()
    return found.n, found.h


def compact(spark: SparkSession, path: str, output: str, strategy: str = "minor", target_mb: int = 128,
            partition_by: Sequence[str] = ()) -> dict[str, int]:
    """Rewrite all partitions of a Parquet table (full) or those with small files (minor) into ``output``.

    The input is only read, with the columns of all its files. A partition is rewritten whole, so that a
    reader switches from the old folder to the new one at once; a table without partitions is one partition.
    Without partitions no shuffle is needed: the scan itself packs small files into tasks of the target
    size and splits large ones. With partitions the rows are rebalanced by partition, where the adaptive
    planner joins small pieces and splits a large partition. Columns, row counts and contents of both
    sides are compared before the new files may be used.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    sized = _sized_session(spark, target_mb)
    whole = rows = sized.read.option("mergeSchema", True).parquet(path)
    if strategy == "minor":
        small = whole.where(F.col("_metadata.file_size") < target_mb * 1024 * 1024)
        rows = _in_same_partition(whole, small.select(*partition_by).distinct(), partition_by) if partition_by else (
            whole.limit(0) if small.isEmpty() else whole)
    packed = rows.hint("rebalance", *partition_by) if partition_by else rows
    packed.write.mode("errorifexists").partitionBy(*partition_by).parquet(output)
    new = sized.read.option("mergeSchema", True).parquet(output) if partition_by else sized.read.schema(rows.schema).parquet(output)
    before, after = _content(rows), _content(new.select(*[f"`{name}`" for name in rows.columns]) if new.columns else rows.limit(0))
    if before != after:
        raise RuntimeError(f"compaction of {path} wrote other rows than it read: {before[0]} and {after[0]}")
    return {"rows": after[0], "files_before": rows.select("_metadata.file_path").distinct().count(),
            "files_after": list_files(spark, output, "*.parquet").count()}


def _in_same_partition(rows: DataFrame, chosen: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    other = chosen.toDF(*[f"_{name}" for name in partition_by])
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in partition_by]
    return rows.join(other, same, "left_semi")


def file_groups(files: DataFrame, target: int) -> DataFrame:
    """folder, file_path, file_size, pack: small files of one folder that fit into ``target`` bytes together.

    ``files`` has file_path and file_size. Files of the target size or more, and files that are alone in their pack, are
    left out. Packs are filled first-fit, the longest file first. A folder with very many files is dealt by the hash
    of the path into shares of about ``SHARE_FILES`` files or ``SHARE_PACKS`` targets, each packed on its own.
    """

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["file_size", "file_path"], ascending=[False, True])
        room, places = np.zeros(len(rows), dtype=np.int64), []
        room[:] = target
        for size in rows["file_size"]:
            place = int(np.argmax(room >= size))
            room[place] -= size
            places.append(place)
        rows["pack"] = places
        return rows[rows.groupby("pack")["pack"].transform("size") > 1]

    small = files.where(F.col("file_size") < target).withColumn("folder", F.regexp_replace("file_path", "/[^/]*$", ""))
    shares = small.groupBy("folder").agg(F.greatest(
        F.ceil(F.count("*") / SHARE_FILES), F.ceil(F.sum("file_size") / (target * SHARE_PACKS))).alias("shares"))
    dealt = small.join(shares, "folder").select(
        "folder", "file_path", "file_size", F.pmod(F.xxhash64("file_path"), "shares").alias("share"))
    return (dealt.groupBy("folder", "share")
            .applyInPandas(packed, "folder string, file_path string, file_size long, share long, pack long")
            .select("folder", "file_path", "file_size", F.xxhash64("folder", "share", "pack").alias("pack")))


def compact_files(spark: SparkSession, path: str, output: str, target_mb: int = 128,
                  partition_by: Sequence[str] = ()) -> dict[str, int]:
    """Rewrite the small files of a Parquet table in groups; of files of the target size and more only footers are read.

    The input is only read. New files go to ``output``/rows, laid out as the table is; when their schema, row count and
    content have been compared, the list of the files they replace goes to ``output``/replaced. That list is
    what makes the new files count: ``read_compacted`` sees the old files before it is there and the new ones after.
    Later ``delete_files`` may remove the replaced files. Returns rows, files and bytes that were rewritten; without
    any, nothing is written.
    """
    target = target_mb * 1024 * 1024
    sized = _sized_session(spark, target_mb)
    groups = written(file_groups(data_files(spark, path), target), "file-groups")
    size = groups.agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes")).first()
    if not size["files"]:
        return {"rows": 0, "files_before": 0, "bytes_before": 0, "files_after": 0}
    whole = sized.read.option("mergeSchema", True).parquet(path)
    names = [f"`{name}`" for name in whole.columns]
    rows = whole.where(F.col("_metadata.file_size") < target).withColumn("_file", F.col("_metadata.file_path")).join(
        groups.select(F.col("file_path").alias("_file"), F.col("pack").alias("_pack")), "_file")
    layout = [*partition_by, "_pack"]
    rows.hint("rebalance", *layout).select(*names).write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{output}/rows")
    before, after = _content(rows.select(*names)), _content(_new_files(whole, output).select(*names))
    if before != after:
        raise RuntimeError(f"compaction of {path} wrote other rows than it read: {before[0]} and {after[0]}")
    groups.select("file_path", "file_size").write.mode("errorifexists").parquet(f"{output}/replaced")
    return {"rows": after[0], "files_before": size["files"], "bytes_before": size["bytes"],
            "files_after": data_files(spark, f"{output}/rows").count()}


def _new_files(whole: DataFrame, output: str) -> DataFrame:
    return whole.sparkSession.read.schema(whole.schema).parquet(f"{output}/rows")


def read_compacted(spark: SparkSession, path: str, output: str) -> DataFrame:
    """The rows of a table whose small files ``compact_files`` has rewritten into ``output``.

    Partition values stay the text of their folder. Without the list of replaced files ``output`` does not count.
    """
    # The schema comes from a session that keeps partition values as text, the plan is the caller's.
    schema = _sized_session(spark, 128).read.option("mergeSchema", True).parquet(path).schema
    whole = spark.read.schema(schema).parquet(path)
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/replaced/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return whole
    replaced = spark.read.schema("file_path string, file_size bigint").parquet(f"{output}/replaced")
    kept = whole.withColumn("_file", F.col("_metadata.file_path")).join(
        replaced.select(F.col("file_path").alias("_file")), "_file", "left_anti").drop("_file")
    return kept.unionByName(_new_files(whole, output))


def switch_table(spark: SparkSession, table: str, location: str) -> None:
    """Point a catalog table at the compacted folder; the old folder stays for a later cleanup."""
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}'")
    spark.catalog.refreshTable(table)


def switch_partitions(spark: SparkSession, table: str, compacted: str, partition_by: Sequence[str]) -> int:
    """Point the rewritten partitions of a catalog table at their new folders; returns how many.

    Each switch is one catalog change, so a reader sees a partition either old or new. The old folders
    stay for a later cleanup.
    """
    sized = _sized_session(spark, 128)
    parts = sized.read.parquet(compacted).select(*partition_by).distinct().collect()  # one row per rewritten partition
    for row in parts:
        spec = {name: "__HIVE_DEFAULT_PARTITION__" if row[name] is None else row[name] for name in partition_by}
        where = ", ".join(f"`{name}` = " + ("NULL" if row[name] is None else "'" + spec[name].replace("'", "\\'") + "'") for name in spec)
        folder = "/".join(f"{name}={value}" for name, value in spec.items())
        spark.sql(f"ALTER TABLE {table} PARTITION ({where}) SET LOCATION '{compacted.rstrip('/')}/{folder}'")
    spark.catalog.refreshTable(table)
    return len(parts)


def snapshots_to_expire(snapshots: DataFrame, retain_last: int = RETAIN_LAST, now=None,
                        max_age_days: int | None = None, table: str = "table_id") -> DataFrame:
    """Snapshots beyond the newest ``retain_last`` of their table, and older than the age if one is given.

    The newest ids are found first (each task passes on at most ``retain_last`` per table); the
    oldest kept id then cuts off the rest, so a table with very many snapshots is not sorted in one task.
    """
    if retain_last < 1:
        raise ValueError("at least one snapshot must stay")
    newest = snapshots.select(table, "snapshot_id").withColumn(
        "_rank", F.row_number().over(W.partitionBy(table).orderBy(F.desc("snapshot_id"))))
    oldest_kept = newest.where(F.col("_rank") <= retain_last).groupBy(table).agg(F.min("snapshot_id").alias("_kept"))
    expired = snapshots.join(oldest_kept, table).where(F.col("snapshot_id") < F.col("_kept"))
    if max_age_days is not None:
        limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {max_age_days} DAYS")
        expired = expired.where(F.col("commit_time") < limit)
    return expired.select(*snapshots.columns)


def orphan_files(listing: DataFrame, referenced: DataFrame, path: str = "path", before=None,
                 modified: str = "modificationTime") -> DataFrame:
    """Listed files that nothing refers to. This only reports; see ``delete_files``.

    With ``before`` only files last modified earlier count, so those of a running job are left alone.
    """
    if before is not None:
        listing = listing.where(F.col(modified) < F.lit(before).cast("timestamp"))
    return listing.join(referenced.select(path), path, "left_anti")


def delete_files(orphans: DataFrame, path: str = "path", confirm: bool = False, at_once: int = 16) -> int:
    """Delete reported files, only on request; returns how many went.

    The driver streams the paths and keeps ``at_once`` requests to the file system open; no file is read.
    """
    if not confirm:
        raise ValueError("deleting files needs confirm=True")
    spark = orphans.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def delete(row: Row) -> bool:
        target = hadoop.Path(row[0])
        return bool(target.getFileSystem(conf).delete(target, False))

    with ThreadPoolExecutor(at_once) as pool:
        return sum(sum(pool.map(delete, rows)) for rows in batched(orphans.select(path).toLocalIterator(), 1000))


def compaction_candidates(tables: DataFrame, layer: str | None = None, threshold: int = NORMAL_BELOW) -> DataFrame:
    """Tables with at least ``threshold`` files; an unknown count is no candidate."""
    return search(tables, layer=layer).where(F.col("file_count") >= max(1, threshold))


def run_batch(tables: DataFrame, operation: Callable[[Row], None], name: str, at_once: int = 4) -> DataFrame:
    """One maintenance operation on each table of a catalog selection; a failure does not stop the rest.

    The work of each operation is a Spark job of its own, and ``at_once`` of them share the executors. The driver holds
    one row per table. Returns one result row per table, in their order, for ``maintenance_report``.
    """
    spark = tables.sparkSession

    @inheritable_thread_target(spark)
    def run(table: Row) -> tuple:
        begun, status, message = time.monotonic(), "success", None
        try:
            operation(table)
        except Exception as problem:
            status, message = "failed", str(problem) or "operation failed"
        return (table["id"], f"{table['db']}.{table['table_name']}", name, status, message,
                int((time.monotonic() - begun) * 1000))

    with ThreadPoolExecutor(at_once) as pool:
        results = list(pool.map(run, tables.toLocalIterator()))
    return spark.createDataFrame(
        results, "table_id bigint, table string, operation string, status string, message string, duration_ms bigint")


def maintenance_overview(tables: DataFrame, snapshots: DataFrame, layer: str = "ods") -> DataFrame:
    """One row: tables of a layer, tables with too many files, tables with more snapshots than are kept by default."""
    counts = snapshots.groupBy(F.col("table_id").alias("_table")).agg(F.count(F.lit(1)).alias("_snapshots"))
    return tables.select("id", "layer", "file_count").join(counts, F.col("id") == F.col("_table"), "left").agg(
        F.count_if(F.col("layer") == layer).alias("n_layer"),
        F.count_if(F.col("file_count") > NORMAL_BELOW).alias("to_compact"),
        F.count_if(F.col("_snapshots") > RETAIN_LAST).alias("many_snapshots"))


def maintenance_report(results: DataFrame, operation: str = "operation", failed=None) -> DataFrame:
    """Per operation: how many were triggered and how many failed."""
    failed = F.col("status") == "failed" if failed is None else failed
    return results.groupBy(operation).agg(
        F.count_if(~failed).alias("triggered"), F.count_if(failed).alias("failed"))


def maintenance_failures(results: DataFrame) -> DataFrame:
    """The failed operations themselves, one row each."""
    return results.where(F.col("status") == "failed")


def maintenance_log(before: DataFrame, after: DataFrame, operation: str, status: str = "success",
                    duration_ms: int | None = None, tables: DataFrame | None = None, created_at=None) -> DataFrame:
    """Log rows with file metrics before and after an operation, one per table.

    With ``created_at`` and the catalog's ``tables`` (id, table_path) the rows also have what ``search_log`` reads:
    an id (a hash of table, operation and time, the same in a repeated run), the table's id, and the time.
    """
    metrics = ["file_count", "total_size_bytes"]
    side = lambda df, mark: df.select("table_path", *[F.col(m).alias(f"{m}_{mark}") for m in metrics])
    joined = side(before, "before").join(side(after, "after"), "table_path", "full_outer")
    found = []
    if created_at is not None:
        at = F.lit(created_at).cast("timestamp_ntz")
        joined = joined.join(tables.select("table_path", F.col("id").cast("bigint").alias("table_id")), "table_path", "left")
        found = [F.xxhash64("table_path", F.lit(operation), at).alias("id"), "table_id", at.alias("created_at")]
    return joined.select(
        *found, "table_path", F.lit(operation).alias("operation"), F.lit(status).alias("status"),
        F.lit(duration_ms).cast("bigint").alias("duration_ms"),
        *[f"{m}_{mark}" for m in metrics for mark in ("before", "after")])


def search_log(log: DataFrame, operation=None, status=None, table_id=None) -> DataFrame:
    return search(log, "created_at", "id", operation=operation, status=status, table_id=table_id)
