"""Listings of table files and snapshot files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name prefixes of data files and the name pattern of snapshot files.
DATA_PREFIXES = ("data-", "changelog-")
SNAPSHOT_FILES = r"^snapshot-\d+$"

# Field names of a snapshot document.
SNAPSHOT_SCHEMA = (
    "id bigint, schemaId bigint, commitKind string, timeMillis bigint, totalRecordCount bigint, "
    "deltaRecordCount bigint, baseManifestListSize bigint, deltaManifestListSize bigint"
)


def _unopened(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """All files below a folder that are not empty; contents are never opened as long as they are not selected.

    Spark packs files into tasks by their lengths, as if they were read. In a session of its own it does not, so there are
    about as many tasks as cores however many and however large the files are.
    """
    unread = spark.newSession()
    unread.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 60))
    unread.conf.set("spark.sql.files.openCostInBytes", "0")
    return (unread.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(root))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, length and modification time of all files below a folder that are not empty; contents are never opened."""
    return _unopened(spark, root, pattern).select("path", "length", "modificationTime")


def data_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """file_path and file_size of the files below a folder, written as a table's own ``_metadata`` has them."""
    return _unopened(spark, root, pattern).select("_metadata.file_path", "_metadata.file_size")


def _file_name(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def below_root(path: str, root: str) -> Column:
    """The part of a path below the folder ``root``, which only counts where the path begins with it.

    Listings give paths with a scheme; a root without one stands for the local path in them.
    """
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "") if "://" not in root and ":/" not in root else F.col(path)
    base = f"{root.rstrip('/')}/"
    return F.when(bare.startswith(base), F.substring(bare, F.lit(len(base) + 1), F.length(bare)))


def file_stats(listing: DataFrame, root: str, depth: int = 2) -> DataFrame:
    """Data file count and bytes per table; a table is the first ``depth`` folders below ``root``."""
    below = below_root("path", root)
    data_file = _file_name().startswith(DATA_PREFIXES[0])
    for prefix in DATA_PREFIXES[1:]:
        data_file = data_file | _file_name().startswith(prefix)
    return (
        listing.where(data_file & below.isNotNull())
        .groupBy(F.substring_index(below, "/", depth).alias("table_path"))
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("total_size_bytes"))
    )


def latest_numbered(listing: DataFrame, prefix: str) -> DataFrame:
    """Per folder the file ``prefix`` + number with the highest number."""
    name = _file_name()
    folder = F.substring("path", F.lit(1), F.length("path") - F.length(name) - 1)
    number = F.when(name.startswith(prefix), F.substring(name, F.lit(len(prefix) + 1), F.length(name)))
    return (
        listing.where(number.rlike("^[0-9]+$"))
        .groupBy(folder.alias("folder")).agg(F.max(F.struct(number.cast("bigint").alias("number"), "path")).alias("_f"))
        .select("folder", "_f.number", "_f.path")
    )


def snapshot_columns(df: DataFrame, record: str, *keep: str) -> DataFrame:
    """Snapshot rows from a parsed snapshot record."""
    field = lambda name: F.coalesce(F.col(f"{record}.{name}"), F.lit(0).cast("bigint"))
    return df.select(
        *keep,
        field("id").alias("snapshot_id"),
        field("schemaId").alias("schema_id"),
        F.coalesce(f"{record}.commitKind", F.lit("UNKNOWN")).alias("commit_kind"),
        F.when(field("timeMillis") > 0, F.timestamp_millis(f"{record}.timeMillis").cast("timestamp_ntz")).alias("commit_time"),
        field("totalRecordCount").alias("total_records"),
        field("deltaRecordCount").alias("delta_records"),
        (field("baseManifestListSize") + field("deltaManifestListSize")).alias("manifest_size"),
    )


def parse_snapshots(df: DataFrame, json_col: str) -> DataFrame:
    """Snapshot documents in a text column to rows; unreadable ones are left out."""
    parsed = df.withColumn("_snap", F.from_json(json_col, SNAPSHOT_SCHEMA)).where(F.col("_snap.id").isNotNull())
    return snapshot_columns(parsed, "_snap", *[name for name in df.columns if name != json_col])


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files below a folder with the path of their table, newest id first.

    The files of a table lie in its folder ``snapshot``; ``table_path`` is that folder's parent below ``path``.
    """
    rows = (
        spark.read.option("pathGlobFilter", "snapshot-*").option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("_path"))
        .where(F.col("_file").rlike(SNAPSHOT_FILES))
        .select("value", F.regexp_replace(below_root("_path", path), "/?(snapshot/)?[^/]*$", "").alias("table_path"))
    )
    return parse_snapshots(rows, "value").orderBy(F.desc("snapshot_id"))
