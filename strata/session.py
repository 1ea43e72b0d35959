"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "strata", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and time zone UTC.

    Skewed joins are split even where that costs one more shuffle: a hot key must not sit in one task.
    Shuffle partition counts stay with the cluster: pass ``spark.sql.shuffle.partitions`` or
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` to fit the data at hand.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **{key.replace("__", "."): str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors both reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder in the warehouse takes its place on a local master; a cluster must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder all nodes can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work/{context.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and its true size is known to the planner.

    The file size is what lets the planner broadcast a small result and shuffle a large one.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession, keep_hours: float = 0.0) -> int:
    """Remove intermediate folders of ``fresh_path`` that are older than so many hours; returns how many.

    For the end of a job: results that still read such a folder must have been written elsewhere by then.
    The loop is over the folder's direct entries, one for each intermediate table, not over files.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(shared_folder(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    before, gone = (time.time() - keep_hours * 3600) * 1000, 0
    for entry in files.listStatus(root):
        named = re.search(r"-[0-9a-f]{32}$", entry.getPath().getName())
        if named and entry.getModificationTime() <= before:
            gone += bool(files.delete(entry.getPath(), True))
    return gone
