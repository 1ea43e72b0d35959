"""Change tables: a kept state and the batches after it, merged when read.

A stream appends each micro-batch of change rows to a folder of its own. The state remembers the last batch it has
taken in, its high-water mark; a read folds only the batches after it into the state, and ``fold_tail`` moves the mark
and drops what it has passed. A batch that is written again after a failure replaces itself; one that the state
already has is not applied again, so every change counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.changes import fold_changes, upsert, visible
from strata.operators.state import PART, files_of, apply_to_state, exists, read_layout, stored_state
from strata.streaming.ingest import CHECKPOINT_INTERVAL_MS

BATCH = "_batch"


def ingest_batches(stream: DataFrame, path: str, checkpoint: str, interval_ms: int = CHECKPOINT_INTERVAL_MS,
                   once: bool = False) -> StreamingQuery:
    """Append the micro-batches of a stream of change rows to the change table in ``path``, each exactly once.

    A table that has batches or a state goes on with the checkpoint it was made with: a new one would count batches
    from 0 again, and they would take the place of old ones.
    """
    spark = stream.sparkSession
    if exists(spark, path) and not exists(spark, checkpoint):
        raise ValueError(f"{path} has data, but its checkpoint {checkpoint} is missing")

    def append(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/log/{BATCH}={batch}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval_ms} milliseconds")
    return writer.start()


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches in the log; the log is short, since folded batches go."""
    files, folder = files_of(spark, f"{path}/log")
    if not files.exists(folder):
        return []
    place, found = spark._jvm.org.apache.hadoop.fs.Path, []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(f"{BATCH}=") and files.exists(place(status.getPath(), "_SUCCESS")):
            found.append(int(name.partition("=")[2]))
    return sorted(found)


def _applied(spark: SparkSession, path: str) -> int:
    layout = read_layout(spark, f"{path}/state")
    return -1 if layout is None else layout.applied


def read_tail(spark: SparkSession, path: str) -> DataFrame | None:
    """Change rows that the state has not taken in yet; None without any."""
    after = _applied(spark, path)
    tail = [number for number in batches(spark, path) if number > after]
    return spark.read.parquet(*[f"{path}/log/{BATCH}={number}" for number in tail]) if tail else None


def read_table(spark: SparkSession, path: str, keys: Sequence[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """The table as of the batches ingested so far: the state, with the tail folded into it."""
    tail = read_tail(spark, path)
    if read_layout(spark, f"{path}/state") is None:
        if tail is None:
            raise ValueError(f"no batch in {path} yet")
        return fold_changes(tail, keys, seq, op).drop(seq, op)
    state = stored_state(spark, f"{path}/state")
    return visible(state if tail is None else upsert(state, tail, keys, seq, op, patch=True))


def fold_tail(spark: SparkSession, path: str, keys: Sequence[str], seq: str = "seq", op: str = "op",
              parts: int | None = None, rows_per_part: int | None = None) -> int:
    """Take the tail into the state and drop its batches; returns the last batch that the state has."""
    tail, numbers = read_tail(spark, path), batches(spark, path)
    if tail is not None:
        if read_layout(spark, f"{path}/state") is not None:
            parts = None  # only a new state is given its number of partitions
        apply_to_state(f"{path}/state", tail, keys, seq, op, parts, batch=numbers[-1], rows_per_part=rows_per_part)
    applied = _applied(spark, path)
    for number in numbers:
        if number <= applied:
            files, folder = files_of(spark, f"{path}/log/{BATCH}={number}")
            files.delete(folder, True)
    return applied


def tail_rows(spark: SparkSession, path: str) -> int:
    """Change rows that reads have to fold, which tells when ``fold_tail`` is due."""
    tail = read_tail(spark, path)
    return 0 if tail is None else tail.agg(F.count(F.lit(1))).first()[0]


def _copy_rows(spark: SparkSession, source: str, target: str) -> None:
    """The rows of a Parquet folder, copied by a job."""
    if exists(spark, source):
        rows = spark.read.parquet(source)
        by = [PART] if PART in rows.columns else []
        rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(target)


def _copy_files(spark: SparkSession, source: str, target: str) -> None:
    """Small files, such as a checkpoint's or a layout's, one after the other."""
    files, folder = files_of(spark, source)
    if files.exists(folder):
        to, place = files_of(spark, target)
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, folder, to, place, False, True, spark._jsc.hadoopConfiguration())


def _copy_table(spark: SparkSession, source: str, target: str, numbers: list[int]) -> None:
    _copy_rows(spark, f"{source}/state", f"{target}/state")
    _copy_files(spark, f"{source}/state/_layout", f"{target}/state/_layout")
    for number in numbers:
        _copy_rows(spark, f"{source}/log/{BATCH}={number}", f"{target}/log/{BATCH}={number}")


def savepoint(spark: SparkSession, path: str, checkpoint: str, target: str) -> int:
    """Keep a stopped change table and its checkpoint as they are in the folder ``target``; returns the last batch.

    The table and the checkpoint must stand at the same batch: a batch that was written but not committed would be
    read again by a job that goes on from here, so it is left out. A name is used once.
    """
    if exists(spark, target):
        raise ValueError(f"the savepoint {target} exists already")
    files, folder = files_of(spark, f"{checkpoint}/commits")
    done = [int(status.getPath().getName()) for status in files.listStatus(folder) if status.getPath().getName().isdigit()] if files.exists(folder) else []
    last = max(done, default=-1)
    if _applied(spark, path) > last:
        raise ValueError(f"the state of {path} is ahead of its checkpoint")
    _copy_table(spark, path, f"{target}/table", [number for number in batches(spark, path) if number <= last])
    _copy_files(spark, checkpoint, f"{target}/checkpoint")
    for name in ("offsets", "commits"):  # entries of a batch that was begun
        files, folder = files_of(spark, f"{target}/checkpoint/{name}")
        for status in files.listStatus(folder) if files.exists(folder) else []:
            number = status.getPath().getName().lstrip(".").split(".")[0]
            if number.isdigit() and int(number) > last:
                files.delete(status.getPath(), False)
    return last


def restore(spark: SparkSession, target: str, path: str, checkpoint: str) -> None:
    """Set up a change table and its checkpoint from a savepoint, in folders that do not exist yet.

    A job started there reads what came after the savepoint, and nothing twice.
    """
    for folder in (path, checkpoint):
        if exists(spark, folder):
            raise ValueError(f"{folder} exists already")
    _copy_table(spark, f"{target}/table", path, batches(spark, f"{target}/table"))
    _copy_files(spark, f"{target}/checkpoint", checkpoint)
