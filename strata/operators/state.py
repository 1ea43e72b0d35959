"""Kept state of a changing table: key-hash partitions that split as the table grows.

A state is a Parquet folder partitioned by the address of the key's hash, beside a small layout document: key columns,
number of partitions and the last applied batch. Addresses are those of linear hashing: with N partitions, N
between ``size`` and twice ``size``, a key lives at its hash modulo ``2 size`` if that is below N, else modulo ``size``.
Growing from N to M moves rows out of the partitions that split and touches no others.

The layout is replaced by one rename. A reader takes a row only where the layout puts its key, so rows that a
split has copied are seen once, before and after the layout changes, and also when a job dies in between. One writer
at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.changes import DELETED, SEQ, last_changes, to_state, visible
from strata.session import written

PART = "_part"
PARTS = 64  # partitions of a new state


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...]
    base: int          # partitions at the beginning
    parts: int         # partitions now
    applied: int = -1  # last batch that is in the state
    version: int = 0


def files_of(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    files, folder = files_of(spark, path)
    return files.exists(folder)


def read_layout(spark: SparkSession, path: str) -> Layout | None:
    """The newest layout of a state folder; None if there is no state yet."""
    files, folder = files_of(spark, f"{path}/_layout")
    if not files.exists(folder):
        return None
    names = [status.getPath() for status in files.listStatus(folder) if status.getPath().getName().endswith(".json")]
    if not names:
        return None
    stream = files.open(max(names, key=lambda name: name.getName()))
    try:
        values = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Layout(**values | {"keys": tuple(values["keys"])})


def put_layout(spark: SparkSession, path: str, layout: Layout) -> None:
    """Replace the layout: a new version beside the old ones, complete before it gets its name; the two before stay."""
    files, folder = files_of(spark, f"{path}/_layout")
    files.mkdirs(folder)
    place = spark._jvm.org.apache.hadoop.fs.Path
    part = place(folder, f".{layout.version:08d}.tmp")
    stream = files.create(part, True)
    stream.write(bytearray(json.dumps(asdict(layout)).encode()))
    stream.close()
    if not files.rename(part, place(folder, f"{layout.version:08d}.json")):
        raise RuntimeError(f"the layout of {path} has been changed by another writer")
    old = place(folder, f"{layout.version - 3:08d}.json")
    if files.exists(old):
        files.delete(old, False)


def _size(base: int, parts: int) -> int:
    """The largest doubling of ``base`` up to ``parts``."""
    while 2 * base <= parts:
        base *= 2
    return base


def address(keys: Sequence[str], base: int, parts: int) -> Column:
    """The partition of a key."""
    size = _size(base, parts)
    wide = F.pmod(F.xxhash64(*keys), F.lit(2 * size))
    return F.when(wide < parts, wide).otherwise(wide - size).cast("int")


def _origin(base: int, part: int, before: int) -> int:
    """The partition, when there were ``before``, that held what ``part`` holds now."""
    while part >= before:
        part -= _size(base, part)
    return part


def splits(base: int, before: int, after: int) -> list[int]:
    """The partitions that lose rows when ``before`` of them become ``after``."""
    return sorted({_origin(base, part, before) for part in range(before, after)})


def _rows(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """Rows where the layout puts their keys, with their partition."""
    return spark.read.parquet(path).where(F.col(PART) == address(layout.keys, layout.base, layout.parts))


def _write(rows: DataFrame, path: str) -> None:
    """Replace the partitions that ``rows`` has; a large one is written by several tasks."""
    rows.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def apply_to_state(path: str, changes: DataFrame, keys: Sequence[str], seq: str = "seq", op: str = "op",
                   parts: int | None = None, batch: int | None = None, rows_per_part: int | None = None) -> None:
    """Fold ``changes`` into the state kept in the folder ``path``, which is created if missing.

    Only partitions that have changes are read and rewritten; each is replaced whole. ``parts`` is the number of
    partitions of a new state; another number than that of an existing one is an error, see ``grow_state``. A ``batch``
    that is not after the last applied one is left out. With ``rows_per_part`` the state grows by itself.
    """
    spark = changes.sparkSession
    layout = read_layout(spark, path)
    if layout is None:
        if exists(spark, path):
            raise ValueError(f"{path} is not empty and no state")
        count = PARTS if parts is None else parts
        layout, fresh = Layout(tuple(keys), count, count), True
    else:
        fresh = False
        if tuple(keys) != layout.keys:
            raise ValueError(f"the state in {path} has the key {layout.keys}")
        if parts is not None and parts != layout.parts:
            raise ValueError(f"the state in {path} has {layout.parts} partitions, not {parts}; grow_state changes them")
        if batch is not None and batch <= layout.applied:
            return
    payload = [name for name in changes.columns if name not in {*keys, seq, op}]
    last = written(last_changes(to_state(changes.select(*keys, *payload), 0), changes, keys, seq, op)
                   .withColumn(PART, address(keys, layout.base, layout.parts)), "changes")
    new = last
    if not fresh:
        old = _rows(spark, path, layout).select(*last.columns).join(last.select(PART).distinct(), PART, "left_semi")
        both = old.select(*last.columns).withColumn("_late", F.lit(0)).unionByName(last.withColumn("_late", F.lit(1)))
        rest = [name for name in last.columns if name not in {*keys, SEQ}]
        newest = F.max_by(F.struct(SEQ, *rest), F.struct(SEQ, "_late")).alias("_n")
        new = written(both.groupBy(*keys).agg(newest).select(*[
            F.col(name) if name in keys else F.col(f"_n.{name}").alias(name) for name in last.columns]), "state")
    _write(new, path)
    applied = layout.applied if batch is None else batch
    put_layout(spark, path, Layout(layout.keys, layout.base, layout.parts, applied, layout.version + 1))
    if rows_per_part:
        needed = -(-_rows(spark, path, layout).count() // rows_per_part)
        if needed > layout.parts:
            grow_state(spark, path, needed)


def grow_state(spark: SparkSession, path: str, parts: int) -> list[int]:
    """Split partitions of a state until it has ``parts``; returns the numbers of those that were split."""
    layout = read_layout(spark, path)
    if layout is None:
        raise ValueError(f"no state in {path}")
    if parts < layout.parts:
        raise ValueError(f"the state in {path} has {layout.parts} partitions already")
    split = splits(layout.base, layout.parts, parts)
    if not split:
        return []
    now = address(layout.keys, layout.base, parts)
    rows = _rows(spark, path, layout).where(F.col(PART).isin(split)).withColumn("_now", now)
    moved = rows.where(F.col("_now") != F.col(PART)).drop(PART).withColumnRenamed("_now", PART)
    _write(moved, path)  # into new partitions, which nobody reads yet
    put_layout(spark, path, Layout(layout.keys, layout.base, parts, layout.applied, layout.version + 1))
    stay = written(rows.where(F.col("_now") == F.col(PART)).drop("_now"), "split")
    _write(stay, path)  # frees the room of what has moved; a reader sees no difference
    return split


def stored_state(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a state with their last change, deleted ones included."""
    layout = read_layout(spark, path)
    if layout is None:
        raise ValueError(f"no state in {path}")
    return _rows(spark, path, layout).drop(PART)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The table that a state folder stands for."""
    return visible(stored_state(spark, path))


__all__ = ["DELETED", "SEQ", "Layout", "address", "apply_to_state", "exists", "files_of", "grow_state", "put_layout", "read_layout", "read_state",
           "splits", "stored_state"]
