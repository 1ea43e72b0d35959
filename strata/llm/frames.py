"""Small Spark helpers of the pipeline operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import written


SMALL_BYTES = 64 << 20  # tables up to this size are broadcast


def small(spark: SparkSession, **columns) -> DataFrame:
    """A table from driver values. Callers pass values bounded by a parameter or by the number of partitions.

    It is broadcast up to ``SMALL_BYTES``; beyond, joins with it are planned as any others.
    """
    values = pa.table(columns)
    table = spark.createDataFrame(values)
    return F.broadcast(table) if values.nbytes <= SMALL_BYTES else table


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df``, which has narrow rows, to be broadcast if it has at most so many; they are counted."""
    return F.broadcast(df) if df.count() <= most else df


def indexed(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``index``: the place of each row, from 0, in the order of all rows by ``order``.

    A range sort, so one hot value of the first order column is split by the next ones. The sorted rows are
    written once; only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ordered.withColumn("_at", F.monotonically_increasing_id()), name)
    # The id holds the partition above bit 33 and the place in the partition below.
    counts = rows.groupBy(F.shiftright("_at", 33).alias("part")).count().orderBy("part").collect()
    base, bases = 0, []
    for row in counts:
        bases.append(base)
        base += row["count"]
    offsets = small(spark, _part=pa.array([row["part"] for row in counts], pa.int64()),
                    _base=pa.array(bases, pa.int64()))
    return (rows.withColumn("_part", F.shiftright("_at", 33)).join(offsets, "_part")
            .withColumn("index", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_base", "_at"))


def _run_starts(keys: np.ndarray) -> np.ndarray:
    """For each place, where its run of equal neighbouring keys begins."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def running(df: DataFrame, key: str, order: list, xors: list[str], name: str) -> DataFrame:
    """``df`` with ``at``, the place (from 0) of each row among those of its ``key`` in their ``order``, and with the
    columns ``xors`` (long) replaced by the exclusive or over the key's rows up to this one.

    A range sort cuts the rows of a long key over tasks. Each task counts on its own; what its first key has got in
    earlier tasks is one row for each task, added by a join. ``key`` is a long without nulls.
    """
    spark = df.sparkSession
    columns = [column for column in df.columns if column not in xors]

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, values, waiting = None, 0, [np.int64(0)] * len(xors), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                yield pa.RecordBatch.from_pydict(waiting)
            keys = batch[key].to_numpy()
            start = _run_starts(keys)
            goes_on = (start == 0) & (keys[0] == last)
            at = np.arange(len(keys)) - start + np.where(goes_on, count, 0)
            sums = []
            for column, value in zip(xors, values):
                upto = np.concatenate([[np.int64(0)], np.bitwise_xor.accumulate(batch[column].to_numpy())])
                sums.append(upto[1:] ^ upto[start] ^ np.where(goes_on, value, np.int64(0)))
            last, count, values = keys[-1], at[-1] + 1, [total[-1] for total in sums]
            ends = np.zeros(len(keys), dtype=bool)
            waiting = {**{column: batch[column] for column in columns}, **dict(zip(xors, map(pa.array, sums))),
                       "at": pa.array(at), "_part": batch["_part"], "_ends": pa.array(ends)}
        if waiting is not None:
            ends = np.zeros(len(waiting["at"]), dtype=bool)
            ends[-1] = True
            yield pa.RecordBatch.from_pydict(waiting | {"_ends": pa.array(ends)})

    ordered = df.select(*columns, *xors).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    fields = [f"`{field.name}` {field.dataType.simpleString()}" for field in df.select(*columns, *xors).schema]
    rows = written(ordered.withColumn("_part", F.spark_partition_id()).mapInArrow(
        accumulate, ", ".join([*fields, "at long", "_part int", "_ends boolean"])), name)
    parts, keys, counts, totals = [], [], [], []
    before = None  # the last key so far, its rows and its values
    for row in rows.where("_ends").select("_part", key, "at", *xors).orderBy("_part").collect():
        count, values = row["at"] + 1, [row[column] for column in xors]
        if before is not None:
            parts.append(row["_part"])
            keys.append(before[0])
            counts.append(before[1])
            totals.append(before[2])
            if before[0] == row[key]:
                count, values = count + before[1], [a ^ b for a, b in zip(values, before[2])]
        before = row[key], count, values
    carried = small(spark, _part=pa.array(parts, pa.int32()), **{key: pa.array(keys, pa.int64())},
                    _at=pa.array(counts, pa.int64()),
                    **{f"_{column}": pa.array([total[i] for total in totals], pa.int64()) for i, column in enumerate(xors)})
    none = F.lit(0).cast("long")
    joined = rows.join(carried, ["_part", key], "left")
    return joined.select(
        *columns, *[F.col(column).bitwiseXOR(F.coalesce(f"_{column}", none)).alias(column) for column in xors],
        (F.col("at") + F.coalesce("_at", none)).alias("at"))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
