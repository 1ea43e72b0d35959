"""Distinct counts that merge: a small sketch of each column and table partition, kept beside the table.

An exact distinct count of a grown table reads it whole. Sketches of the old partitions are kept and those of a new
one added, so the count costs the new partition only. ``LG_K`` sets the size (2**14 registers, about 8 KB) and
the error: 0.8 % standard deviation; ``MOST_ERROR`` is what four of them allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14
MOST_ERROR = 0.035


def sketch_columns(df: DataFrame, columns: Sequence[str], partition: str) -> DataFrame:
    """part, name, rows and sketch for every column and partition; null is no value. One pass over the rows."""
    named = {f"c{i}": name for i, name in enumerate(columns)}
    sums = df.groupBy(F.col(partition).cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.hll_sketch_agg(name, LG_K).alias(short) for short, name in named.items()])
    return sums.select("part", "rows", F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(short).alias("sketch")) for short, name in named.items()])))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """name, rows, distinct_values and uniqueness of each column over all partitions."""
    merged = sketches.groupBy("name").agg(
        F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))
    return merged.withColumn("uniqueness", F.least(F.lit(1.0), F.try_divide(F.col("distinct_values").cast("double"), "rows")))
