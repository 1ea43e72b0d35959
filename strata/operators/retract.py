"""Aggregates kept through inserts, updates and deletes.

Row kinds (see ``row_kinds``) become signed counts: +1 for a row that came, -1 for one that went. They are summed into
a kept support, the number of rows of each group and value, from which count, sum, minimum and maximum of the touched
groups follow without the source table: a minimum that is taken back has its successor in the support. Support and
totals are partitioned by the first group column, and only partitions with changes are read and rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.money import units
from strata.operators.state import exists
from strata.session import written

# Row kinds of a changelog and whether the row came or went.
SIGNS = {"+I": 1, "+U": 1, "-U": -1, "-D": -1}


def signed(kinds: DataFrame, group: Sequence[str], value: str, kind: str = "row_kind") -> DataFrame:
    """group..., value and n: by how many rows the count of the value changes in the group."""
    sign = F.coalesce(*[F.when(F.col(kind) == name, F.lit(n)) for name, n in SIGNS.items()],
                      F.raise_error(F.concat(F.lit("unknown row kind "), F.col(kind))).cast("int"))
    return kinds.groupBy(*group, F.col(value).alias("value")).agg(F.sum(sign).alias("n")).where("n <> 0")


def _replace(rows: DataFrame, path: str, by: str) -> None:
    if not exists(rows.sparkSession, path):  # a file without rows keeps the types: folder names do not, and no partition may follow
        rows.select(*[name for name in rows.columns if name != by], by).limit(0).write.mode("overwrite").parquet(f"{path}-types")
    rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """What ``_replace`` has written, with its types, also where that is no row at all."""
    reader = spark.read
    if exists(spark, f"{path}-types"):
        reader = reader.schema(spark.read.parquet(f"{path}-types").schema)
    return reader.parquet(path)


def refresh(path: str, deltas: DataFrame, group: Sequence[str], scale: int) -> None:
    """Fold ``deltas`` (see ``signed``) into the aggregate kept in the folder ``path``, created if missing.

    Sums are exact to ``scale`` digits. Rows that are taken back without ever having come are an error. A group
    that has lost all its rows stays as a row with count 0, which readers do not see, so its partition is replaced.
    """
    spark = deltas.sparkSession
    deltas = written(deltas.select(*group, "value", "n"), "deltas")
    held = deltas
    if exists(spark, f"{path}/support"):
        touched = deltas.select(group[0]).distinct()
        old = _read(spark, f"{path}/support").select(*deltas.columns)
        held = old.join(touched.withColumnRenamed(group[0], "_touched"), F.col(group[0]).eqNullSafe(F.col("_touched")), "left_semi").unionByName(deltas)
    gone = deltas.select(*group).distinct().select(*group, F.lit(None).cast(deltas.schema["value"].dataType).alias("value"),
                                                   F.lit(0).cast("long").alias("n"))
    count = F.sum("n")
    sound = F.when(count < 0, F.raise_error(F.lit("rows are taken back that never came")).cast("long")).otherwise(count)
    support = written(held.unionByName(gone).groupBy(*group, "value").agg(sound.alias("n")).where("n > 0 OR value IS NULL"), "support")
    total = F.sum(units("value", scale).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
    real = F.when(F.col("n") > 0, F.col("value"))
    totals = support.groupBy(*group).agg(
        F.sum("n").alias("rows"), (total * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})").alias("total"),
        F.min(real).alias("low"), F.max(real).alias("high"))
    _replace(totals, f"{path}/totals", group[0])
    _replace(support, f"{path}/support", group[0])


def read_refreshed(spark: SparkSession, path: str) -> DataFrame:
    """group..., rows, total, low, high of every group that has rows."""
    return _read(spark, f"{path}/totals").where("rows > 0")
