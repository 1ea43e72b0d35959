"""Active users from day bitmaps that are kept and merged, so that no report reads old events again.

A kept row is a day, a bucket of 32 768 neighbouring user ids and the bitmap of those who were active. A new day adds its
rows; week, month and retention are unions of bitmaps, and what two sets have in common follows from the size
of their union. User ids should be dense whole numbers: a bucket costs 4 KB for one user as for all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.operators.state import exists
from strata.plans.layers import RETENTION_DAYS
from strata.session import written


def activity_bitmaps(events: DataFrame, user: str = "user_id", time: str = "ts") -> DataFrame:
    """day, bucket, users (bitmap); partial bitmaps are merged in the map tasks, so a busy day is no hot key."""
    return events.where(F.col(user).isNotNull() & F.col(time).isNotNull()).groupBy(
        F.to_date(time).alias("day"), F.bitmap_bucket_number(user).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(user)).alias("users"))


def add_activity(path: str, events: DataFrame, user: str = "user_id", time: str = "ts") -> None:
    """Merge the activity of ``events`` into the bitmaps kept in the folder ``path``; only their days are rewritten."""
    spark = events.sparkSession
    new = written(activity_bitmaps(events, user, time), "bitmaps")
    if exists(spark, path):
        old = read_activity(spark, path).join(new.select("day").distinct(), "day", "left_semi")
        new = written(old.unionByName(new).groupBy("day", "bucket").agg(F.bitmap_or_agg("users").alias("users")), "bitmaps")
    new.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("day date, bucket bigint, users binary").parquet(path)


def active_users(bitmaps: DataFrame, unit: str = "day") -> DataFrame:
    """Start of each day, week or month, and how many users were active in it."""
    if unit not in ("day", "week", "month"):
        raise ValueError(f"unknown unit: {unit}")
    start = F.col("day") if unit == "day" else F.trunc("day", unit)
    merged = bitmaps.groupBy(start.alias("start"), "bucket").agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n"))
    return merged.groupBy("start").agg(F.sum("n").alias("active_users"))


def _counts(rows: DataFrame, sets: dict[int, list[list[str]]]) -> DataFrame:
    """day, day_offset and n: sizes of unions of bitmap columns, with their signs, summed over the buckets."""
    parts = [F.struct(F.lit(sign).alias("sign"), F.lit(i).alias("nr"), F.col(name).alias("users"))
             for sign, unions in sets.items() for i, names in enumerate(unions) for name in names]
    each = rows.select("day", "day_offset", "bucket", F.inline(F.array(*parts))).where("users IS NOT NULL")
    sizes = each.groupBy("day", "day_offset", "bucket", "sign", "nr").agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n"))
    return sizes.groupBy("day", "day_offset").agg(F.sum(F.col("sign") * F.col("n")).alias("n"))


def retention(bitmaps: DataFrame, days: Sequence[int] = RETENTION_DAYS) -> DataFrame:
    """Share of each first-day cohort that is active again some days later, from the bitmaps alone.

    ``past`` of a day has the users seen before it. New users are those that the day adds to ``past``; of them, a
    later day has those that it does not add to ``past`` with the day, but does add to ``past`` without it.
    """
    before = W.partitionBy("bucket").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    rows = written(bitmaps.select("day", "bucket", "users", F.bitmap_or_agg("users").over(before).alias("past")), "bitmaps")
    new = {1: [["past", "users"]], -1: [["past"]]}
    cohorts = _counts(rows.withColumn("day_offset", F.lit(0)), new).where("n > 0").select("day", F.col("n").alias("cohort_size"))
    met = None
    for k in days:
        later = rows.select(F.date_sub("day", k).alias("day"), "bucket", F.col("users").alias("later"))
        pair = rows.join(later, ["day", "bucket"]).withColumn("day_offset", F.lit(k))
        met = pair if met is None else met.unionByName(pair)
    back = _counts(met, {1: [["past", "users"], ["past", "later"]], -1: [["past"], ["past", "users", "later"]]})
    offsets = F.array(*[F.lit(k) for k in days])
    every = cohorts.select("day", "cohort_size", F.explode(offsets).alias("day_offset")).join(back, ["day", "day_offset"], "left")
    retained = F.coalesce("n", F.lit(0).cast("long"))
    return every.select(F.col("day").alias("cohort"), "cohort_size", "day_offset", retained.alias("retained"),
                        (retained.cast("double") / F.col("cohort_size")).alias("rate"))
