"""Kept bitmaps against counts of distinct users; sketches; quality results of an observed write."""

import datetime
import glob
import os
import random

from conftest import rows_of
from pyspark.sql import functions as F

from strata.operators import activity, sketches
from strata.operators import quality as op
from strata.operators.quality import Rule
from strata.plans.layers import ads_user_retention


def _events(make, seed, n=300, users=(1, 2, 3, 7, 32767, 32768, 32769, 100_000, 5_000_000)):
    pick = random.Random(seed)
    rows = [(pick.choice(users), datetime.datetime(2024, 1, 28) + datetime.timedelta(days=pick.choice([0, 1, 2, 7, 8, 15, 20]), hours=pick.randrange(24)))
            for _ in range(n)]
    return make([*rows, (None, rows[0][1]), (3, None)], "user_id bigint, ts timestamp_ntz")


def test_bitmaps_count_users_of_days_weeks_and_months(spark, make, tmp_path):
    path, parts = str(tmp_path / "kept"), [_events(make, seed, 25) for seed in range(3)]
    for part in parts:
        activity.add_activity(path, part)
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("ts IS NOT NULL AND user_id IS NOT NULL")
    kept = activity.read_activity(spark, path)
    for unit in ("day", "week", "month"):
        expected = every.groupBy(F.date_trunc(unit, "ts").cast("date").alias("start")).agg(F.count_distinct("user_id").alias("n"))
        assert rows_of(activity.active_users(kept, unit), "start", "active_users") == rows_of(expected, "start", "n")


def test_retention_from_bitmaps_equals_that_from_events(spark, make, tmp_path):
    for seed in range(3):
        path, events = str(tmp_path / f"kept{seed}"), _events(make, seed, 20 + 60 * seed)
        activity.add_activity(path, events)
        names = "cohort", "cohort_size", "day_offset", "retained", "rate"
        assert rows_of(activity.retention(activity.read_activity(spark, path)), *names) == rows_of(ads_user_retention(events.where("ts IS NOT NULL")), *names)


def test_a_new_day_rewrites_no_other(spark, make, tmp_path):
    path = str(tmp_path / "kept")
    events = _events(make, 4)
    activity.add_activity(path, events.where("ts < '2024-02-10'"))
    before = set(glob.glob(f"{path}/day=*/*.parquet"))
    activity.add_activity(path, events.where("ts >= '2024-02-10'"))
    after = set(glob.glob(f"{path}/day=*/*.parquet"))
    assert before < after and {os.path.basename(os.path.dirname(name)) for name in after - before} <= {"day=2024-02-12", "day=2024-02-17"}


def test_sketches_of_parts_merge_to_that_of_the_whole(spark, make):
    rows = spark.range(60_000).select(F.col("id"), (F.col("id") % 777).alias("few"), F.when(F.col("id") < 0, "x").alias("none"), (F.col("id") % 5).alias("part"))
    names = ["id", "few", "none"]
    kept = sketches.sketch_columns(rows.where("part < 4"), names, "part").unionByName(sketches.sketch_columns(rows.where("part = 4"), names, "part"))
    found = {row.name: row for row in sketches.merge_sketches(kept).collect()}
    assert {name: row.rows for name, row in found.items()} == dict.fromkeys(names, 60_000)
    assert abs(found["id"].distinct_values - 60_000) < 60_000 * sketches.MOST_ERROR
    assert abs(found["few"].distinct_values - 777) < 777 * sketches.MOST_ERROR and found["none"].distinct_values == 0


RULES = [
    Rule(1, "null_rate", "t", "a", 0.1, None, "ods"), Rule(2, "volume_compare", "t", None, 10.0), Rule(3, "range_check", "t", None, 0.0, "b < 5"),
    Rule(4, "uniqueness", "t", "b", 0.9), Rule(5, "null_rate", "t", "missing", 0.1), Rule(6, "null_rate", "other", "a", 0.1),
    Rule(7, "null_rate", "t", "b", 0.0, enabled=False)]


def test_results_of_a_write_equal_those_of_a_check(spark, make, tmp_path):
    rows = make([(None, 1), (1, 2), (2, 9), (3, 9)], "a int, b int")
    at, path = "2024-03-01 00:00:00", str(tmp_path / "t")
    mine = [rule for rule in RULES if rule.target_table == "t"]
    found = op.write_checked(rows, path, RULES, "t", at=at)
    assert rows_of(found) == rows_of(op.quality_results(spark, mine, lambda name: rows, at=at))
    assert spark.read.parquet(path).count() == 4 and found.where("status = 'error'").count() == 1


def test_an_observed_write_reads_its_rows_once(spark, make, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = make([(i, i) for i in range(40)], "a int, b int").mapInArrow(counted, "a int, b int")
    found = op.write_checked(rows, str(tmp_path / "t"), RULES[:3], "t")
    assert {row.rule_id: row.actual for row in found.collect()} == {1: 0.0, 2: 40.0, 3: 35 / 40}
    assert reads.value == 40
