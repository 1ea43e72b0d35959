import os
import random
import threading

import pytest
from conftest import rows_of

from strata.operators import maintenance as op
from strata.sources.files import list_files


def parquet_files(path):
    return [os.path.join(base, name) for base, _, names in os.walk(path) for name in names
            if name.endswith(".parquet") and "/_" not in base]


def test_full_compaction_joins_small_files(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(1000).repartition(12).write.parquet(source)
    summary = op.compact(spark, source, output, "full", target_mb=16)
    assert summary == {"rows": 1000, "files_before": 12, "files_after": 1}
    assert rows_of(spark.read.parquet(output)) == rows_of(spark.range(1000)) and len(parquet_files(source)) == 12


def test_minor_compaction_rewrites_partitions_with_small_files(spark, tmp_path):
    path, output = str(tmp_path / "t"), str(tmp_path / "out")
    rows = spark.range(200_000).selectExpr("id", "uuid() AS u", "id % 3 AS part")
    rows.coalesce(1).write.option("path", path).partitionBy("part").saveAsTable("minor_check")
    spark.range(200_000, 200_100).selectExpr("id", "uuid() AS u", "1 AS part").repartition(5).write.mode("append").option(
        "path", path).partitionBy("part").saveAsTable("minor_check")
    expected = rows_of(spark.table("minor_check"), "id", "u", "part")
    kept = {f for f in parquet_files(path) if "part=1" not in f}
    summary = op.compact(spark, path, output, "minor", target_mb=1, partition_by=["part"])
    assert summary["rows"] < 200_100 and summary["files_before"] == 6
    assert op.switch_partitions(spark, "minor_check", output, ["part"]) == 1
    assert rows_of(spark.table("minor_check"), "id", "u", "part") == expected
    files = {"/" + f.split(":", 1)[-1].lstrip("/") for f in spark.table("minor_check").inputFiles()}
    assert kept <= files and all(f in kept or "/out/" in f for f in files)


def first_fit(sizes, target):
    rooms, packs = [], []
    for size in sorted(sizes, reverse=True):
        for i, room in enumerate(rooms):
            if room >= size:
                rooms[i] -= size
                packs[i].append(size)
                break
        else:
            rooms.append(target - size)
            packs.append([size])
    return sorted(sorted(pack) for pack in packs if len(pack) > 1)


@pytest.mark.parametrize("seed", range(3))
def test_file_groups_are_first_fit_by_length(make, seed):
    rng = random.Random(seed)
    files = [(f"file:///t/p={p}/f{i}", rng.choice([0, 1, 30, 49, 50, 51, 99, 100, 101, rng.randrange(1, 130)]))
             for p in range(3) for i in range(rng.randrange(1, 40))]
    got = {}
    for row in op.file_groups(make(files, "file_path string, file_size long"), 100).collect():
        got.setdefault(row.folder, {}).setdefault(row.pack, []).append(row.file_size)
    for p in range(3):
        folder = f"file:///t/p={p}"
        sizes = [size for path, size in files if path.startswith(f"{folder}/") and size < 100]
        assert sorted(sorted(pack) for pack in got.get(folder, {}).values()) == first_fit(sizes, 100)


def test_a_folder_of_very_many_files_is_dealt_to_several_tasks(make, monkeypatch):
    monkeypatch.setattr(op, "SHARE_FILES", 20)
    files = make([(f"file:///t/f{i}", 7) for i in range(400)], "file_path string, file_size long")
    packs = op.file_groups(files, 50).groupBy("pack").agg({"file_size": "sum", "file_path": "count"}).collect()
    assert 400 - 20 <= sum(row["count(file_path)"] for row in packs) <= 400
    assert all(row["sum(file_size)"] <= 50 for row in packs) and len(packs) <= 400 // 7 + 2 * 20


def test_only_small_files_are_rewritten(spark, tmp_path):
    path, output = str(tmp_path / "t"), str(tmp_path / "out")
    large = spark.range(400_000).selectExpr("id", "uuid() AS u", "concat('0', id % 2) AS part")
    large.coalesce(1).write.partitionBy("part").parquet(path)
    kept = set(parquet_files(path))
    more = spark.range(400_000, 400_060).selectExpr("id", "uuid() AS u", "'00' AS part")
    more.repartition(4).write.mode("append").partitionBy("part").parquet(path)
    spark.range(500_000, 500_010).selectExpr("id", "uuid() AS u", "id AS extra", "'a b' AS part").coalesce(1).write.mode(
        "append").partitionBy("part").parquet(path)
    small = set(parquet_files(path)) - kept
    read = spark.read.schema("id long, u string, extra long, part string").parquet(path)
    expected = rows_of(read, "id", "u", "extra", "part")
    assert rows_of(op.read_compacted(spark, path, output), "id", "u", "extra", "part") == expected
    summary = op.compact_files(spark, path, output, target_mb=1, partition_by=["part"])
    alone = [f for f in small if "part=00" not in f]  # one small file of its folder: nothing to join it with
    bytes_ = sum(os.path.getsize(f) for f in small if f not in alone)
    assert summary == {"rows": 60, "files_before": 4, "bytes_before": bytes_, "files_after": 1} and len(alone) == 1
    assert rows_of(op.read_compacted(spark, path, output), "id", "u", "extra", "part") == expected
    replaced = spark.read.parquet(f"{output}/replaced")
    assert op.delete_files(replaced, "file_path", confirm=True) == 4 and kept <= set(parquet_files(path))
    assert rows_of(op.read_compacted(spark, path, output), "id", "u", "extra", "part") == expected


def test_rows_of_large_files_are_not_read(spark, tmp_path):
    path, output = str(tmp_path / "t"), str(tmp_path / "out")
    spark.range(200_000).selectExpr("id", "uuid() AS u").coalesce(1).write.parquet(path)
    with open(parquet_files(path)[0], "r+b") as large:  # the footer stays readable
        large.seek(4)
        large.write(b"\xff" * 100_000)
    spark.range(20).selectExpr("id", "uuid() AS u").repartition(3).write.mode("append").parquet(path)
    with pytest.raises(Exception):
        spark.read.parquet(path).agg({"id": "max", "u": "max"}).collect()
    assert op.compact_files(spark, path, output, target_mb=1)["rows"] == 20


def test_nothing_small_to_rewrite(spark, tmp_path):
    path, output = str(tmp_path / "t"), str(tmp_path / "out")
    spark.range(10).coalesce(1).write.parquet(path)
    assert op.compact_files(spark, path, output) == {"rows": 0, "files_before": 0, "bytes_before": 0, "files_after": 0}
    assert rows_of(op.read_compacted(spark, path, output)) == rows_of(spark.range(10))


def test_compaction_keeps_new_columns_and_partition_values(spark, make, tmp_path):
    path, output = str(tmp_path / "t"), str(tmp_path / "out")
    make([(1, "007"), (2, "7")], "id int, code string").write.partitionBy("code").parquet(path)
    make([(3, 5, "012")], "id int, v int, code string").write.mode("append").partitionBy("code").parquet(path)
    assert op.compact(spark, path, output, "full", partition_by=["code"])["rows"] == 3
    got = spark.read.schema("id int, v int, code string").parquet(output)
    assert rows_of(got) == [(1, None, "007"), (2, None, "7"), (3, 5, "012")]


def test_orphans_of_a_running_job_are_left_alone(make):
    listing = make([("a", "2024-01-01 00:00:00"), ("b", "2024-01-03 00:00:00"), ("c", "2024-01-01 00:00:00")], "path string, t string")
    listing = listing.selectExpr("path", "CAST(t AS timestamp) AS modificationTime")
    used = make([("c",)], "path string")
    assert rows_of(op.orphan_files(listing, used, before="2024-01-02 00:00:00"), "path") == [("a",)]
    assert rows_of(op.orphan_files(listing, used), "path") == [("a",), ("b",)]


def test_switch_of_a_catalog_table(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    spark.range(50).repartition(5).write.option("path", old).mode("overwrite").saveAsTable("switched")
    op.compact(spark, old, new, "full")
    op.switch_table(spark, "switched", new)
    assert spark.table("switched").count() == 50 and all("/new/" in f for f in spark.table("switched").inputFiles())


def test_unknown_strategy_and_existing_output(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        op.compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), "major")
    with pytest.raises(Exception):
        op.compact(spark, str(tmp_path / "in"), str(tmp_path / "in"), "full")


def test_retention(make):
    rows = [(1, i, f"2024-01-{i:02} 00:00:00") for i in range(1, 16)] + [(2, 3, "2023-01-01 00:00:00")]
    snaps = make(rows, "table_id int, snapshot_id bigint, t string").selectExpr(
        "table_id", "snapshot_id", "CAST(t AS timestamp_ntz) AS commit_time")
    assert rows_of(op.snapshots_to_expire(snaps), "table_id", "snapshot_id") == [(1, i) for i in range(1, 6)]
    assert rows_of(op.snapshots_to_expire(snaps, 1, "2024-01-10 00:00:00", 7), "snapshot_id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        op.snapshots_to_expire(snaps, 0)


def test_orphans_are_reported_and_only_deleted_on_request(spark, tmp_path, make):
    for name in ("data-1", "data-2", "data-3"):
        (tmp_path / name).write_text("x")
    listing = list_files(spark, str(tmp_path))
    referenced = listing.where("path LIKE '%data-1'").select("path")
    orphans = op.orphan_files(listing, referenced)
    assert sorted(os.path.basename(row.path) for row in orphans.collect()) == ["data-2", "data-3"]
    with pytest.raises(ValueError):
        op.delete_files(orphans)
    assert op.delete_files(orphans, confirm=True) == 2
    assert [name for name in os.listdir(tmp_path) if not name.startswith(".")] == ["data-1"]


def test_candidates_skip_unknown_counts(make):
    tables = make([(1, "ods", None), (2, "ods", 199), (3, "ods", 200), (4, "dwd", 900)], "id int, layer string, file_count int")
    assert rows_of(op.compaction_candidates(tables), "id") == [(3,), (4,)]
    assert rows_of(op.compaction_candidates(tables, "ods", 0), "id") == [(2,), (3,)]


def test_log_covers_tables_that_came_or_went(make):
    schema = "table_path string, file_count bigint, total_size_bytes bigint"
    log = op.maintenance_log(make([("a", 9, 90), ("b", 1, 10)], schema), make([("a", 2, 80), ("c", 1, 5)], schema), "compact", duration_ms=5)
    assert rows_of(log, "table_path", "file_count_before", "file_count_after", "total_size_bytes_after") == [
        ("a", 9, 2, 80), ("b", 1, None, None), ("c", None, 1, 5)]


def test_log_rows_can_be_searched(make):
    schema = "table_path string, file_count bigint, total_size_bytes bigint"
    before, after = make([("a", 9, 90), ("b", 4, 10)], schema), make([("a", 2, 80), ("b", 1, 9)], schema)
    tables = make([(7, "a"), (8, "b")], "id int, table_path string")
    log = op.maintenance_log(before, after, "compact", tables=tables, created_at="2024-01-01 10:00:00").unionByName(
        op.maintenance_log(before, after, "compact", tables=tables, created_at="2024-01-02 10:00:00"))
    found = op.search_log(log, operation="compact", status="success", table_id=7).collect()
    assert [(row["created_at"].day, row["table_path"], row["file_count_after"]) for row in found] == [(2, "a", 2), (1, "a", 2)]
    assert log.select("id").distinct().count() == 4


def test_batch_goes_on_after_a_failure(spark, make, tmp_path):
    tables = make([(1, "ods", "a"), (2, "ods", "missing"), (3, "ods", "c")], "id bigint, db string, table_name string")
    for name in ("a", "c"):
        spark.range(30).repartition(6).write.parquet(str(tmp_path / name))

    def work(table):
        op.compact(spark, str(tmp_path / table.table_name), str(tmp_path / f"{table.table_name}-new"), "full")

    results = op.run_batch(tables, work, "compact")
    assert rows_of(results, "table", "status") == [("ods.a", "success"), ("ods.c", "success"), ("ods.missing", "failed")]
    assert rows_of(op.maintenance_report(results)) == [("compact", 2, 1)]
    assert [row.table_id for row in op.maintenance_failures(results).collect()] == [2]
    assert len(parquet_files(str(tmp_path / "a-new"))) == 1


def test_batch_runs_operations_side_by_side_in_order(make):
    tables = make([(number, "ods", f"t{number}") for number in range(8)], "id bigint, db string, table_name string")
    meeting = threading.Barrier(4, timeout=60)
    results = op.run_batch(tables.orderBy("id"), lambda table: meeting.wait(), "expire", at_once=4)
    assert [(row.table_id, row.status) for row in results.collect()] == [(number, "success") for number in range(8)]


def test_overview_counts_unknown_files_and_missing_snapshots_as_none(make):
    tables = make([(1, "ods", 200), (2, "ods", 201), (3, "dwd", None), (4, None, 900)], "id bigint, layer string, file_count bigint")
    snapshots = make([(1, i) for i in range(10)] + [(3, i) for i in range(11)] + [(9, i) for i in range(20)],
                     "table_id bigint, snapshot_id bigint")
    assert rows_of(op.maintenance_overview(tables, snapshots)) == [(2, 2, 1)]
    assert rows_of(op.maintenance_overview(tables.limit(0), snapshots)) == [(0, 0, 0)]
