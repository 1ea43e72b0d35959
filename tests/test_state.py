"""Kept state that splits, change tables read as state and tail, aggregates kept by retraction."""

import glob
import os
import random

import pytest
from conftest import rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strata.operators import changes as op
from strata.operators import retract, state
from strata.plans import suite
from strata.streaming import ingest, tables

SCHEMA = "id int, v string, op string, seq bigint"


@pytest.mark.parametrize("base,parts", [(1, 7), (3, 3), (3, 11), (8, 64), (5, 39)])
def test_addresses_are_those_of_linear_hashing(spark, base, parts):
    rows = spark.range(2000).select("id", *[state.address(["id"], base, n).alias(f"a{n}") for n in range(base, parts + 1)]).collect()
    for row in rows:
        assert all(0 <= row[f"a{n}"] < n for n in range(base, parts + 1))
        for n in range(base, parts):
            origin = state._origin(base, n, n)
            assert row[f"a{n + 1}"] == row[f"a{n}"] or (row[f"a{n + 1}"] == n and row[f"a{n}"] == origin)


def test_a_kept_state_equals_the_fold_of_all_changes(spark, make, tmp_path):
    path = str(tmp_path / "state")
    rows = [(1, "a", "c", 1), (2, "b", "c", 2), (1, "a2", "u", 5), (2, None, "d", 6), (3, "c", "c", 7), (1, "old", "u", 3), (2, "late", "u", 4)]
    for part in (rows[:2], rows[2:5], rows[5:], rows[:3]):
        state.apply_to_state(path, make(part, SCHEMA), ["id"], parts=4)
    assert rows_of(state.read_state(spark, path), "id", "v") == [(1, "a2"), (3, "c")]


def test_only_touched_parts_of_a_state_are_rewritten(spark, make, tmp_path):
    path = str(tmp_path / "state")
    state.apply_to_state(path, make([(i, "a", "c", i) for i in range(50)], SCHEMA), ["id"], parts=8)
    before = set(glob.glob(f"{path}/_part=*/*.parquet"))
    state.apply_to_state(path, make([(7, "b", "u", 99)], SCHEMA), ["id"])
    after = set(glob.glob(f"{path}/_part=*/*.parquet"))
    assert len({os.path.dirname(name) for name in before ^ after}) == 1
    assert state.read_state(spark, path).count() == 50


def test_a_grown_state_has_no_lost_or_doubled_key(spark, make, tmp_path):
    path, held, pick = str(tmp_path / "state"), {}, random.Random(7)
    seq = 0
    for parts in (None, 9, 13, 64):
        if parts:
            split = state.grow_state(spark, path, parts)
            assert len(split) <= parts and state.read_layout(spark, path).parts == parts
        rows = []
        for _ in range(80):
            seq += 1
            key, kind = pick.randrange(120), pick.choice("cud")
            rows.append((key, f"v{seq}", kind, seq))
            held[key] = None if kind == "d" else f"v{seq}"
        state.apply_to_state(path, make(rows, SCHEMA), ["id"], parts=None if parts else 8)
        assert rows_of(state.read_state(spark, path), "id", "v") == sorted(((k, v) for k, v in held.items() if v), key=repr)
    assert state.grow_state(spark, path, 64) == []


def test_growing_leaves_other_parts_alone_and_survives_a_break(spark, make, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    state.apply_to_state(path, make([(i, "a", "c", i) for i in range(400)], SCHEMA), ["id"], parts=8)
    before = set(glob.glob(f"{path}/_part=*/*.parquet"))
    expected = rows_of(state.read_state(spark, path), "id", "v")
    # ends after the copies have been written, and then after the layout has changed
    for broken in ("put_layout", "written"):
        with monkeypatch.context() as patch:
            patch.setattr(state, broken, lambda *args: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                state.grow_state(spark, path, 10)
        assert rows_of(state.read_state(spark, path), "id", "v") == expected
    assert state.read_layout(spark, path).parts == 10
    untouched = {name for name in before if name.split("_part=")[1].split("/")[0] not in "01"}
    assert untouched <= set(glob.glob(f"{path}/_part=*/*.parquet"))


def test_other_numbers_keys_and_folders_are_refused(spark, make, tmp_path):
    path, rows = str(tmp_path / "state"), make([(i, "a", "c", i) for i in range(20)], SCHEMA)
    state.apply_to_state(path, rows, ["id"], parts=8)
    with pytest.raises(ValueError, match="8 partitions, not 5"):
        state.apply_to_state(path, rows, ["id"], parts=5)
    with pytest.raises(ValueError, match="the key"):
        state.apply_to_state(path, rows, ["v"])
    with pytest.raises(ValueError, match="already"):
        state.grow_state(spark, path, 7)
    assert state.read_state(spark, path).count() == 20
    rows.write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no state"):
        state.apply_to_state(str(tmp_path / "other"), rows, ["id"])


def test_a_state_grows_by_its_rows_and_takes_a_batch_once(spark, make, tmp_path):
    path = str(tmp_path / "state")
    state.apply_to_state(path, make([(i, "a", "c", i) for i in range(100)], SCHEMA), ["id"], parts=2, batch=4, rows_per_part=10)
    assert state.read_layout(spark, path).parts == 10 and state.read_layout(spark, path).applied == 4
    state.apply_to_state(path, make([(1, "again", "u", 1000)], SCHEMA), ["id"], batch=4)
    assert "again" not in {row.v for row in state.read_state(spark, path).collect()}


def test_a_read_takes_the_state_and_only_the_batches_after_it(spark, make, tmp_path):
    base, pick, seen = str(tmp_path), random.Random(3), []
    for number in range(5):
        rows = [(pick.randrange(30), f"v{number}-{i}", pick.choice("cuud"), number * 100 + i) for i in range(40)]
        seen += rows
        make(rows, SCHEMA).write.mode("append").parquet(f"{base}/in")
        stream = ingest.stream_files(spark, f"{base}/in", make([], SCHEMA).schema)
        ingest.run_to_end(tables.ingest_batches(stream, f"{base}/t", f"{base}/c", once=True))
        expected = rows_of(op.fold_changes(make(seen, SCHEMA), ["id"]), "id", "v")
        assert rows_of(tables.read_table(spark, f"{base}/t", ["id"]), "id", "v") == expected
        if number == 2:
            assert tables.tail_rows(spark, f"{base}/t") == 120
            assert tables.fold_tail(spark, f"{base}/t", ["id"], parts=4) == 2
            assert rows_of(tables.read_table(spark, f"{base}/t", ["id"]), "id", "v") == expected
            assert tables.read_tail(spark, f"{base}/t") is None
    assert tables.batches(spark, f"{base}/t") == [3, 4]
    files = tables.read_table(spark, f"{base}/t", ["id"]).inputFiles()
    assert {name.split("/t/log/")[1].split("/")[0] for name in tables.read_tail(spark, f"{base}/t").inputFiles()} == {"_batch=3", "_batch=4"}
    assert all("/t/state/" in name or "changes" in name for name in files)
    assert tables.fold_tail(spark, f"{base}/t", ["id"]) == 4 and tables.batches(spark, f"{base}/t") == []
    assert rows_of(tables.read_table(spark, f"{base}/t", ["id"]), "id", "v") == expected
    with pytest.raises(ValueError, match="checkpoint"):
        tables.ingest_batches(ingest.stream_files(spark, f"{base}/in", make([], SCHEMA).schema), f"{base}/t", f"{base}/new", once=True)


def test_a_batch_written_twice_counts_once(spark, make, tmp_path):
    path = str(tmp_path)
    for _ in range(2):  # the second writing is that of a restarted batch
        make([(1, "a", "c", 1)], SCHEMA).write.mode("overwrite").parquet(f"{path}/log/_batch=0")
    os.makedirs(f"{path}/log/_batch=1")  # a batch that was not finished
    tables.fold_tail(spark, path, ["id"], parts=2)
    make([(1, "b", "u", 2)], SCHEMA).write.parquet(f"{path}/log/_batch=0")  # folded before its folder went
    assert rows_of(tables.read_table(spark, path, ["id"]), "id", "v") == [(1, "a")]


DAY = "id int, day string, part string, amount double"


def _recomputed(table, make):
    return rows_of(make(table, DAY).groupBy("day", "part").agg(
        F.count("*").alias("rows"), F.sum(F.col("amount").cast("decimal(20,2)")).cast("decimal(38,2)").alias("total"),
        F.min("amount").alias("low"), F.max("amount").alias("high")), "day", "part", "rows", "total", "low", "high")


def test_an_aggregate_is_kept_through_updates_and_deletes(spark, make, tmp_path):
    path, pick, table = str(tmp_path / "kept"), random.Random(9), {}
    for _ in range(4):
        before = [(k, *v) for k, v in table.items()]
        for _ in range(40):
            key = pick.randrange(25)
            if pick.random() < 0.35:
                table.pop(key, None)
            else:
                table[key] = (pick.choice(["d1", "d2", "d3", None]), pick.choice("xy"), pick.choice([None, 1.25, -3.5, 99.99, 0.1]))
        after = [(k, *v) for k, v in table.items()]
        kinds = op.row_kinds(make(before, DAY), make(after, DAY), ["id"])
        retract.refresh(path, retract.signed(kinds, ["day", "part"], "amount"), ["day", "part"], 2)
        kept = retract.read_refreshed(spark, path)
        assert rows_of(kept, "day", "part", "rows", "total", "low", "high") == _recomputed(after, make)


def test_only_touched_days_are_rewritten_and_lost_ones_go(spark, make, tmp_path):
    path = str(tmp_path / "kept")
    table = [(i, f"d{i % 5}", "x", float(i)) for i in range(50)]

    def apply(before, after):
        kinds = op.row_kinds(make(before, DAY), make(after, DAY), ["id"])
        retract.refresh(path, retract.signed(kinds, ["day"], "amount"), ["day"], 2)

    apply([], table)
    files = set(glob.glob(f"{path}/*/day=*/*.parquet"))
    apply(table, [row for row in table if row[1] != "d3"])
    changed = {os.path.basename(os.path.dirname(name)) for name in files ^ set(glob.glob(f"{path}/*/day=*/*.parquet"))}
    assert changed == {"day=d3"}
    assert sorted(row.day for row in retract.read_refreshed(spark, path).collect()) == ["d0", "d1", "d2", "d4"]


def test_rows_that_never_came_cannot_be_taken_back(spark, make, tmp_path):
    kinds = make([("d1", 5.0, "-D")], "day string, amount double, row_kind string")
    with pytest.raises(PySparkException, match="never came"):
        retract.refresh(str(tmp_path / "kept"), retract.signed(kinds, ["day"], "amount"), ["day"], 2)


def test_an_aggregate_may_begin_without_rows(spark, make, tmp_path):
    path, group = str(tmp_path / "kept"), "day string, amount double, row_kind string"
    retract.refresh(path, retract.signed(make([], group), ["day"], "amount"), ["day"], 2)
    assert retract.read_refreshed(spark, path).collect() == []
    retract.refresh(path, retract.signed(make([("007", 5.0, "+I"), ("7", 1.5, "+I"), (None, 2.0, "+I")], group), ["day"], "amount"), ["day"], 2)
    retract.refresh(path, retract.signed(make([("007", 5.0, "-U"), ("007", 4.0, "+U")], group), ["day"], "amount"), ["day"], 2)
    assert rows_of(retract.read_refreshed(spark, path), "day", "rows", "low") == [("007", 1, 4.0), ("7", 1, 1.5), (None, 1, 2.0)]


@pytest.mark.parametrize("first", [-3, 0, 500])  # the lowest change number; at 500 the first half has no changes
def test_the_kept_days_of_the_query_follow_from_an_empty_table(spark, make, tmp_path, first):
    kinds = ["view", "signup", "click", "purchase", "error", "view", "view", "click"]
    rows = [(first + i, f"2024-01-0{1 + i // 3} 10:00:00", i % 3, kind, 1.25 * i, "") for i, kind in enumerate(kinds)]
    make(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    kept = suite.QUERIES["refresh"](spark, str(tmp_path)).select(F.col("day").cast("string"), "rows", "total_units", "low", "high")
    assert rows_of(kept) == [("2024-01-02", 1, 62500, 6.25, 6.25), ("2024-01-03", 2, 162500, 7.5, 8.75)]


def test_a_job_goes_on_from_a_savepoint(spark, make, tmp_path):
    base, pick = str(tmp_path), random.Random(8)
    schema, seen = make([], SCHEMA).schema, []

    def deliver(number):
        rows = [(pick.randrange(30), f"v{number}-{i}", pick.choice("cuud"), number * 100 + i) for i in range(40)]
        seen.extend(rows)
        make(rows, SCHEMA).write.mode("append").parquet(f"{base}/in")

    def run(name):
        ingest.run_to_end(tables.ingest_batches(ingest.stream_files(spark, f"{base}/in", schema), f"{base}/{name}", f"{base}/{name}-c", once=True))

    def current(name):
        return rows_of(tables.read_table(spark, f"{base}/{name}", ["id"]), "id", "v")

    def expected():
        return rows_of(op.fold_changes(make(seen, SCHEMA), ["id"]), "id", "v")

    deliver(0)
    run("a")
    tables.fold_tail(spark, f"{base}/a", ["id"], parts=4)
    deliver(1)
    run("a")
    assert tables.savepoint(spark, f"{base}/a", f"{base}/a-c", f"{base}/kept") == 1
    at_savepoint = expected()
    deliver(2)
    run("a")
    tables.fold_tail(spark, f"{base}/a", ["id"])
    tables.restore(spark, f"{base}/kept", f"{base}/b", f"{base}/b-c")
    assert current("b") == at_savepoint and tables.batches(spark, f"{base}/b") == [1]
    run("b")
    assert current("b") == current("a") == expected()
    assert spark.read.parquet(f"{base}/b/log").groupBy("seq").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError, match="exists"):
        tables.savepoint(spark, f"{base}/a", f"{base}/a-c", f"{base}/kept")
    with pytest.raises(ValueError, match="exists"):
        tables.restore(spark, f"{base}/kept", f"{base}/b", f"{base}/other")


def test_a_batch_that_was_not_committed_is_no_part_of_a_savepoint(spark, make, tmp_path):
    base = str(tmp_path)
    make([(1, "a", "c", 1)], SCHEMA).write.parquet(f"{base}/in")
    ingest.run_to_end(tables.ingest_batches(ingest.stream_files(spark, f"{base}/in", make([], SCHEMA).schema), f"{base}/t", f"{base}/c", once=True))
    make([(2, "b", "c", 2)], SCHEMA).write.parquet(f"{base}/t/log/_batch=1")  # written, then the job died
    with open(f"{base}/c/offsets/1", "w") as file:
        file.write("begun")
    assert tables.savepoint(spark, f"{base}/t", f"{base}/c", f"{base}/kept") == 0
    assert os.listdir(f"{base}/kept/table/log") == ["_batch=0"] and "1" not in os.listdir(f"{base}/kept/checkpoint/offsets")
