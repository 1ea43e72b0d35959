import datetime as dt

from conftest import rows_of
from pyspark.sql import functions as F

from strata.operators.changes import fold_changes
from strata.streaming import ingest, materialize, metrics

CHANGE = "id int, v string, seq bigint, op string"


def test_stop_and_resume_gives_every_row_once(spark, make, tmp_path):
    source, log, checkpoint = (str(tmp_path / name) for name in ("in", "log", "cp"))
    def feed(rows):
        make(rows, CHANGE).coalesce(1).write.mode("append").parquet(source)
    def run():
        stream = ingest.stream_files(spark, source, CHANGE, files_per_batch=1)
        ingest.run_to_end(ingest.resume_stream(stream, log, checkpoint, once=True))

    feed([(1, "a", 1, "c"), (2, "b", 2, "c")])
    run()
    run()
    assert spark.read.parquet(log).count() == 2
    feed([(1, None, 3, "d")])
    feed([(2, "bb", 4, "u")])
    run()
    assert rows_of(spark.read.parquet(log), "seq") == [(1,), (2,), (3,), (4,)]
    assert rows_of(ingest.read_current(spark, log, ["id"]), "id", "v") == [(2, "bb")]


def test_fold_runs_on_a_stream(spark, make, tmp_path):
    rows = [(i % 3, f"v{i}", i, "d" if i == 8 else "u") for i in range(9)]
    make(rows, CHANGE).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_files(spark, str(tmp_path / "in"), CHANGE, files_per_batch=1)
    fold_changes(stream, ["id"], keep_deletes=True).writeStream.format("memory").queryName("folded").outputMode(
        "complete").trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.table("folded")) == rows_of(fold_changes(make(rows, CHANGE), ["id"], keep_deletes=True))


def test_windows_close_once_and_late_rows_stay_out(spark, make, tmp_path):
    source, table, checkpoint = (str(tmp_path / name) for name in ("in", "table", "cp"))
    def feed(*times):
        make([(dt.datetime(2024, 1, *t),) for t in times], "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(source)
    def run():
        stream = ingest.stream_files(spark, source, "ts timestamp_ntz", files_per_batch=1)
        ingest.run_to_end(materialize.materialize_stream(stream, materialize.windowed_counts, "ts", "1 hour", table, checkpoint, once=True))
        return rows_of(spark.read.parquet(table)) if (tmp_path / "table").exists() else []

    feed((1, 5), (1, 9), (2, 0, 30))
    assert run() == []
    feed((1, 20), (3, 4))
    assert run() == [(dt.datetime(2024, 1, 1), 3), (dt.datetime(2024, 1, 2), 1)]
    feed((1, 7), (5, 0))
    assert run() == [(dt.datetime(2024, 1, 1), 3), (dt.datetime(2024, 1, 2), 1), (dt.datetime(2024, 1, 3), 1)]


def test_full_refresh_replaces(spark, make, tmp_path):
    path = str(tmp_path / "t")
    materialize.materialize(spark, "SELECT 1 AS a UNION ALL SELECT 2", path)
    assert rows_of(materialize.materialize(spark, "SELECT 3 AS a", path)) == [(3,)]


def test_throughput_counts_a_row_per_stage(make):
    t = dt.datetime(2024, 1, 1, 10, 59, 59)
    df = make([(t, "read"), (t, "write"), (t + dt.timedelta(seconds=1), "read")], "ts timestamp_ntz, stage string")
    assert rows_of(metrics.throughput(df, "ts", "1 hour"), "rows", "rows_per_second") == [(1, 1 / 3600), (2, 2 / 3600)]
    assert metrics.throughput(df, "ts", "1 hour", ["stage"]).count() == 3


def test_throughput_of_a_stream(spark, make, tmp_path):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i),) for i in range(60)]
    make(rows, "ts timestamp_ntz").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = metrics.as_event_time(ingest.stream_files(spark, str(tmp_path / "in"), "ts timestamp_ntz"), "ts", "1 hour")
    metrics.throughput(stream, "ts").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(
        availableNow=True).start().awaitTermination()
    batch = metrics.throughput(make(rows, "ts timestamp_ntz"), "ts")
    assert rows_of(spark.table("rates"), "rows", "rows_per_second") == rows_of(batch, "rows", "rows_per_second")


def test_lag_of_the_newest_fetch(make):
    t = dt.datetime(2024, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    df = make([("a", s(0), s(9)), ("a", s(10), s(12)), ("b", s(5), s(4))], "source string, e timestamp_ntz, f timestamp_ntz")
    assert rows_of(metrics.lag_by_source(df, "source", "e", "f")) == [("a", 2000, 9000), ("b", -1000, -1000)]
    assert metrics.lag_by_source(df.where(F.lit(False)), "source", "e", "f").count() == 0


POLLS = "task_id bigint, seq bigint, job_state string, job_id string, at_time timestamp_ntz"


def test_submissions_fail_when_their_minutes_end(spark, make, tmp_path):
    import datetime

    from strata.operators.monitor import failed_submissions
    from strata.streaming.status import failed_submission_stream
    at = lambda minute: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)
    first = [(1, 1, "CREATED", None, at(0)), (1, 2, "RUNNING", "j1", at(5)), (2, 3, "CREATED", None, at(1)), (3, 4, "CREATED", None, at(2)),
             (2, 5, "RUNNING", "j2", at(7)), (4, 6, "RUNNING", None, at(2)), (5, 7, "CREATED", "j5", at(3))]
    later = [(3, 8, "CREATED", None, at(9)), (6, 9, "CREATED", None, at(30))]
    base, found = str(tmp_path), []
    for rows in (first, later, [(9, 10, "RUNNING", "j", at(200))]):
        make(rows, POLLS).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(make([], POLLS).schema).parquet(f"{base}/in")
        query = failed_submission_stream(stream, f"{base}/out", f"{base}/c", once=True)
        query.awaitTermination()
        assert query.exception() is None
        found.append(sorted(row.seq for row in spark.read.parquet(f"{base}/out").collect()))
    # After the second delivery the watermark stands at 29 minutes: no poll of task 2 or 3 was needed for that.
    assert found[1:] == [[3, 4, 8], [3, 4, 8, 9]]
    batch = failed_submissions(make(first + later, POLLS))
    assert sorted(row.seq for row in batch.collect()) == [3, 4, 8, 9]
    assert {row.seq: row.failed_at for row in batch.collect()}[3] == at(6)


def test_folded_status_files_give_the_same_status(spark, make, tmp_path):
    import pytest

    from strata.streaming.status import fold_status, read_status, task_status_stream
    base = str(tmp_path)
    for number in range(5):
        rows = [(task, number * 10 + task, "RUNNING" if (task + number) % 3 else "FAILED", None, None) for task in range(number, 6)]
        make(rows, POLLS).selectExpr("*", "seq AS lag_ms").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
        query = task_status_stream(stream, f"{base}/out", f"{base}/c", once=True)
        query.awaitTermination()
        assert query.exception() is None
    before = sorted(tuple(row) for row in read_status(spark, f"{base}/out").collect())
    folders = spark.read.parquet(f"{base}/out").select("_batch").distinct().count()
    assert fold_status(spark, f"{base}/out") == folders - 2 > 0
    assert sorted(tuple(row) for row in read_status(spark, f"{base}/out").collect()) == before
    assert spark.read.parquet(f"{base}/out").select("_batch").distinct().count() == 2 and fold_status(spark, f"{base}/out") == 0
    with pytest.raises(ValueError, match="missing"):
        task_status_stream(stream, f"{base}/out", f"{base}/other", once=True)
