import datetime as dt
import random

import pytest
from conftest import rows_of

from strata.functions.states import TRANSITIONS, map_job_state, transition_allowed
from strata.operators import monitor as op
from strata.streaming.status import alert_stream, read_status, task_status_stream

LOG = "task_id int, seq bigint, job_state string, lag_ms bigint, at_time timestamp_ntz"
T = dt.datetime(2024, 1, 1)


def test_job_states(make):
    names = ["RUNNING", "CANCELED", "FAILED", "FINISHED", "CREATED", "RESTARTING", "SUSPENDED", "Failing", "FAILING", None]
    out = make([(n,) for n in names], "s string").select(map_job_state("s")).collect()
    assert [row[0] for row in out] == [
        "running", "finished", "failed", "finished", "submitting", "running", "paused", "failed", "failing", None]


def test_transition_table(make):
    states = list(TRANSITIONS)
    pairs = make([(a, b) for a in states for b in states], "a string, b string")
    from pyspark.sql import functions as F
    allowed = {(r.a, r.b) for r in pairs.where(transition_allowed(F.col("a"), F.col("b"))).collect()}
    assert allowed == {(a, b) for a, targets in TRANSITIONS.items() for b in targets}


@pytest.mark.parametrize("kind,of", [
    ("bigint", lambda seq: seq), ("bigint", lambda seq: seq * 10 ** 7), ("string", lambda seq: f"{seq:04d}"),
    ("timestamp_ntz", lambda seq: T + dt.timedelta(seconds=seq)), ("bigint", lambda seq: seq or None)])
def test_previous_value_equals_plain_order_for_any_sequence(make, kind, of):
    rng = random.Random(5)
    seqs = {key: rng.sample(range(500), n) for key, n in ((1, 150), (None, 30), (2, 15), (3, 1))}
    seqs[1][0] = 0
    rows = [(key, seq, rng.choice([None, "a", "b"])) for key, own in seqs.items() for seq in own]
    last, expected = {}, []
    for key, seq, value in sorted(rows, key=lambda row: row[1]):
        expected.append((key, of(seq), value, last.get(key)))
        last[key] = value
    df = make([(key, of(seq), value) for key, seq, value in rows], f"k int, seq {kind}, v string")
    for parts in (1, 3, 40, None):
        assert rows_of(op.previous_value(df, ["k"], "seq", "v", "p", parts)) == sorted(expected, key=repr)


def test_invalid_moves(make):
    log = make([(1, 1, "CREATED", 0, T), (1, 2, "RUNNING", 0, T), (1, 3, "RESTARTING", 0, T), (1, 4, "FINISHED", 0, T),
                (1, 5, "RUNNING", 0, T), (2, 1, "CREATED", 0, T), (2, 2, None, 0, T), (2, 3, "FINISHED", 0, T)], LOG)
    assert rows_of(op.invalid_transitions(log, parts=6), "task_id", "seq", "from_status", "to_status") == [
        (1, 5, "finished", "running"), (2, 3, "submitting", "finished")]


def test_task_status_keeps_lag_of_the_last_running_poll(make):
    log = make([(1, 1, "RUNNING", 10, T), (1, 2, "FAILED", 99, T), (2, 1, "CREATED", 5, T)], LOG)
    assert rows_of(op.task_status(log), "task_id", "status", "lag_ms", "polls", "failures") == [
        (1, "failed", 10, 2, 1), (2, "submitting", None, 1, 0)]


def test_task_status_has_throughput_and_checkpoints_of_the_last_running_poll(make):
    rows = [(1, 1, "RUNNING", 10, T, 2.5, 3), (1, 2, "RUNNING", 11, T, 4.5, 4), (1, 3, "FAILED", 99, T, 0.0, 0), (2, 1, "CREATED", 5, T, 1.0, 1)]
    log = make(rows, LOG + ", throughput double, checkpoint_count bigint")
    assert rows_of(op.task_status(log), "task_id", "status", "lag_ms", "throughput", "checkpoint_count") == [
        (1, "failed", 11, 4.5, 4), (2, "submitting", None, None, None)]


def test_stuck_submissions(make):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "submitting", None, now - dt.timedelta(minutes=6)), (2, "submitting", None, now - dt.timedelta(minutes=5)),
            (3, "submitting", "j", now - dt.timedelta(hours=1)), (4, "running", None, now - dt.timedelta(hours=1)),
            (5, "submitting", None, None)]
    tasks = make(rows, "id int, status string, job_id string, submitted_at timestamp_ntz")
    assert rows_of(op.stuck_submissions(tasks, "2024-01-01 12:00:00"), "id", "status") == [(1, "failed")]


def test_checkpoint_metrics_without_numbers(make):
    df = make([("{}",), (None,), ('{"counts":{"completed":3},"latest":{"completed":{"latest_ack_timestamp":1000,"state_size":8}}}',)], "b string")
    assert rows_of(op.checkpoint_metrics(df, "b")) == [(0, None, 0), (0, None, 0), (3, dt.datetime(1970, 1, 1, 0, 0, 1), 8)]


def test_alert_rules_limits(make):
    rules = make([(1, "data_delay", "5000ms", True), (2, "data_delay", "", True), (3, "data_delay", None, True), (4, "data_delay", "1", False)],
                 "rule_id int, rule_type string, expression string, enabled boolean")
    metrics = make([("data_delay", "t", 4000.0), ("data_delay", "u", 0.0), ("other", "v", 9.0)], "rule_type string, subject string, value double")
    assert rows_of(op.evaluate_alert_rules(rules, metrics), "rule_id", "subject") == [(2, "t"), (3, "t")]


def test_routing_splits_channels(make):
    alerts = make([(1, "x"), (2, "y"), (3, "z")], "rule_id int, subject string")
    rules = make([(1, "email, WeCom"), (2, "")], "rule_id int, channels string")
    assert rows_of(op.route_alerts(alerts, rules), "subject", "channel") == [("x", "email"), ("x", "wecom")]


def test_health_of_missing_components(make):
    rows = [(1, "db", "healthy"), (1, "engine", "healthy"), (1, "store", "healthy"), (2, "db", "healthy"), (2, "engine", "healthy"),
            (3, "engine", "healthy"), (3, "store", "healthy"), (4, "db", "unknown")]
    df = make(rows, "check_id int, component string, status string")
    assert rows_of(op.overall_health(df, "db", ["engine", "store"])) == [
        (1, "healthy"), (2, "degraded"), (3, "unhealthy"), (4, "unhealthy")]


def test_merged_component_changes_the_overall_status(make):
    schema = "component string, status string, checked_at timestamp_ntz, seq bigint"
    latest = make([("db", "healthy", T, 1), ("engine", "healthy", T, 1), ("store", "down", T, 1)], schema)
    merged = op.merge_component(latest, make([("store", "healthy", T, 2)], schema), "db", ["engine", "store"])
    assert rows_of(merged, "component", "status", "overall") == [
        ("db", "healthy", "healthy"), ("engine", "healthy", "healthy"), ("store", "healthy", "healthy")]


def test_streamed_status_and_alerts_equal_batch(spark, make, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(5), seq, rng.choice(["RUNNING", "FAILED", "CREATED"]), rng.randrange(400), T) for seq in range(200)]
    log = make(rows, LOG)
    log.repartition(3).write.parquet(str(tmp_path / "polls"))
    polls = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "polls"))
    where = str(tmp_path / "status"), str(tmp_path / "progress")
    task_status_stream(polls, *where, once=True).awaitTermination()
    assert rows_of(read_status(spark, where[0])) == rows_of(op.task_status(log))

    rules = make([(1, "task_failure", "0", True), (2, "data_delay", "150ms", True)],
                 "rule_id int, rule_type string, expression string, enabled boolean")
    alert_stream(polls, rules).writeStream.format("memory").queryName("alerts_now").trigger(availableNow=True).start().awaitTermination()
    failed = sum(state == "FAILED" for _, _, state, _, _ in rows)
    late = sum(lag > 150 for _, _, _, lag, _ in rows)
    assert rows_of(spark.table("alerts_now").groupBy("rule_id").count()) == [(1, failed), (2, late)]


def test_alerts_as_rows_of_the_alert_table(make):
    status = make([(1, "failed", 10), (2, "running", 9000)], "task_id int, status string, lag_ms bigint")
    rules = make([(1, "task_failure", "0", True), (2, "data_delay", "5000ms", True)],
                 "rule_id int, rule_type string, expression string, enabled boolean")
    log = op.alert_log(op.evaluate_alert_rules(rules, op.task_metrics(status)), "2024-01-02 00:00:00")
    assert rows_of(log, "rule_id", "subject", "level", "message", "resolved") == [
        (1, "1", "error", "task_failure of 1 is 1.0, limit 0.0", False), (2, "2", "warn", "data_delay of 2 is 9000.0, limit 5000.0", False)]
    assert [row.level for row in op.alert_feed(log, level="warn").collect()] == ["warn"]


def test_tasks_follow_the_newest_answer_of_their_job(make):
    tasks = make([(1, "running", "a", None), (2, "running", "b", "old"), (3, "saving_point", "c", "old"), (4, "saving_point", "d", None),
                  (5, "saving_point", "e", None), (6, "paused", "f", None), (7, "submitting", None, None), (8, "running", "h", "old"),
                  (9, "running", "i", None), (10, "submitting", "j", None)], "task_id int, status string, job_id string, error string")
    polls = make([(1, 1, "FAILED", None), (1, 2, "CANCELED", None), (2, 1, "FINISHED", None), (3, 1, "CANCELED", None), (4, 1, "FAILED", "FAILED"),
                  (5, 1, "Failing", None), (6, 1, "FAILED", None), (7, 1, "FAILED", None), (8, 1, "SUSPENDED", None), (8, 2, None, None),
                  (10, 1, "FAILED", "FAILED")],
                 "task_id int, seq int, job_state string, savepoint_status string")
    assert rows_of(op.follow_jobs(tasks, polls), "task_id", "status", "error") == sorted([
        (1, "finished", op.JOB_CANCELLED), (2, "finished", "old"), (3, "finished", "old"), (4, "running", op.SAVEPOINT_FAILED),
        (5, "failed", op.JOB_FAILED), (6, "paused", None), (7, "submitting", None), (8, "running", "old"), (9, "running", None),
        (10, "failed", op.JOB_FAILED)], key=repr)
    assert rows_of(op.follow_jobs(tasks, polls.limit(0))) == rows_of(tasks)
    assert ("4", "failed") in [(str(row.task_id), row.status) for row in op.follow_jobs(tasks, polls.drop("savepoint_status")).collect()]
