"""Task states, metrics, alert rules, component health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.functions.states import map_job_state, overall_status, transition_allowed
from strata.operators.quality import search, search_alerts
from strata.session import written

# Minutes a submission may take, and the error text of one that took longer.
SUBMIT_MINUTES = 5
SUBMIT_TIMEOUT = "still without a job after {minutes} minutes, given up"

# Statuses of tasks that a job stands behind, job states that end one, and the error texts of their tasks.
ACTIVE = ("running", "submitting", "saving_point")
FAILED_STATES = ("FAILED", "Failing")
ENDED_STATES = ("CANCELED", "FINISHED")
JOB_FAILED = "the job failed, its log says why"
JOB_CANCELLED = "the job was cancelled by someone else"
SAVEPOINT_FAILED = "no savepoint could be taken, the job goes on"

# Field names of a checkpoint document.
CHECKPOINT_SCHEMA = (
    "struct<counts:struct<completed:bigint>,"
    "latest:struct<completed:struct<latest_ack_timestamp:bigint,state_size:bigint>>>"
)


def task_status(log: DataFrame, task: str = "task_id", seq: str = "seq") -> DataFrame:
    """Current status of each task from its polled job states, with lag of the newest running poll.

    Where the polls have ``throughput`` or ``checkpoint_count``, so has the status, also of the newest running poll.
    Also valid on a stream of polls (update or complete output): the state is one row per task.
    """
    running = map_job_state("job_state") == "running"
    newest = lambda name: F.max_by(F.when(running, F.col(name)), F.when(running, F.col(seq))).alias(name)
    more = [name for name in ("throughput", "checkpoint_count") if name in log.columns]
    return log.where(F.col("job_state").isNotNull()).groupBy(task).agg(
        F.max_by("job_state", seq).alias("_state"), F.max_by("at_time", seq).alias("changed_at"),
        newest("lag_ms"), F.count(F.lit(1)).alias("polls"), F.count_if(map_job_state("job_state") == "failed").alias("failures"),
        *map(newest, more),
    ).select(task, map_job_state("_state").alias("status"), "changed_at", "lag_ms", "polls", "failures", *more)


def previous_value(df: DataFrame, key: Sequence[str], seq: str, value: str, alias: str,
                   parts: int | None = None) -> DataFrame:
    """``lag`` of ``value`` per key in ``seq`` order; a key may hold any share of the rows.

    All rows are cut into ranges of (key, seq), so a hot key spreads over many tasks. The cut is written
    once; each range looks back within itself, and the first row of a key in a range takes the value from
    the key's last row in the ranges before. A key has at most as many such border rows as there are ranges.
    ``seq`` has any orderable type, is unique within a key, and null comes first.
    """
    order = [*key, seq]
    cut = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    rows = written(cut.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = rows.withColumn("_before", F.lag(F.struct(value)).over(W.partitionBy("_range", *key).orderBy(seq)))
    ends = rows.groupBy("_range", *key).agg(F.max(F.struct(seq, value)).alias("_end"))
    carried = ends.select("_range", *key, F.lag(F.struct(f"_end.{value}")).over(
        W.partitionBy(*key).orderBy("_range")).alias("_carry"))
    same = [F.col(f"r.{name}").eqNullSafe(F.col(f"c.{name}")) for name in ("_range", *key)]
    return inside.alias("r").join(carried.alias("c"), same, "left").select(
        *[F.col(f"r.{name}") for name in df.columns], F.coalesce("_before", "_carry")[value].alias(alias))


def invalid_transitions(log: DataFrame, task: str = "task_id", seq: str = "seq", parts: int | None = None) -> DataFrame:
    """State changes of a task that its life cycle does not allow; staying in a state is no change."""
    states = log.where(F.col("job_state").isNotNull()).select(
        task, seq, "at_time", map_job_state("job_state").alias("to_status"))
    moves = previous_value(states, [task], seq, "to_status", "from_status", parts)
    return moves.where(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("to_status"))).where(
        ~transition_allowed(F.col("from_status"), F.col("to_status")))


def stuck_submissions(tasks: DataFrame, now, minutes: int = SUBMIT_MINUTES) -> DataFrame:
    """Submitting tasks that got no job id in time, as failed."""
    late = F.col("submitted_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")
    stuck = tasks.where((F.col("status") == "submitting") & F.col("job_id").isNull() & late)
    return stuck.withColumn("status", F.lit("failed")).withColumn(
        "error", F.lit(SUBMIT_TIMEOUT.format(minutes=minutes)))


def failed_submissions(polls: DataFrame, minutes: int = SUBMIT_MINUTES, task: str = "task_id", time: str = "at_time") -> DataFrame:
    """Submissions (polls in a submitting state without a job id) that no job id of their task followed in time.

    On a stream with a watermark on ``time`` the join keeps a submission as state until its minutes have ended, and gives it
    out then and not at the next poll of its task; on a table the limits must have passed. Two polls of one task meet
    only if they are at most ``minutes`` apart.
    """
    limit = F.expr(f"INTERVAL {minutes} MINUTES")
    waiting = polls.where((map_job_state("job_state") == "submitting") & F.col("job_id").isNull()).select(
        task, F.col("seq"), F.col(time).alias("submitted_at"))
    started = polls.where(F.col("job_id").isNotNull()).select(F.col(task).alias("_task"), F.col(time).alias("_started_at"))
    met = (F.col(task) == F.col("_task")) & (F.col("_started_at") >= F.col("submitted_at")) & (
        F.col("_started_at") <= F.col("submitted_at") + limit)
    alone = (waiting.join(started, met, "left").where("_task IS NULL") if polls.isStreaming else waiting.join(started, met, "left_anti"))
    return alone.select(task, "seq", "submitted_at", (F.col("submitted_at") + limit).alias("failed_at"),
                        F.lit("failed").alias("status"), F.lit(SUBMIT_TIMEOUT.format(minutes=minutes)).alias("error"))


def follow_jobs(tasks: DataFrame, polls: DataFrame, task: str = "task_id", seq: str = "seq") -> DataFrame:
    """Tasks (with status, job_id, error) after the newest poll of their job that was answered.

    Only active tasks with a job change: a failed job fails its task, a finished or cancelled one finishes it. A cancelled job
    is an error unless its task was saving. A failure while saving whose poll has ``savepoint_status`` FAILED
    is the savepoint's alone, and the task runs on. All other states, and no answer, change nothing.
    """
    savepoint = F.col("savepoint_status") if "savepoint_status" in polls.columns else F.lit(None).cast("string")
    newest = polls.where(F.col("job_state").isNotNull()).groupBy(F.col(task).alias("_task")).agg(
        F.max(F.struct(F.col(seq).alias("seq"), F.col("job_state").alias("state"), savepoint.alias("savepoint"))).alias("_poll"))
    state, saving = F.col("_poll.state"), F.col("status") == "saving_point"
    failed, ended = state.isin(*FAILED_STATES), state.isin(*ENDED_STATES)
    runs_on = failed & saving & (F.col("_poll.savepoint") == "FAILED")
    status = F.when(runs_on, "running").when(failed, "failed").when(ended, "finished").otherwise(F.col("status"))
    error = F.when(runs_on, SAVEPOINT_FAILED).when(failed, JOB_FAILED).when(
        (state == "CANCELED") & ~saving, JOB_CANCELLED).otherwise(F.col("error"))
    active = F.col("status").isin(*ACTIVE) & F.col("job_id").isNotNull()
    changed = {"status": status, "error": error}
    return tasks.join(newest, F.col(task) == F.col("_task"), "left").select(*[
        F.when(active, changed[name]).otherwise(F.col(name)).alias(name) if name in changed else F.col(name) for name in tasks.columns])


def checkpoint_metrics(df: DataFrame, json_col: str) -> DataFrame:
    """Completed checkpoints, time of the last one and its state size; 0 where the text has none."""
    parsed = df.withColumn("_c", F.from_json(json_col, CHECKPOINT_SCHEMA))
    number = lambda path: F.coalesce(F.col(path), F.lit(0).cast("bigint"))
    last = number("_c.latest.completed.latest_ack_timestamp")
    return parsed.select(
        *[name for name in df.columns if name != json_col],
        number("_c.counts.completed").alias("checkpoint_count"),
        F.when(last > 0, F.timestamp_millis(last).cast("timestamp_ntz")).alias("last_checkpoint_time"),
        number("_c.latest.completed.state_size").alias("state_size"))


def task_overview(tasks: DataFrame, tables: DataFrame, alerts: DataFrame) -> DataFrame:
    """Dashboard numbers as (metric, value): tasks by state, tables per layer, open alerts."""
    counted = tasks.agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "running").alias("running_tasks"),
        F.count_if(F.col("status") == "failed").alias("failed_tasks"))
    names = ["tasks", "running_tasks", "failed_tasks"]
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in names])
    layers = tables.groupBy("layer").agg(F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("tables_"), F.col("layer")).alias("metric"), "value")
    opened = alerts.agg(F.count_if(~F.col("resolved")).alias("value")).select(
        F.lit("open_alerts").alias("metric"), "value")
    return counted.select(F.inline(pairs)).unionByName(layers).unionByName(opened)


def search_tasks(tasks: DataFrame, status=None, task_type=None, keyword: str | None = None) -> DataFrame:
    found = search(tasks, status=status, task_type=task_type)
    return found if keyword is None else found.where(F.lower("task_name").contains(keyword.lower()))


def task_metrics(status: DataFrame, task: str = "task_id") -> DataFrame:
    """Alert metrics (rule_type, subject, value) of task rows: failed state as 1, lag in ms."""
    subject = F.col(task).cast("string")
    metrics = F.array(
        F.struct(F.lit("task_failure").alias("rule_type"), subject.alias("subject"),
                 (F.col("status") == "failed").cast("double").alias("value")),
        F.struct(F.lit("data_delay").alias("rule_type"), subject.alias("subject"),
                 F.col("lag_ms").cast("double").alias("value")))
    return status.select(F.inline(metrics))


def quality_metrics(alerts: DataFrame) -> DataFrame:
    """Alert metrics of quality rules: open alerts per rule."""
    return alerts.where(~F.col("resolved")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("quality_failure").alias("rule_type"), F.col("rule_id").cast("string").alias("subject"),
        F.col("n").cast("double").alias("value"))


def rule_limit(expression) -> Column:
    """The number in a rule text such as ``5000ms``; 0 without one."""
    return F.coalesce(F.regexp_extract(expression, r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def evaluate_alert_rules(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics above the limit of an enabled rule of their type; works on a stream of metrics too.

    Rules are the program of the evaluation and come to the driver, as quality rules do. Their limits stand in the plan as
    literals by type, so metrics are not shuffled to the few rule types there are.
    """
    active = rules.where("enabled").select("rule_id", "rule_type", rule_limit("expression").alias("limit_value"))
    limits = [F.when((F.col("rule_type") == row.rule_type) & (F.col("value") > row.limit_value), F.struct(
        F.lit(row.rule_id).cast("bigint").alias("rule_id"), F.lit(row.limit_value).alias("limit_value")))
        for row in active.orderBy("rule_id").collect()]
    if not limits:
        nothing = F.struct(F.lit(0).cast("bigint").alias("rule_id"), F.lit(0.0).alias("limit_value"))
        limits = [F.when(F.lit(False), nothing)]
    broken = F.filter(F.array(*limits), lambda limit: limit.isNotNull())
    return metrics.select("rule_type", "subject", "value", F.inline(broken)).select(
        "rule_id", "rule_type", "subject", "value", "limit_value")


# Level of an alert by the type of its rule; others are errors.
RULE_LEVELS = {"task_failure": "error", "data_delay": "warn", "quality_failure": "error"}


def alert_log(alerts: DataFrame, at=None) -> DataFrame:
    """What ``evaluate_alert_rules`` gives as rows of the alert table: id, level, message, time, not resolved.

    ``at`` is the time of the evaluation, on a stream the current time.
    """
    time = F.current_timestamp().cast("timestamp_ntz") if at is None else F.lit(at).cast("timestamp_ntz")
    level = F.lit("error")
    for rule_type, name in RULE_LEVELS.items():
        level = F.when(F.col("rule_type") == rule_type, name).otherwise(level)
    message = F.format_string("%s of %s is %.1f, limit %.1f", "rule_type", "subject", "value", "limit_value")
    return alerts.withColumn("triggered_at", time).select(
        F.xxhash64("rule_id", "subject", "triggered_at").alias("id"), "*", level.alias("level"), message.alias("message"),
        F.lit(False).alias("resolved"))


def route_alerts(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per alert and channel of its rule."""
    channels = rules.select("rule_id", F.explode(F.split("channels", ",")).alias("channel")).select(
        "rule_id", F.lower(F.trim("channel")).alias("channel")).where(F.col("channel") != "")
    return alerts.join(channels, "rule_id")


def alert_feed(alerts: DataFrame, level=None, resolved=None, rule_type=None) -> DataFrame:
    """Alerts of quality and task rules alike, newest first."""
    return search_alerts(alerts, level, resolved, rule_type)


def _roles(core: str, data: Sequence[str]) -> tuple[Column, Column]:
    healthy = lambda name: F.coalesce(
        F.max(F.when(F.col("component") == name, F.col("status"))), F.lit("unknown")) == "healthy"
    data_ok = healthy(data[0])
    for name in data[1:]:
        data_ok = data_ok & healthy(name)
    return healthy(core), data_ok


def overall_health(latest: DataFrame, core: str, data: Sequence[str], check: str = "check_id") -> DataFrame:
    """Overall status per check; ``latest`` has at most one row per check and component.

    A component without a row counts as unknown, which is not healthy.
    """
    core_ok, data_ok = _roles(core, data)
    return latest.groupBy(check).agg(core_ok.alias("_core"), data_ok.alias("_data")).select(
        check, overall_status(F.col("_core"), F.col("_data")).alias("overall"))


def latest_components(health: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Newest status of each component (within ``by``)."""
    return health.groupBy(*by, "component").agg(F.max(F.struct("seq", "status", "checked_at")).alias("_h")).select(
        *by, "component", "_h.status", "_h.checked_at", "_h.seq")


def merge_component(latest: DataFrame, updates: DataFrame, core: str, data: Sequence[str]) -> DataFrame:
    """Snapshot after new component results: each replaces its own part, then the overall status.

    One row per component, with the overall status on each.
    """
    columns = ["component", "status", "checked_at", "seq"]
    merged = latest_components(latest.select(*columns).unionByName(updates.select(*columns)))
    core_ok, data_ok = _roles(core, data)
    overall = merged.agg(core_ok.alias("_core"), data_ok.alias("_data")).select(
        overall_status(F.col("_core"), F.col("_data")))
    return merged.withColumn("overall", overall.scalar())
