"""Task monitoring, alert rules and component health derived from events."""

from pyspark.sql import functions as F

from strata.functions.states import map_job_state as status_of
from strata.operators import monitor as op
from strata.plans.registry import Data, register
from strata.session import fresh_path
from strata.streaming import ingest
from strata.streaming.metrics import as_event_time

STATUS_OF = """CASE job_state WHEN 'RUNNING' THEN 'running' WHEN 'RESTARTING' THEN 'running' WHEN 'FAILED' THEN 'failed'
        WHEN 'FINISHED' THEN 'finished' WHEN 'CREATED' THEN 'submitting' ELSE lower(job_state) END"""
STATUS = f"""
    polls AS (SELECT *, {STATUS_OF} AS status FROM tasklog),
    status AS (
      SELECT task_id, arg_max(status, seq) AS status, max(at_time) AS changed_at,
             arg_max(lag_ms, seq) FILTER (status = 'running') AS lag_ms, count(*) AS polls,
             count(*) FILTER (status = 'failed') AS failures
      FROM polls GROUP BY task_id)"""
FIRED = STATUS + """,
    metrics AS (
      SELECT 'task_failure' AS rule_type, CAST(task_id AS VARCHAR) AS subject, CASE WHEN status = 'failed' THEN 1.0::DOUBLE ELSE 0 END AS value FROM status
      UNION ALL SELECT 'data_delay', CAST(task_id AS VARCHAR), CAST(lag_ms AS DOUBLE) FROM status
      UNION ALL SELECT 'quality_failure', CAST(rule_id AS VARCHAR), CAST(count(*) AS DOUBLE) FROM alerts WHERE NOT resolved GROUP BY rule_id),
    limits AS (SELECT rule_id, rule_type, coalesce(TRY_CAST(regexp_extract(expression, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE), 0) AS limit_value
               FROM alert_rules WHERE enabled),
    fired AS (SELECT rule_id, rule_type, subject, value, limit_value FROM metrics JOIN limits USING (rule_type) WHERE value > limit_value)"""
LATEST = "SELECT * FROM health QUALIFY row_number() OVER (PARTITION BY check_id, component ORDER BY seq DESC) = 1"


def _status(d: Data):
    return op.task_status(d.fixture("tasklog"))


def _fired(d: Data):
    metrics = op.task_metrics(_status(d)).unionByName(op.quality_metrics(d.fixture("alerts")))
    return op.evaluate_alert_rules(d.fixture("alert_rules"), metrics)


@register("""
    SELECT event_id, CASE state WHEN 'RUNNING' THEN 'running' WHEN 'CANCELED' THEN 'finished' WHEN 'FINISHED' THEN 'finished'
                          WHEN 'SUSPENDED' THEN 'paused' WHEN 'Failing' THEN 'failed' ELSE lower(state) END AS status
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'CANCELED' WHEN 'error' THEN 'Failing'
                           WHEN 'purchase' THEN 'SUSPENDED' ELSE 'INITIALIZING' END AS state FROM events)""")
def map_job_state(d: Data):
    state = F.expr("""CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'CANCELED' WHEN 'error' THEN 'Failing'
                      WHEN 'purchase' THEN 'SUSPENDED' ELSE 'INITIALIZING' END""")
    return d.table("events").select("event_id", status_of(state).alias("status"))


@register("WITH" + STATUS + " SELECT * FROM status", ("tasklog",))
def task_status(d: Data):
    return _status(d)


@register("WITH" + STATUS + """,
    metrics AS (SELECT task_id, arg_max(seq % 97 / 2.0::DOUBLE, seq) AS throughput, arg_max(seq % 50, seq) AS checkpoint_count
                FROM polls WHERE status = 'running' GROUP BY task_id)
    SELECT s.*, m.throughput, m.checkpoint_count FROM status s LEFT JOIN metrics m USING (task_id)""", ("tasklog",))
def task_status_metrics(d: Data):
    return op.task_status(d.fixture("tasklog").withColumn("throughput", (F.col("seq") % 97).cast("double") / 2)
                          .withColumn("checkpoint_count", F.col("seq") % 50))


FOLLOWED = """
    SELECT user_id AS task_id, CASE user_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'submitting' WHEN 2 THEN 'saving_point' ELSE 'paused' END AS status,
           CASE WHEN user_id % 5 <> 0 THEN concat('job', CAST(user_id AS VARCHAR(20))) END AS job_id,
           CASE WHEN user_id % 7 = 0 THEN 'an older error' END AS error
    FROM events GROUP BY user_id"""
POLLED = """
    SELECT user_id AS task_id, event_id AS seq,
           CASE WHEN event_id % 11 <> 0 THEN CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'CANCELED' WHEN 'error' THEN 'FAILED'
                                                  WHEN 'purchase' THEN 'FINISHED' ELSE 'CREATED' END END AS job_state,
           CASE WHEN event_id % 2 = 0 THEN 'FAILED' END AS savepoint_status
    FROM events"""


@register(f"""
    WITH tasks AS ({FOLLOWED}), polls AS ({POLLED}),
         newest AS (SELECT * FROM polls WHERE job_state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1),
         met AS (SELECT t.*, CASE WHEN t.job_id IS NOT NULL AND t.status <> 'paused' THEN n.job_state END AS state, n.savepoint_status
                 FROM tasks t LEFT JOIN newest n USING (task_id))
    SELECT task_id, job_id,
           CASE WHEN state = 'FAILED' AND status = 'saving_point' AND savepoint_status = 'FAILED' THEN 'running'
                WHEN state = 'FAILED' THEN 'failed' WHEN state IN ('CANCELED', 'FINISHED') THEN 'finished' ELSE status END AS status,
           CASE WHEN state = 'FAILED' AND status = 'saving_point' AND savepoint_status = 'FAILED' THEN '{op.SAVEPOINT_FAILED}'
                WHEN state = 'FAILED' THEN '{op.JOB_FAILED}'
                WHEN state = 'CANCELED' AND status <> 'saving_point' THEN '{op.JOB_CANCELLED}' ELSE error END AS error
    FROM met""")
def follow_jobs(d: Data):
    events = d.table("events")
    bound = lambda text: d.spark.sql(text.replace("FROM events", "FROM {events}"), events=events)
    return op.follow_jobs(bound(FOLLOWED), bound(POLLED))


INVALID = f"""
    WITH moves AS (SELECT task_id, seq, at_time, {STATUS_OF} AS to_status,
                          lag({STATUS_OF}) OVER (PARTITION BY task_id ORDER BY seq) AS from_status FROM tasklog)
    SELECT * FROM moves WHERE from_status <> to_status AND NOT (
      (from_status = 'submitting' AND to_status IN ('running', 'failed')) OR (from_status = 'running' AND to_status IN ('failed', 'finished'))
      OR (from_status = 'failed' AND to_status IN ('submitting', 'finished')))"""


@register(INVALID, ("tasklog",))
def invalid_transitions(d: Data):
    return op.invalid_transitions(d.fixture("tasklog"))


@register(INVALID, ("tasklog",))
def invalid_transitions_split(d: Data):
    """Tasks with more polls than an even share of these tables count as hot and are ordered in ranges."""
    return op.invalid_transitions(d.fixture("tasklog"), parts=64)


@register(f"""
    SELECT task_id, seq, job_id, submitted_at, 'failed' AS status, '{op.SUBMIT_TIMEOUT.format(minutes=5)}' AS error
    FROM (SELECT task_id, seq, job_id, at_time AS submitted_at, {STATUS_OF} AS status FROM tasklog)
    WHERE status = 'submitting' AND job_id IS NULL AND submitted_at < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 MINUTE""", ("tasklog",))
def stuck_submissions(d: Data):
    tasks = d.fixture("tasklog").select(
        "task_id", "seq", "job_id", F.col("at_time").alias("submitted_at"), status_of("job_state").alias("status"))
    return op.stuck_submissions(tasks, "2024-01-20 12:00:00")


FAILED_TWIN = f"""
    SELECT task_id, seq, at_time AS submitted_at, at_time + INTERVAL 90 MINUTE AS failed_at, 'failed' AS status,
           '{op.SUBMIT_TIMEOUT.format(minutes=90)}' AS error
    FROM (SELECT *, {STATUS_OF} AS status FROM tasklog) s WHERE status = 'submitting' AND job_id IS NULL AND NOT EXISTS (
      SELECT 1 FROM tasklog j WHERE j.task_id = s.task_id AND j.job_id IS NOT NULL AND j.at_time BETWEEN s.at_time AND s.at_time + INTERVAL 90 MINUTE)"""


@register(FAILED_TWIN, ("tasklog",))
def failed_submissions(d: Data):
    return op.failed_submissions(d.fixture("tasklog"), 90)


@register(FAILED_TWIN, ("tasklog",))
def failed_submission_stream(d: Data):
    """The polls as a stream, and one much later poll, which lets all limits pass."""
    base, polls = fresh_path(d.spark, "submissions"), d.fixture("tasklog")
    last = polls.orderBy(F.desc("at_time")).limit(1).withColumn("at_time", F.expr("at_time + INTERVAL 2 DAYS")).withColumn(
        "task_id", F.lit(-1).cast("bigint"))
    for rows in (polls, last):
        rows.write.mode("append").parquet(f"{base}/in")
        stream = as_event_time(ingest.stream_files(d.spark, f"{base}/in", polls.schema), "at_time", "1 minute")
        ingest.run_to_end(ingest.ingest_stream(op.failed_submissions(stream, 90), f"{base}/out", f"{base}/checkpoint", once=True))
    time = lambda name: F.col(name).cast("timestamp_ntz").alias(name)
    return d.spark.read.parquet(f"{base}/out").select("task_id", "seq", time("submitted_at"), time("failed_at"), "status", "error")


@register("""
    SELECT seq, CASE WHEN job_state = 'CREATED' THEN 0 ELSE lag_ms END AS checkpoint_count,
           CASE WHEN job_state NOT IN ('CREATED', 'FAILED') THEN date_trunc('millisecond', at_time) END AS last_checkpoint_time,
           CASE WHEN job_state IN ('CREATED', 'FAILED') THEN 0 ELSE seq * 100 END AS state_size FROM tasklog""", ("tasklog",))
def checkpoint_metrics(d: Data):
    """Polls with a broken document (CREATED) and without a completed checkpoint (FAILED)."""
    done = F.struct(F.unix_millis(F.col("at_time").cast("timestamp")).alias("latest_ack_timestamp"),
                    (F.col("seq") * 100).alias("state_size"))
    document = F.to_json(F.struct(
        F.struct(F.col("lag_ms").alias("completed")).alias("counts"),
        F.struct(F.when(F.col("job_state") != "FAILED", done).alias("completed")).alias("latest")))
    polls = d.fixture("tasklog").select("seq", F.when(F.col("job_state") == "CREATED", "{").otherwise(document).alias("body"))
    return op.checkpoint_metrics(polls, "body")


@register("WITH" + STATUS + """
    SELECT 'tasks' AS metric, count(*) AS value FROM status UNION ALL SELECT 'running_tasks', count(*) FROM status WHERE status = 'running'
    UNION ALL SELECT 'failed_tasks', count(*) FROM status WHERE status = 'failed'
    UNION ALL SELECT concat('tables_', layer), count(*) FROM tbl GROUP BY layer
    UNION ALL SELECT 'open_alerts', count(*) FROM alerts WHERE NOT resolved""", ("tasklog", "tbl", "alerts"))
def task_overview(d: Data):
    return op.task_overview(_status(d), d.fixture("tbl"), d.fixture("alerts"))


@register("""
    SELECT p_partkey AS task_id, p_name AS task_name, p_type AS task_type FROM part
    WHERE p_type = 'ECONOMY' AND contains(lower(p_name), 'ring')""")
def search_tasks(d: Data):
    tasks = d.table("part").select(
        F.col("p_partkey").alias("task_id"), F.col("p_name").alias("task_name"), F.col("p_type").alias("task_type"))
    return op.search_tasks(tasks, task_type="ECONOMY", keyword="RING")


@register("WITH" + FIRED + " SELECT * FROM fired", ("tasklog", "alerts", "alert_rules"))
def evaluate_alert_rules(d: Data):
    return _fired(d)


@register("WITH" + FIRED + """
    SELECT f.*, c.channel FROM fired f JOIN (
      SELECT rule_id, trim(unnest(string_split(channels, ','))) AS channel FROM alert_rules) c USING (rule_id)""",
          ("tasklog", "alerts", "alert_rules"))
def route_alerts(d: Data):
    return op.route_alerts(_fired(d), d.fixture("alert_rules"))


@register("SELECT * FROM alerts WHERE NOT resolved AND rule_type = 'uniqueness'", ("alerts",))
def alert_feed(d: Data):
    return op.alert_feed(d.fixture("alerts"), resolved=False, rule_type="uniqueness")


@register(f"""
    WITH latest AS ({LATEST}),
    parts AS (SELECT check_id, max(CASE WHEN component = 'mysql' THEN status END) AS m, max(CASE WHEN component = 'engine' THEN status END) AS e,
                     max(CASE WHEN component = 'store' THEN status END) AS s FROM latest GROUP BY check_id)
    SELECT check_id, CASE WHEN coalesce(m, 'unknown') <> 'healthy' THEN 'unhealthy'
                          WHEN coalesce(e, 'unknown') <> 'healthy' OR coalesce(s, 'unknown') <> 'healthy' THEN 'degraded' ELSE 'healthy' END AS overall
    FROM parts""", ("health",))
def overall_health(d: Data):
    latest = op.latest_components(d.fixture("health"), ["check_id"])
    return op.overall_health(latest, "mysql", ["engine", "store"])


@register("""
    WITH merged AS (SELECT component, arg_max(status, seq) AS status, arg_max(checked_at, seq) AS checked_at, max(seq) AS seq
                    FROM health GROUP BY component)
    SELECT *, (SELECT CASE WHEN count(*) FILTER (component = 'mysql' AND status = 'healthy') = 0 THEN 'unhealthy'
                           WHEN count(*) FILTER (component <> 'mysql' AND status = 'healthy') < 2 THEN 'degraded' ELSE 'healthy' END FROM merged) AS overall
    FROM merged""", ("health",))
def merge_component(d: Data):
    health = d.fixture("health")
    latest = op.latest_components(health.where(F.col("component") != "store"))
    return op.merge_component(latest, health.where(F.col("component") == "store"), "mysql", ["engine", "store"])
