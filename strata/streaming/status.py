"""Task status and alerts over streams of polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.functions.states import map_job_state
from strata.operators.monitor import evaluate_alert_rules, failed_submissions, task_metrics, task_status
from strata.operators.state import files_of, exists
from strata.session import written
from strata.streaming.ingest import ingest_stream
from strata.streaming.metrics import as_event_time


def task_status_stream(polls: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Status rows of tasks that changed, appended as files per batch; ``read_status`` gives the newest of each.

    The fold is the batch one; its state is one row per task in the streaming state store. A batch that is
    run again after a failure replaces its own files.
    """
    spark = polls.sparkSession
    if exists(spark, path) and not exists(spark, checkpoint):
        raise ValueError(f"{path} has batches, but their checkpoint {checkpoint} is missing")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    writer = task_status(polls).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_status(spark: SparkSession, path: str, task: str = "task_id") -> DataFrame:
    """Current status per task from the files of ``task_status_stream``."""
    rows = spark.read.parquet(path)
    rest = [name for name in rows.columns if name not in (task, "_batch")]
    return rows.groupBy(task).agg(F.max_by(F.struct(*rest), "_batch").alias("_s")).select(task, "_s.*")


def fold_status(spark: SparkSession, path: str) -> int:
    """Fold the batches before the newest one into one and drop them; returns how many folders went.

    The newest batch stays as it is: the stream may write it again after a failure.
    """
    numbers = sorted({row[0] for row in spark.read.parquet(path).select("_batch").distinct().collect()})  # one per batch since the last fold
    old = numbers[:-1]
    if len(old) < 2:
        return 0
    rows = spark.read.parquet(path).where(F.col("_batch") <= old[-1])
    rest = [name for name in rows.columns if name not in ("task_id", "_batch")]
    folded = written(rows.groupBy("task_id").agg(F.max_by(F.struct(*rest), "_batch").alias("_s")).select("task_id", "_s.*"), "status")
    # Until the older folders are gone, what is folded is newer than they are.
    folded.withColumn("_batch", F.lit(old[-1])).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)
    for number in old[:-1]:
        files, folder = files_of(spark, f"{path}/_batch={number}")
        files.delete(folder, True)
    return len(old) - 1


def alert_stream(polls: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts of every poll as it comes in: no state, each poll row is tested against the rules."""
    metrics = task_metrics(polls.where("job_state IS NOT NULL").withColumn("status", map_job_state("job_state")))
    return evaluate_alert_rules(rules, metrics)


def failed_submission_stream(polls: DataFrame, path: str, checkpoint: str, delay: str = "1 minute", once: bool = False) -> StreamingQuery:
    """Submissions that end without a job id, appended as the watermark passes their limit.

    The state is that of a stream join: submissions and job ids of the last minutes, in the state store of the JVM.
    """
    return ingest_stream(failed_submissions(as_event_time(polls, "at_time", delay)), path, checkpoint, once=once)
