"""Data quality: measures, rule runs with shared scans, alerts and their reports."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.functions.quality import alert_level, alert_message, breach
from strata.sources.tables import write_path

# Fixed value: measured value recorded for a rule that could not run.
FAILED_VALUE = -1.0

def null_rate(column: str) -> Column:
    return F.try_divide(F.count_if(F.col(column).isNull()).cast("double"), F.count(F.lit(1)))


def uniqueness(column: str) -> Column:
    """Distinct values over rows; null is no value."""
    return F.try_divide(F.count_distinct(column).cast("double"), F.count(F.lit(1)))


def row_volume() -> Column:
    return F.count(F.lit(1)).cast("double")


def out_of_range_rate(predicate: str | Column) -> Column:
    """Share of rows that break the predicate; a null outcome does not break it."""
    predicate = F.expr(f"({predicate})") if isinstance(predicate, str) else predicate
    return F.try_divide(F.count_if(~predicate).cast("double"), F.count(F.lit(1)))


def custom_sql_check(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """One row ``actual``: the first column of a query's only row, null without a row.

    The query runs as a subquery, so nothing that writes can stand there. More than one row is an error.
    """
    result = spark.sql(f"SELECT * FROM (\n{re.sub(r';\s*$', '', sql.strip())}\n) AS result", **tables)
    first = result.select(F.col(f"`{result.columns[0]}`").cast("double").alias("actual")).limit(2)
    several = F.raise_error(F.lit("the check query gives more than one row")).cast("double")
    return first.agg(F.when(F.count(F.lit(1)) > 1, several).otherwise(F.first("actual")).alias("actual"))


@dataclass(frozen=True)
class Rule:
    rule_id: int
    rule_type: str
    target_table: str
    target_column: str | None = None
    threshold: float | None = 0.0
    expression: str | None = None
    layer: str | None = None
    enabled: bool = True


def _row(rule: Rule, actual: Column, failure: str | None = None) -> Column:
    """One result row: the rule's own values travel with its measure, so no join is needed."""
    return F.struct(
        F.lit(rule.rule_id).cast("bigint").alias("rule_id"), F.lit(rule.rule_type).alias("rule_type"),
        F.lit(rule.layer).cast("string").alias("layer"), F.lit(rule.target_table).alias("target_table"),
        F.lit(rule.target_column).cast("string").alias("target_column"), actual.cast("double").alias("actual"),
        F.lit(float(rule.threshold or 0.0)).alias("threshold"), F.lit(failure).cast("string").alias("failure"))


def _literal_rows(spark: SparkSession, rows: list[Column]) -> list[DataFrame]:
    return [spark.range(1).select(F.inline(F.array(*rows)))] if rows else []


def read_rules(rules: DataFrame) -> list[Rule]:
    """Rules of a rule table. They are the program of a run, so they come to the driver."""
    rows = rules.select(*Rule.__dataclass_fields__).withColumn("threshold", F.col("threshold").cast("double")).collect()
    return sorted((Rule(**row.asDict()) for row in rows), key=lambda rule: rule.rule_id)


def _measure(rule: Rule) -> Column | None:
    if rule.rule_type == "null_rate" and rule.target_column:
        return null_rate(rule.target_column)
    if rule.rule_type == "uniqueness" and rule.target_column:
        return uniqueness(rule.target_column)
    if rule.rule_type == "volume_compare":
        return row_volume()
    if rule.rule_type == "range_check" and rule.expression:
        return out_of_range_rate(rule.expression)
    return None


def _fused(table: DataFrame, measures: dict[Rule, Column]) -> DataFrame:
    """Result rows of all given measures from one aggregate."""
    names = {rule: f"r{index}" for index, rule in enumerate(measures)}
    values = table.agg(*[column.alias(names[rule]) for rule, column in measures.items()])
    return values.select(F.inline(F.array(*[_row(rule, F.col(name)) for rule, name in names.items()])))


def _plans(table: DataFrame, measures: dict[Rule, Column]) -> list[DataFrame]:
    """One aggregate for all plain measures and one for each column counted exactly.

    An exact distinct count reads and shuffles its own column only. Put into the shared aggregate,
    every such count would multiply the rows of all others.
    """
    groups = defaultdict(dict)
    for rule, column in measures.items():
        groups[rule.target_column if rule.rule_type == "uniqueness" else None][rule] = column
    return [_fused(table, members) for members in groups.values()]


def measure_rules(spark: SparkSession, rules: Iterable[Rule], tables: Callable[[str], DataFrame],
                  isolate_runtime: bool = True) -> DataFrame | None:
    """Value or failure of every rule that has something to measure; None when there is no such rule.

    Plain rules on one table share one scan. A rule that does not analyse (missing column or table, bad
    expression) is set aside before any job runs and comes out with a failure; the others go on. A shared
    aggregate that fails while running is halved until the rules at fault are found; the others keep
    sharing. ``isolate_runtime=False`` gives one lazy plan instead, which any failing rule stops.
    """
    by_table, failed, parts = defaultdict(list), [], []
    for rule in rules:
        by_table[rule.target_table].append(rule)

    def fail(rule: Rule, problem: PySparkException) -> None:
        failed.append(_row(rule, F.lit(FAILED_VALUE), _short(problem)))

    def isolated(table: DataFrame, measures: dict[Rule, Column]) -> list[Column]:
        try:
            return [row for plan in _plans(table, measures) for row in _collected(plan, measures)]
        except PySparkException as problem:
            if len(measures) == 1:
                fail(next(iter(measures)), problem)
                return []
            both = list(measures.items())
            return isolated(table, dict(both[:len(both) // 2])) + isolated(table, dict(both[len(both) // 2:]))

    for name, members in by_table.items():
        measures, table = {}, None
        for rule in members:
            try:
                if rule.rule_type == "custom_sql":
                    plan = custom_sql_check(spark, rule.expression)
                    if isolate_runtime:
                        parts += _literal_rows(spark, [_row(rule, F.lit(plan.first().actual))])
                    else:
                        parts.append(plan.select(_row(rule, F.col("actual")).alias("r")).select("r.*"))
                    continue
                column = _measure(rule)
                if column is None:
                    continue
                table = tables(name) if table is None else table
                table.agg(column)
                measures[rule] = column
            except PySparkException as problem:
                fail(rule, problem)
        if measures:
            parts += _literal_rows(spark, isolated(table, measures)) if isolate_runtime else _plans(table, measures)
    parts += _literal_rows(spark, failed)
    return reduce(DataFrame.unionByName, parts) if parts else None


def _collected(plan: DataFrame, rules: Iterable[Rule]) -> list[Column]:
    """Measured values (one number per rule) as literals, so that a failing plan fails here."""
    by_id = {rule.rule_id: rule for rule in rules}
    return [_row(by_id[row.rule_id], F.lit(row.actual)) for row in plan.select("rule_id", "actual").collect()]


def _short(problem: PySparkException) -> str:
    return problem.getCondition() or str(problem).splitlines()[0]


def quality_results(spark: SparkSession, rules: Iterable[Rule], tables: Callable[[str], DataFrame] | None = None,
                    isolate_runtime: bool = True, at=None) -> DataFrame:
    """One row per enabled rule that could be measured: value, threshold, status, level, message, time of the check.

    Status is pass, fail, no_data (rate of an empty table) or error. ``at`` is the time, by default the current one.
    """
    enabled = [rule for rule in rules if rule.enabled]
    return _judged(spark, measure_rules(spark, enabled, tables or spark.table, isolate_runtime), at)


def _judged(spark: SparkSession, measured: DataFrame | None, at) -> DataFrame:
    """Measured rows with status, level, message and time."""
    if measured is None:
        nothing = Rule(0, "", "")
        measured = _literal_rows(spark, [_row(nothing, F.lit(None))])[0].where(F.lit(False))
    time = F.current_timestamp().cast("timestamp_ntz") if at is None else F.lit(at).cast("timestamp_ntz")
    failed = F.col("failure").isNotNull()
    status = (
        F.when(failed, "error").when(F.col("actual").isNull(), "no_data")
        .when(breach("rule_type", "actual", "threshold"), "fail").otherwise("pass")
    )
    message = F.when(failed, F.concat(F.lit("quality check could not run: "), F.col("failure"))).when(
        F.col("status") == "fail",
        alert_message("target_table", "target_column", "rule_type", F.col("actual"), F.col("threshold")))
    level = F.when(failed, "error").when(F.col("status") == "fail", alert_level("actual", "threshold"))
    return measured.withColumn("status", status).select(
        "rule_id", "rule_type", "layer", "target_table", "target_column", "actual", "threshold", "status",
        level.alias("level"), message.alias("message"), time.alias("checked_at"))


# Rule types that one pass over the rows measures without sorting or counting values.
OBSERVABLE = ("null_rate", "volume_compare", "range_check")


def write_checked(df: DataFrame, path: str, rules: Iterable[Rule], table: str, partition_by: Sequence[str] = (),
                  mode: str = "append", at=None) -> DataFrame:
    """Write ``df`` to ``path`` and return the quality results of its rows for the rules on ``table``.

    Rates and volumes are observed on the rows while they are written, so they cost no scan of their own. Only other
    rules, such as exact uniqueness, read ``df`` again. A rule that does not analyse comes out as an error.
    """
    spark = df.sparkSession
    mine = [rule for rule in rules if rule.enabled and rule.target_table == table]
    seen, failed = {}, []
    for rule in [rule for rule in mine if rule.rule_type in OBSERVABLE]:
        column = _measure(rule)
        if column is None:
            continue
        try:
            df.agg(column)
            seen[f"r{len(seen)}"] = rule, column
        except PySparkException as problem:
            failed.append(_row(rule, F.lit(FAILED_VALUE), _short(problem)))
    watch = Observation()
    rows = df.observe(watch, *[column.alias(name) for name, (_, column) in seen.items()]) if seen else df
    write_path(rows, path, partition_by, mode)
    found = [_row(rule, F.lit(watch.get[name])) for name, (rule, _) in seen.items()]
    parts = _literal_rows(spark, found + failed)
    others = measure_rules(spark, [rule for rule in mine if rule.rule_type not in OBSERVABLE], lambda name: df)
    parts += [] if others is None else [others]
    return _judged(spark, reduce(DataFrame.unionByName, parts) if parts else None, at)


def run_checks(spark: SparkSession, rules: Iterable[Rule], tables: Callable[[str], DataFrame] | None = None,
               isolate_runtime: bool = True, at=None) -> DataFrame:
    """Alert rows of a run: broken rules and rules that could not run."""
    results = quality_results(spark, rules, tables, isolate_runtime, at)
    return results.where(F.col("status").isin("fail", "error"))


def alert_rows(alerts: DataFrame, at=None) -> DataFrame:
    """Alerts of a run as rows of the alert table: with id, time (that of the check by default), and not resolved."""
    time = F.col("checked_at") if at is None else F.lit(at).cast("timestamp_ntz")
    kept = [name for name in alerts.columns if name != "checked_at"]
    return alerts.select(F.xxhash64("rule_id", time).alias("id"), *kept, time.alias("triggered_at"), F.lit(False).alias("resolved"))


def run_checks_for_layer(spark: SparkSession, rules: Iterable[Rule], layer: str, tables=None, at=None) -> DataFrame:
    return run_checks(spark, [rule for rule in rules if rule.layer == layer], tables, at=at)


def run_check(spark: SparkSession, rules: Iterable[Rule], rule_id: int, tables=None, at=None) -> DataFrame:
    """Alert rows of one rule; an unknown or disabled rule is an error."""
    chosen = [rule for rule in rules if rule.rule_id == rule_id]
    if not chosen:
        raise ValueError(f"no quality rule {rule_id}")
    if not chosen[0].enabled:
        raise ValueError(f"quality rule {rule_id} is not enabled")
    return run_checks(spark, chosen, tables, at=at)


def latest_alert_per_rule(alerts: DataFrame, rule: str = "rule_id", time: str = "triggered_at",
                          alert: str = "id") -> DataFrame:
    """Newest alert of each rule; equal times are decided by the higher alert id."""
    rest = [name for name in alerts.columns if name not in (rule, time, alert)]
    newest = F.max(F.struct(time, alert, *rest)).alias("_a")
    return alerts.groupBy(rule).agg(newest).select(
        *[F.col(name) if name == rule else F.col(f"_a.{name}").alias(name) for name in alerts.columns])


def rule_status(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per rule: disabled, failing while its newest alert is open, else passing."""
    latest = latest_alert_per_rule(alerts).select("rule_id", "resolved", "triggered_at")
    status = F.when(~F.col("enabled"), "disabled").when(~F.col("resolved"), "failing").otherwise("passing")
    return rules.join(latest, "rule_id", "left").select(
        "rule_id", status.alias("status"), F.col("triggered_at").alias("last_alert_at"))


def pass_rate(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Percent of rules left after taking off open alerts, never below 0; 100 without rules."""
    counted = rules.agg(F.count(F.lit(1)).alias("rules")).withColumn("open_alerts", F.lit(0).cast("bigint")).unionByName(
        alerts.agg(F.count_if(~F.col("resolved")).alias("open_alerts")).withColumn("rules", F.lit(0).cast("bigint")))
    both = counted.agg(F.sum("rules").alias("rules"), F.sum("open_alerts").alias("open_alerts"))
    share = F.floor((F.col("rules") - F.col("open_alerts")) * 100 / F.col("rules") + F.lit(0.5))
    return both.select("rules", "open_alerts", F.when(F.col("rules") == 0, F.lit(100).cast("bigint")).otherwise(
        F.greatest(F.lit(0).cast("bigint"), share)).alias("pass_rate"))


def quality_trend(results: DataFrame, time: str, passed: Column) -> DataFrame:
    """Checks, passes and pass rate per day."""
    daily = results.groupBy(F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(passed).alias("passed"))
    return daily.withColumn("pass_rate", F.col("passed").cast("double") / F.col("checks"))


def quality_totals(results: DataFrame, passed: Column) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"),
        F.try_divide(F.count_if(passed).cast("double"), F.count(F.lit(1))).alias("pass_rate"))


def recent_results(results: DataFrame, time: str, tie: str, n: int = 10) -> DataFrame:
    """The ``n`` newest results."""
    return results.orderBy(F.desc(time), F.desc(tie)).limit(n)


def search(df: DataFrame, newest: str | None = None, tie: str | None = None, **equal) -> DataFrame:
    """Rows that match every given value (None means any), newest first."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    order = [F.desc(name) for name in (newest, tie) if name]
    return df.orderBy(*order) if order else df


def search_rules(rules: DataFrame, layer=None, rule_type=None, enabled=None) -> DataFrame:
    return search(rules, layer=layer, rule_type=rule_type, enabled=enabled)


def search_alerts(alerts: DataFrame, level=None, resolved=None, rule_type=None) -> DataFrame:
    return search(alerts, "triggered_at", "id", level=level, resolved=resolved, rule_type=rule_type)
