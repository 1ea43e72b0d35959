"""Quality rules over the given tables."""

from pyspark.sql import functions as F

from strata.functions.quality import alert_level as level_of
from strata.functions.quality import alert_message as message_of
from strata.functions.quality import breach as breach_of
from strata.operators import quality as op
from strata.operators import sketches
from strata.plans.registry import Data, register
from strata.session import fresh_path

CHECKED_AT = "2024-02-01 12:00:00"
MISSING_COLUMN = op.Rule(90, "null_rate", "orders", "no_such_column", 0.1, None, "ods")
RUNTIME_ERROR = op.Rule(91, "range_check", "orders", None, 0.1, "o_orderkey / (o_custkey - o_custkey) > 0", "ods")

GRID = """
    grid AS (
      SELECT event_id, value AS actual, CAST(event_id % 300 AS DOUBLE) AS threshold,
             CASE event_id % 5 WHEN 0 THEN 'null_rate' WHEN 1 THEN 'uniqueness' WHEN 2 THEN 'volume_compare'
                  WHEN 3 THEN 'range_check' ELSE 'custom_sql' END AS rule_type,
             CASE WHEN event_id % 2 = 0 THEN event_type END AS target_column
      FROM events)"""

MEASURED = """
    measured AS (
      SELECT 0 AS rule_id, count(*) FILTER (NOT (l_discount BETWEEN 0.02 AND 0.08)) / count(*)::DOUBLE AS actual FROM lineitem
      UNION ALL SELECT 1, count(DISTINCT l_orderkey) / count(*)::DOUBLE FROM lineitem
      UNION ALL SELECT 2, count(*)::DOUBLE FROM orders
      UNION ALL SELECT 3, count(*) FILTER (value IS NULL) / count(*)::DOUBLE FROM events
      UNION ALL SELECT 4, count(*) FILTER (NOT (o_totalprice >= 50000)) / count(*)::DOUBLE FROM orders
      UNION ALL SELECT 5, count(DISTINCT c_custkey) / count(*)::DOUBLE FROM customer
      UNION ALL SELECT 6, count(DISTINCT c_nationkey) / count(*)::DOUBLE FROM customer),
    judged AS (
      SELECT r.rule_id, r.rule_type, r.layer, r.target_table, r.target_column, m.actual, r.threshold,
             CASE WHEN r.rule_type IN ('uniqueness', 'volume_compare') THEN m.actual < r.threshold ELSE m.actual > r.threshold END AS broken,
             abs(m.actual - r.threshold) / greatest(r.threshold, 0.01::DOUBLE) AS deviation
      FROM measured m JOIN rules r USING (rule_id) WHERE r.enabled),
    results AS (
      SELECT rule_id, rule_type, layer, target_table, target_column, actual, threshold,
             CASE WHEN broken THEN 'fail' ELSE 'pass' END AS status,
             CASE WHEN NOT broken THEN NULL WHEN deviation > 2 THEN 'error' WHEN deviation > 1 THEN 'warn' ELSE 'info' END AS level,
             CASE WHEN broken THEN printf('%s, %s: measured %s of %.4f, which is %s the limit of %.4f', target_table,
                  coalesce(target_column, '(whole table)'), rule_type, actual,
                  CASE WHEN rule_type IN ('uniqueness', 'volume_compare') THEN 'below' ELSE 'above' END, threshold) END AS message,
             TIMESTAMP '2024-02-01 12:00:00' AS checked_at
      FROM judged)"""


def _rules(d: Data) -> list[op.Rule]:
    return op.read_rules(d.fixture("rules"))


def _grid(d: Data):
    kinds = F.create_map(*[part for index, kind in enumerate(("null_rate", "uniqueness", "volume_compare", "range_check"))
                           for part in (F.lit(index), F.lit(kind))])
    return d.table("events").select(
        "event_id", F.col("value").alias("actual"), (F.col("event_id") % 300).cast("double").alias("threshold"),
        F.coalesce(F.try_element_at(kinds, (F.col("event_id") % 5).cast("int")), F.lit("custom_sql")).alias("rule_type"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("target_column"))


@register("""
    SELECT count(*) FILTER (value IS NULL) / count(*)::DOUBLE AS value_nulls,
           count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS kind_nulls FROM events""")
def null_rate(d: Data):
    events = d.table("events").withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    return events.agg(op.null_rate("value").alias("value_nulls"), op.null_rate("kind").alias("kind_nulls"))


@register("SELECT count(DISTINCT l_orderkey) / count(*)::DOUBLE AS uniqueness FROM lineitem")
def uniqueness(d: Data):
    return d.table("lineitem").agg(op.uniqueness("l_orderkey").alias("uniqueness"))


@register("SELECT count(*)::DOUBLE AS row_volume FROM orders")
def row_volume(d: Data):
    return d.table("orders").agg(op.row_volume().alias("row_volume"))


@register("""
    SELECT count(*) FILTER (NOT (l_discount BETWEEN 0.02 AND 0.08)) / count(*)::DOUBLE AS discount_rate,
           count(*) FILTER (l_returnflag <> 'R' AND NOT (l_tax < 0.05)) / count(*)::DOUBLE AS null_outcome_rate FROM lineitem""")
def out_of_range_rate(d: Data):
    return d.table("lineitem").agg(
        op.out_of_range_rate("l_discount BETWEEN 0.02 AND 0.08").alias("discount_rate"),
        op.out_of_range_rate("CASE WHEN l_returnflag <> 'R' THEN l_tax < 0.05 END").alias("null_outcome_rate"))


@register("""
    SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) / count(*)::DOUBLE AS actual FROM documents""")
def custom_sql_check(d: Data):
    return op.custom_sql_check(
        d.spark, """SELECT count_if(l.doc_id IS NULL) / CAST(count(*) AS DOUBLE)
                    FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON l.doc_id = d.doc_id""",
        **d.tables("documents", "labels"))


@register("WITH" + GRID + """
    SELECT event_id, CASE WHEN rule_type IN ('uniqueness', 'volume_compare') THEN actual < threshold ELSE actual > threshold END AS breach
    FROM grid""")
def breach(d: Data):
    return _grid(d).select("event_id", breach_of("rule_type", "actual", "threshold").alias("breach"))


@register("WITH" + GRID + """
    SELECT event_id, CASE WHEN abs(actual - threshold) / greatest(threshold, 0.01::DOUBLE) > 2 THEN 'error'
                WHEN abs(actual - threshold) / greatest(threshold, 0.01::DOUBLE) > 1 THEN 'warn' ELSE 'info' END AS level FROM grid""")
def alert_level(d: Data):
    return _grid(d).select("event_id", level_of("actual", "threshold").alias("level"))


@register("WITH" + GRID + """
    SELECT event_id, printf('%s, %s: measured %s of %.4f, which is %s the limit of %.4f', 'events',
           coalesce(target_column, '(whole table)'), rule_type, actual,
           CASE WHEN rule_type IN ('uniqueness', 'volume_compare') THEN 'below' ELSE 'above' END, threshold) AS message FROM grid""")
def alert_message(d: Data):
    return _grid(d).select("event_id", message_of(
        F.lit("events"), "target_column", "rule_type", "actual", "threshold").alias("message"))


@register("WITH" + MEASURED + " SELECT * FROM results", ("rules",))
def quality_results(d: Data):
    return op.quality_results(d.spark, _rules(d), d.table, at=CHECKED_AT)


@register("WITH" + MEASURED + """, runs AS (SELECT r.status, DATE '2024-02-01' + CAST(n AS INTEGER) AS day, n FROM results r, range(3) t(n) WHERE r.rule_id >= n)
    SELECT CAST(day AS DATE) AS day, count(*) AS checks, count(*) FILTER (status = 'pass') AS passed,
           count(*) FILTER (status = 'pass') / count(*)::DOUBLE AS pass_rate FROM runs GROUP BY day""", ("rules",))
def quality_trend_of_results(d: Data):
    """The trend of kept results: three daily runs, each with one rule less."""
    path, rules = fresh_path(d.spark, "results"), _rules(d)
    for day in range(3):
        results = op.quality_results(d.spark, rules[day:], d.table, at=f"2024-02-0{day + 1} 06:00:00")
        results.write.mode("append").parquet(path)
    return op.quality_trend(d.spark.read.parquet(path), "checked_at", F.col("status") == "pass")


@register("WITH" + MEASURED + " SELECT * FROM results WHERE target_table = 'lineitem'", ("rules",))
def write_checked(d: Data):
    """Results of the rows that a write has seen; its uniqueness rule reads them once more."""
    return op.write_checked(d.table("lineitem"), fresh_path(d.spark, "checked"), _rules(d), "lineitem", at=CHECKED_AT)


@register("""
    WITH counted AS (
      SELECT 'l_orderkey' AS name, count(*) AS rows, count(DISTINCT l_orderkey) AS exact FROM lineitem UNION ALL
      SELECT 'l_partkey', count(*), count(DISTINCT l_partkey) FROM lineitem UNION ALL
      SELECT 'l_suppkey', count(*), count(DISTINCT l_suppkey) FROM lineitem)
    SELECT name, rows, exact, true AS within FROM counted""")
def merge_sketches(d: Data):
    """Distinct counts of a grown table from kept sketches: the last two years' partitions come later."""
    path, names = fresh_path(d.spark, "sketches"), ["l_orderkey", "l_partkey", "l_suppkey"]
    lines = d.table("lineitem").withColumn("year", F.year("l_shipdate"))
    late = F.col("year") >= 1997
    for part in (lines.where(~late), lines.where(late)):
        sketches.sketch_columns(part, names, "year").write.mode("append").parquet(path)
    merged = sketches.merge_sketches(d.spark.read.parquet(path))
    exact = lines.agg(*[F.count_distinct(name).alias(name) for name in names])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("exact")) for name in names])))
    within = F.abs(F.col("distinct_values") - F.col("exact")) <= F.col("exact") * sketches.MOST_ERROR
    return merged.join(exact, "name").select("name", "rows", "exact", within.alias("within"))


@register("WITH" + MEASURED + " SELECT * FROM results WHERE status = 'fail'", ("rules",))
def run_checks(d: Data):
    return op.run_checks(d.spark, _rules(d), d.table, at=CHECKED_AT)


@register("WITH" + MEASURED + """
    SELECT rule_id, rule_type, layer, target_table, target_column, actual, threshold, status, level FROM results WHERE status = 'fail'
    UNION ALL SELECT 90, 'null_rate', 'ods', 'orders', 'no_such_column', -1, 0.1, 'error', 'error'""", ("rules",))
def run_checks_bad_rule(d: Data):
    """A rule on a missing column reports itself; all other rules still run."""
    return op.run_checks(d.spark, [*_rules(d), MISSING_COLUMN], d.table).drop("message", "checked_at")


@register("WITH" + MEASURED + """
    SELECT rule_id, rule_type, layer, target_table, target_column, actual, threshold, status, level FROM results WHERE status = 'fail'
    UNION ALL SELECT 91, 'range_check', 'ods', 'orders', NULL, -1, 0.1, 'error', 'error'""", ("rules",))
def run_checks_failing_rule(d: Data):
    """A rule that fails while running takes its table's shared aggregate apart, not the run."""
    return op.run_checks(d.spark, [*_rules(d), RUNTIME_ERROR], d.table, isolate_runtime=True).drop("message", "checked_at")


@register("WITH" + MEASURED + " SELECT * FROM results WHERE status = 'fail' AND layer = 'dwd'", ("rules",))
def run_checks_for_layer(d: Data):
    return op.run_checks_for_layer(d.spark, _rules(d), "dwd", d.table, at=CHECKED_AT)


@register("WITH" + MEASURED + " SELECT * FROM results WHERE status = 'fail' AND rule_id = 6", ("rules",))
def run_check(d: Data):
    return op.run_check(d.spark, _rules(d), 6, d.table, at=CHECKED_AT)


@register("SELECT * FROM alerts QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY triggered_at DESC, id DESC) = 1", ("alerts",))
def latest_alert_per_rule(d: Data):
    return op.latest_alert_per_rule(d.fixture("alerts"))


@register("""
    WITH latest AS (SELECT * FROM alerts QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY triggered_at DESC, id DESC) = 1)
    SELECT r.rule_id, CASE WHEN NOT enabled THEN 'disabled' WHEN NOT resolved THEN 'failing' ELSE 'passing' END AS status,
           triggered_at AS last_alert_at
    FROM rules r LEFT JOIN latest l ON l.rule_id = r.rule_id""", ("rules", "alerts"))
def rule_status(d: Data):
    return op.rule_status(d.fixture("rules"), d.fixture("alerts"))


@register("""
    SELECT r.rules, a.open_alerts,
           CAST(greatest(0, floor((r.rules - a.open_alerts) * 100 / r.rules + 0.5)) AS BIGINT) AS pass_rate
    FROM (SELECT count(*) AS rules FROM rules) r, (SELECT count(*) FILTER (NOT resolved) AS open_alerts FROM alerts) a""", ("rules", "alerts"))
def pass_rate(d: Data):
    return op.pass_rate(d.fixture("rules"), d.fixture("alerts"))


@register("""
    SELECT CAST(ts AS DATE) AS day, count(*) AS checks, count(*) FILTER (event_type <> 'error') AS passed,
           count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE AS pass_rate FROM events GROUP BY 1""")
def quality_trend(d: Data):
    return op.quality_trend(d.table("events"), "ts", F.col("event_type") != "error")


@register("""
    SELECT count(*) AS checks, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed,
           count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE AS pass_rate FROM events""")
def quality_totals(d: Data):
    return op.quality_totals(d.table("events"), F.col("event_type") != "error")


@register("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_results(d: Data):
    return op.recent_results(d.table("events").select("event_id", "ts", "event_type"), "ts", "event_id")


@register("SELECT * FROM alerts WHERE level = 'error' AND NOT resolved", ("alerts",))
def search_alerts(d: Data):
    return op.search_alerts(d.fixture("alerts"), level="error", resolved=False)
