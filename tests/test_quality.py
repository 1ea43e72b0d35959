import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from strata.functions.quality import alert_level, breach
from strata.operators import quality as op
from strata.operators.quality import Rule


@pytest.fixture
def tables(make):
    data = {
        "t": make([(1, "a", 0.5), (1, "b", None), (2, None, 2.0), (None, "d", 0.1)], "a int, b string, c double"),
        "empty": make([], "a int, b string, c double"),
    }
    return lambda name: data[name]


def results(spark, rules, tables, **options):
    return {row.rule_id: row for row in op.quality_results(spark, rules, tables, **options).collect()}


def test_measures(spark, tables):
    found = results(spark, [
        Rule(1, "null_rate", "t", "a", 0.1), Rule(2, "uniqueness", "t", "a", 0.4),
        Rule(3, "volume_compare", "t", None, 5.0), Rule(4, "range_check", "t", None, 0.25, "c < 1"),
    ], tables)
    assert {key: (row.actual, row.status) for key, row in found.items()} == {
        1: (0.25, "fail"), 2: (0.5, "pass"), 3: (4.0, "fail"), 4: (0.25, "pass")}
    assert found[3].level == "info" and found[1].level == "warn"
    assert found[3].message == (
        "t, (whole table): measured volume_compare of 4.0000, which is below the limit of 5.0000")


def test_empty_table_has_no_rate_but_a_volume(spark, tables):
    found = results(spark, [Rule(1, "null_rate", "empty", "a", 0.1), Rule(2, "volume_compare", "empty", None, 1.0)], tables)
    assert (found[1].actual, found[1].status, found[1].level) == (None, "no_data", None)
    assert (found[2].actual, found[2].status) == (0.0, "fail")
    assert rows_of(op.run_checks(spark, [Rule(1, "null_rate", "empty", "a", 0.1)], tables)) == []


def test_rules_without_a_measure_are_left_out(spark, tables):
    rules = [Rule(1, "null_rate", "t", None), Rule(2, "range_check", "t"), Rule(3, "freshness", "t", "a"),
             Rule(4, "null_rate", "t", "a", enabled=False)]
    assert results(spark, rules, tables) == {}


def test_bad_rules_fail_alone(spark, tables, make):
    good = make([(1,)], "x int")
    def lookup(name):
        return good if name == "g" else spark.table("no_such_table_at_all") if name == "missing" else tables(name)
    found = results(spark, [
        Rule(1, "null_rate", "missing", "a"), Rule(2, "null_rate", "t", "nope"), Rule(3, "range_check", "t", None, 0.0, "c <"),
        Rule(4, "volume_compare", "g", None, 2.0), Rule(5, "custom_sql", "t", None, 0.5, "SELECT nothing FROM nowhere")], lookup)
    assert [found[i].status for i in range(1, 6)] == ["error", "error", "error", "fail", "error"]
    assert found[1].actual == -1.0 and found[1].level == "error"


def test_runtime_failure_is_isolated(spark, tables):
    rules = [Rule(1, "range_check", "t", None, 0.0, "1 / (a - a) > 0"), Rule(2, "volume_compare", "t", None, 5.0)]
    found = results(spark, rules, tables)
    assert found[1].status == "error" and "DIVIDE_BY_ZERO" in found[1].message and found[2].status == "fail"


def test_distinct_rules_are_counted_apart(spark, make):
    table = make([(i % 2, i % 3, i % 5, i % 7, i) for i in range(35)], "a int, b int, c int, d int, e int")
    rules = [Rule(i, "uniqueness", "w", column, 0.5) for i, column in enumerate("abcde")] + [Rule(9, "volume_compare", "w", None, 1.0)]
    found = results(spark, rules, lambda name: table)
    assert [round(found[i].actual * 35) for i in range(5)] == [2, 3, 5, 7, 35]
    plan = op.quality_results(spark, rules, lambda name: table, isolate_runtime=False)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_shared_scan(spark, tables):
    rules = [Rule(1, "null_rate", "t", "a"), Rule(2, "null_rate", "t", "b"), Rule(3, "range_check", "t", None, 0.0, "c < 1")]
    plan = op.quality_results(spark, rules, tables, isolate_runtime=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1


def test_custom_sql_rule_compares_like_any_other(spark, tables):
    found = results(spark, [Rule(1, "custom_sql", "t", None, 2.0, "SELECT 3 AS n")], tables)
    assert (found[1].actual, found[1].status) == (3.0, "fail")


def test_custom_checks_without_a_row_with_several_and_failing(spark, tables):
    texts = ["SELECT 1 AS n WHERE false", "SELECT id FROM range(2)", "SELECT 1 / (id - id) FROM range(1)", "DROP TABLE x", "SELECT 4;"]
    found = results(spark, [Rule(i, "custom_sql", "t", None, 2.0, text) for i, text in enumerate(texts)], tables)
    assert [found[i].status for i in range(5)] == ["no_data", "error", "error", "error", "fail"]


def test_one_bad_rule_of_many_is_found(spark, tables):
    rules = [Rule(i, "range_check", "t", None, 0.0, "1 / (a - a) > 0" if i == 5 else "a > 0") for i in range(8)]
    assert [i for i, row in results(spark, rules, tables).items() if row.status == "error"] == [5]


def test_alerts_of_a_run_feed_the_alert_reports(spark, tables):
    rules = [Rule(1, "volume_compare", "t", None, 1000.0), Rule(2, "volume_compare", "t", None, 0.0)]
    alerts = op.alert_rows(op.run_checks(spark, rules, tables), "2024-05-01 00:00:00").unionByName(
        op.alert_rows(op.run_checks(spark, rules[:1], tables), "2024-05-02 00:00:00"))
    rule_rows = spark.createDataFrame([(1, True), (2, True)], "rule_id bigint, enabled boolean")
    assert rows_of(op.rule_status(rule_rows, alerts), "rule_id", "status") == [(1, "failing"), (2, "passing")]
    assert op.latest_alert_per_rule(alerts).first()["triggered_at"].day == 2
    assert op.pass_rate(rule_rows, alerts).first().open_alerts == 2 and op.search_alerts(alerts, resolved=False).count() == 2


def test_single_rule_runs(spark, tables):
    rules = [Rule(1, "null_rate", "t", "a", 0.1, layer="ods"), Rule(2, "null_rate", "t", "b", 0.1, enabled=False)]
    assert op.run_check(spark, rules, 1, tables).count() == 1
    with pytest.raises(ValueError):
        op.run_check(spark, rules, 2, tables)
    with pytest.raises(ValueError):
        op.run_check(spark, rules, 3, tables)
    assert op.run_checks_for_layer(spark, rules, "dwd", tables).count() == 0


def test_breach_and_level_at_the_edges(make):
    df = make([("null_rate", 0.1, 0.1), ("uniqueness", 0.1, 0.1), ("null_rate", 0.3, 0.1), ("null_rate", 0.21, 0.1),
               ("null_rate", 0.02, 0.0), ("volume_compare", None, 1.0)], "t string, a double, b double")
    out = df.select("t", breach("t", "a", "b"), alert_level("a", "b")).collect()
    assert [tuple(row[1:]) for row in out] == [
        (False, "info"), (False, "info"), (True, "warn"), (True, "warn"), (True, "warn"), (None, None)]


def test_pass_rate_never_below_zero_and_full_without_rules(make):
    alerts = make([(i, 1, False) for i in range(5)], "id int, rule_id int, resolved boolean")
    rules = make([(1, True), (2, True)], "rule_id int, enabled boolean")
    assert op.pass_rate(rules, alerts).first().pass_rate == 0
    assert op.pass_rate(rules.where("false"), alerts).first().pass_rate == 100
    assert op.pass_rate(rules, alerts.limit(1)).first().pass_rate == 50


def test_rule_status_without_alerts_passes(make):
    alerts = make([(1, 1, True, 5), (2, 1, False, 5), (3, 2, True, 9)], "id int, rule_id int, resolved boolean, triggered_at int")
    rules = make([(1, True), (2, True), (3, True), (4, False)], "rule_id int, enabled boolean")
    assert rows_of(op.rule_status(rules, alerts), "rule_id", "status") == [
        (1, "failing"), (2, "passing"), (3, "passing"), (4, "disabled")]


def test_search_any_value(make):
    alerts = make([(1, "info", 3), (2, "error", 1), (3, "info", 2)], "id int, level string, triggered_at int")
    assert [row.id for row in op.search(alerts, "triggered_at", "id").collect()] == [1, 3, 2]
    assert [row.id for row in op.search(alerts, "triggered_at", "id", level="info").collect()] == [1, 3]
    assert op.search_rules(alerts.withColumn("layer", F.lit("ods")), layer="dwd").count() == 0
