import pytest
from conftest import rows_of

from strata.plans import reports as op


@pytest.fixture
def t(make):
    return make([(i, i % 3) for i in range(20)], "id int, k int")


@pytest.mark.parametrize("sql", [
    "INSERT INTO x VALUES (1)", "DROP TABLE x", "CREATE TABLE x (a int)", "DELETE FROM x", "UPDATE x SET a = 1", "TRUNCATE TABLE x",
    "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "SET spark.x = 1", "USE default", "SELECT 1) AS r; DROP TABLE x --",
    "ALTER TABLE x RENAME TO y", "",
])
def test_only_one_reading_statement(spark, sql):
    with pytest.raises(Exception):
        op.run_query(spark, sql).collect()


def test_queries_with_comments_and_closing_semicolon(spark, t):
    assert rows_of(op.run_query(spark, "SELECT count(*) AS n FROM {t} -- all rows\n;", t=t)) == [(20,)]
    assert rows_of(op.run_query(spark, "SELECT ';' AS s", )) == [(";",)]


def test_catalog_statements(spark, t):
    t.createOrReplaceTempView("report_rows")
    assert "report_rows" in {row.tableName for row in op.run_query(spark, "SHOW TABLES").collect()}
    assert [row.col_name for row in op.run_query(spark, "DESCRIBE report_rows").collect()] == ["id", "k"]
    assert "Physical Plan" in op.run_query(spark, "EXPLAIN SELECT * FROM report_rows").first()[0]


def test_row_caps(spark, t):
    assert op.adhoc_query(spark, "SELECT * FROM {t}", t=t).rows.count() == 20
    assert op.adhoc_query(spark, "SELECT * FROM {t}", t=t).rows.columns == ["id", "k"]
    assert [row.truncated for row in op.adhoc_query(spark, "SELECT * FROM {t}", 5, t=t).rows.collect()] == [True] * 5
    assert [row.truncated for row in op.adhoc_query(spark, "SELECT * FROM {t}", 20, t=t).rows.collect()] == [False] * 20
    assert op.capped(t, 0).count() == 0 and op.capped(t.limit(0), 3).count() == 0
    assert rows_of(op.capped(t.orderBy("id"), 2)) == [(0, 0, True), (1, 1, True)]
    assert {row.truncated for row in op.capped(t, 20).collect()} == {False}


def test_order_of_the_query_is_kept(spark, t):
    assert [row.id for row in op.adhoc_query(spark, "SELECT id FROM {t} ORDER BY id DESC", 3, t=t).rows.collect()] == [19, 18, 17]


def test_reports(spark, t):
    draft = op.Report(1, "SELECT * FROM {t}")
    with pytest.raises(ValueError):
        op.report_data(spark, draft, t=t)
    report = op.Report(2, "SELECT id FROM {t} WHERE k = :k AND id < :top", True, ("k", "top"))
    assert rows_of(op.report_data(spark, report, {"k": 1, "top": 8}, t=t).rows) == [(1,), (4,), (7,)]
    with pytest.raises(ValueError):
        op.report_data(spark, report, {"other": 1}, t=t)
    assert op.report_data(spark, report, {"k": "1 OR 1 = 1", "top": 8}, t=t).rows.columns == ["id"]


def test_pages(make):
    hist = make([(i, 1 + i % 2, i // 4) for i in range(12)], "id int, user_id int, created_at int")
    assert [row.id for row in op.history_page(hist, 1, 0, 4).collect()] == [10, 8, 6, 4]
    assert [row.id for row in op.history_page(hist, 1, 1, 4).collect()] == [2, 0]
    assert op.history_page(hist, 1, 0, 500).count() == 6 and op.history_page(hist, 1, 9, 500).count() == 0
    assert [row.id for row in op.history_page(hist, 1, size=3, after=(1, 6)).collect()] == [4, 2, 0]
    for page, size in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            op.history_page(hist, 1, page, size)
