"""Ad-hoc queries, reports, history: the SQL words of the query editor."""

from strata.plans import reports as op
from strata.plans.registry import Data, register

DAILY = """
    SELECT CAST(o_orderdate AS DATE) AS dt, count(DISTINCT o_orderkey) AS orders, count(*) AS lines,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS amount
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey %s GROUP BY CAST(o_orderdate AS DATE)"""

EDITOR = {
    "select_filter": """
        SELECT o_orderkey, o_totalprice AS price FROM {orders}
        WHERE (o_totalprice > 150000 AND NOT o_orderstatus = 'F') OR o_orderpriority IS NULL AND o_custkey IS NOT NULL""",
    "inner_join": "SELECT o.o_orderkey, c.c_name FROM {orders} o INNER JOIN {customer} c ON o.o_custkey = c.c_custkey",
    "left_join": """
        SELECT d.doc_id, d.source, l.quality FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "right_join": """
        SELECT d.doc_id, l.toxic, d.n_chars FROM {labels} l RIGHT JOIN {documents} d ON l.doc_id = d.doc_id""",
    "group_having": """
        SELECT l_returnflag, l_linestatus, COUNT(*) AS lines, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
               CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_quantity) AS mean_quantity,
               MIN(l_extendedprice) AS smallest, MAX(l_extendedprice) AS largest
        FROM {lineitem} GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10""",
    "average": "SELECT l_linenumber, AVG(CAST(l_linenumber AS DOUBLE)) AS mean FROM {lineitem} GROUP BY l_linenumber",
    "distinct_rows": "SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}",
    "top_rows": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "common_table": """
        WITH monthly AS (
          SELECT year(o_orderdate) * 100 + month(o_orderdate) AS ym, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total
          FROM {orders} GROUP BY year(o_orderdate) * 100 + month(o_orderdate))
        SELECT CAST(ym AS BIGINT) AS ym, CAST(total AS DOUBLE) AS total FROM monthly
        WHERE CAST(total AS DOUBLE) > (SELECT CAST(SUM(total) AS DOUBLE) / COUNT(*) FROM monthly)""",
    "case_when": """
        SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END AS band
        FROM {orders}""",
}

TABLES_OF = {
    "select_filter": ("orders",), "inner_join": ("orders", "customer"), "left_join": ("documents", "labels"),
    "right_join": ("documents", "labels"), "group_having": ("lineitem",), "average": ("lineitem",),
    "distinct_rows": ("customer",), "top_rows": ("orders",), "common_table": ("orders",), "case_when": ("orders",),
}


def _twin(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


def _register_editor(name: str):
    def build(d: Data):
        return op.run_query(d.spark, EDITOR[name], **d.tables(*TABLES_OF[name]))

    build.__name__ = f"sql_{name}"
    register(_twin(EDITOR[name]))(build)


for _name in EDITOR:
    _register_editor(_name)


@register("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC")
def adhoc_query(d: Data):
    sql = "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} ORDER BY o_orderkey DESC"
    return op.adhoc_query(d.spark, sql, orders=d.table("orders")).rows


@register("""
    SELECT event_id, value, (SELECT count(*) > 500 FROM events) AS truncated FROM (
      SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 500)""")
def capped(d: Data):
    return op.capped(d.table("events").select("event_id", "value").orderBy("value", "event_id", ascending=[False, True]), 500)


@register(_twin(DAILY % "") + " ORDER BY dt")
def report_data(d: Data):
    report = op.Report(1, DAILY % "" + " ORDER BY dt", published=True)
    return op.report_data(d.spark, report, **d.tables("lineitem", "orders")).rows


@register(_twin(DAILY % "WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'")
          + " ORDER BY dt")
def report_data_params(d: Data):
    report = op.Report(2, DAILY % "WHERE o_orderdate >= :start AND o_orderdate < :stop" + " ORDER BY dt", True, ("start", "stop"))
    return op.report_data(d.spark, report, {"start": "1996-01-01 00:00:00", "stop": "1999-01-01 00:00:00"},
                          **d.tables("lineitem", "orders")).rows


@register("SELECT * FROM hist WHERE user_id = 3 ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20", ("hist",))
def history_page(d: Data):
    return op.history_page(d.fixture("hist"), 3, page=1)


@register("SELECT * FROM hist WHERE status = 'failed'", ("hist",))
def history_by_status(d: Data):
    return op.history_by_status(d.fixture("hist"), "failed")
