"""Inputs derived from the given tables: plain SELECTs that run in Spark and in the twin engine.

Table names stand in braces, so that Spark binds them to DataFrames. Text that differs between the
engines (one column list per row) has a version for each.
"""

from __future__ import annotations

import re

BOTH = {
    "chg": """
        SELECT user_id AS id, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
               event_type AS status, value AS amount, ts AS event_time
        FROM {events}""",
    "snap": """
        SELECT user_id AS table_id, event_id AS snapshot_id, event_id % 3 AS schema_id,
               CASE event_type WHEN 'error' THEN 'COMPACT' WHEN 'purchase' THEN 'OVERWRITE' ELSE 'APPEND' END AS commit_kind,
               ts AS commit_time, CAST(floor(value) AS BIGINT) AS delta_records,
               CAST(floor(value) AS BIGINT) * 10 AS total_records
        FROM {events}""",
    "tbl": """
        SELECT p.p_partkey AS id,
               CASE p.p_partkey % 4 WHEN 0 THEN 'ods' WHEN 1 THEN 'dwd' WHEN 2 THEN 'dws' ELSE 'ads' END AS layer,
               concat(CASE p.p_partkey % 4 WHEN 0 THEN 'ods' WHEN 1 THEN 'dwd' WHEN 2 THEN 'dws' ELSE 'ads' END, '_', CAST(p.p_size % 5 AS VARCHAR(8))) AS db,
               concat(replace(p.p_name, ' ', '_'), '_', CAST(p.p_partkey AS VARCHAR(20))) AS table_name,
               CASE WHEN p.p_partkey % 50 <> 0 THEN l.files END AS file_count, l.bytes AS total_size_bytes, l.recs AS record_count
        FROM {part} p LEFT JOIN (
          SELECT l_partkey, count(*) * 7 - 60 AS files, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes,
                 CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS recs
          FROM {lineitem} GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey""",
    "tbl_next": """
        SELECT p_partkey + 1000000000 AS id, CAST(NULL AS VARCHAR(8)) AS layer,
               concat(CASE p_partkey % 4 WHEN 0 THEN 'ods' WHEN 1 THEN 'dwd' WHEN 2 THEN 'dws' ELSE 'ads' END, '_', CAST(p_size % 5 AS VARCHAR(8))) AS db,
               concat(replace(p_name, ' ', '_'), CASE WHEN p_size > 40 THEN '_v2_' ELSE '_' END, CAST(p_partkey AS VARCHAR(20))) AS table_name,
               CASE WHEN p_size > 10 THEN CAST(p_size AS BIGINT) END AS file_count,
               CAST(floor(p_retailprice) AS BIGINT) AS total_size_bytes, CAST(p_size AS BIGINT) * 3 AS record_count
        FROM {part}""",
    "edge": """
        SELECT concat('order:', CAST(o_orderkey AS VARCHAR(20))) AS src, concat('customer:', CAST(o_custkey AS VARCHAR(20))) AS dst, 'cdc_sync' AS lineage_type FROM {orders}
        UNION ALL
        SELECT concat('customer:', CAST(c_custkey AS VARCHAR(20))), concat('nation:', CAST(c_nationkey AS VARCHAR(20))), 'etl_transform' FROM {customer}
        UNION ALL
        SELECT concat('nation:', CAST(n_nationkey AS VARCHAR(20))), concat('region:', CAST(n_regionkey AS VARCHAR(20))), 'materialized' FROM {nation}""",
    "hist": """
        SELECT event_id AS id, user_id,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'success' END AS status,
               CASE event_id % 3 WHEN 0 THEN 'compact' WHEN 1 THEN 'expire' ELSE 'orphan' END AS operation,
               CAST(floor(value) AS BIGINT) AS duration_ms, ts AS created_at
        FROM {events}""",
    "tasklog": """
        SELECT user_id AS task_id, event_id AS seq,
               CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'RESTARTING' WHEN 'error' THEN 'FAILED'
                    WHEN 'purchase' THEN 'FINISHED' ELSE 'CREATED' END AS job_state,
               CASE WHEN event_id % 2 = 1 THEN concat('job', CAST(user_id AS VARCHAR(20))) END AS job_id,
               CAST(floor(value) AS BIGINT) AS lag_ms, ts AS at_time
        FROM {events}""",
    "alerts": """
        SELECT event_id AS id, event_id % 12 AS rule_id,
               CASE event_id % 4 WHEN 0 THEN 'null_rate' WHEN 1 THEN 'uniqueness' WHEN 2 THEN 'volume_compare' ELSE 'range_check' END AS rule_type,
               CASE WHEN value > 200 THEN 'error' WHEN value > 100 THEN 'warn' ELSE 'info' END AS level,
               value AS actual_value, event_id % 3 = 0 AS resolved, ts AS triggered_at
        FROM {events} WHERE event_type IN ('error', 'purchase')""",
    "rules": """
        SELECT CAST(rule_id AS BIGINT) AS rule_id, rule_type, layer, target_table, target_column,
               CAST(threshold AS DOUBLE) AS threshold, expression, enabled
        FROM (VALUES
          (0, 'range_check', 'dwd', 'lineitem', CAST(NULL AS VARCHAR(40)), 0.10, 'l_discount BETWEEN 0.02 AND 0.08', true),
          (1, 'uniqueness', 'dwd', 'lineitem', 'l_orderkey', 0.95, CAST(NULL AS VARCHAR(80)), true),
          (2, 'volume_compare', 'ods', 'orders', CAST(NULL AS VARCHAR(40)), 20000.0, CAST(NULL AS VARCHAR(80)), true),
          (3, 'null_rate', 'ods', 'events', 'value', 0.05, CAST(NULL AS VARCHAR(80)), true),
          (4, 'range_check', 'ods', 'orders', CAST(NULL AS VARCHAR(40)), 0.20, 'o_totalprice >= 50000', true),
          (5, 'uniqueness', 'ods', 'customer', 'c_custkey', 1.0, CAST(NULL AS VARCHAR(80)), true),
          (6, 'uniqueness', 'ods', 'customer', 'c_nationkey', 0.50, CAST(NULL AS VARCHAR(80)), true),
          (7, 'null_rate', 'dws', 'orders', 'o_custkey', 0.0, CAST(NULL AS VARCHAR(80)), false)
        ) AS t(rule_id, rule_type, layer, target_table, target_column, threshold, expression, enabled)""",
    "health": """
        SELECT event_id AS seq, CAST(floor(event_id / 20) AS BIGINT) AS check_id,
               CASE user_id % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'engine' ELSE 'store' END AS component,
               CASE event_type WHEN 'error' THEN 'unreachable' WHEN 'signup' THEN 'unknown' ELSE 'healthy' END AS status,
               ts AS checked_at
        FROM {events}""",
    "alert_rules": """
        SELECT CAST(rule_id AS BIGINT) AS rule_id, rule_type, expression, channels, enabled FROM (VALUES
          (1, 'task_failure', '0', 'email', true),
          (2, 'data_delay', '150ms', 'dingtalk,wecom', true),
          (3, 'quality_failure', '', 'email,wecom', true),
          (4, 'data_delay', '5000ms', 'email', false)
        ) AS t(rule_id, rule_type, expression, channels, enabled)""",
}

_COLS = """
        SELECT p_partkey AS table_id, concat('c', CAST(i AS VARCHAR(4))) AS name, 'int' AS type,
               CASE WHEN p_partkey % 2 = 0 THEN 'note' ELSE '' END AS comment,
               concat('src_', CAST(i AS VARCHAR(4))) AS source_column, i AS sort_order
        FROM ({numbered}) n"""
_COLS_NEXT = """
        SELECT p_partkey AS table_id,
               concat(CASE WHEN (p_partkey + i) % 5 = 2 THEN 'x' ELSE 'c' END, CAST(i AS VARCHAR(4))) AS name,
               CASE WHEN (p_partkey * i) % 11 = 3 THEN 'bigint' ELSE 'int' END AS type,
               CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE ' ' END AS comment,
               CAST(NULL AS VARCHAR(8)) AS source_column,
               CASE WHEN p_partkey % 7 = 1 THEN i + 10 ELSE i END AS sort_order
        FROM ({numbered}) n"""
_SPARK_NUMBERED = "SELECT p_partkey, explode(sequence(0, 4)) AS i FROM {part}"
_TWIN_NUMBERED = "SELECT p_partkey, CAST(unnest(range(5)) AS INTEGER) AS i FROM {part}"

SPARK_ONLY = {
    "cols": _COLS.replace("{numbered}", _SPARK_NUMBERED),
    "cols_next": _COLS_NEXT.replace("{numbered}", _SPARK_NUMBERED),
}
TWIN_ONLY = {
    "cols": _COLS.replace("{numbered}", _TWIN_NUMBERED),
    "cols_next": _COLS_NEXT.replace("{numbered}", _TWIN_NUMBERED),
}

INPUTS = {name: sorted(set(re.findall(r"\{(\w+)\}", text))) for name, text in (BOTH | SPARK_ONLY).items()}

NOW = "2024-01-31 00:00:00"


def twin_sql(name: str) -> str:
    text = TWIN_ONLY.get(name, BOTH.get(name))
    return re.sub(r"\{(\w+)\}", r"\1", text)


def with_inputs(sql: str, names: tuple[str, ...]) -> str:
    """``sql`` with the derived inputs as common table expressions in front."""
    if not names:
        return sql
    inputs = ", ".join(f"{name} AS ({twin_sql(name)})" for name in names)
    body = sql.strip()
    own = re.match(r"WITH(\s+RECURSIVE)?\s", body)
    if not own:
        return f"WITH {inputs} {body}"
    return f"WITH{own.group(1) or ''} {inputs}, {body[own.end():]}"
