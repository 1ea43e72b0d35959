"""Sources and sinks over the given tables."""

import uuid

from pyspark.sql import functions as F

from strata.plans.registry import Data, register
from strata.session import fresh_path
from strata.sources.conform import conform_types as conform
from strata.sources.export import csv_lines as lines
from strata.sources.export import json_safe as safe
from strata.sources.mappings import parse_mappings as parse
from strata.sources.mappings import sync_tables as sync
from strata.sources.tables import write_table as write

DECLARED = {
    "l_orderkey": "BIGINT", "l_partkey": "MEDIUMINT", "l_linenumber": "SMALLINT", "l_quantity": "VARCHAR",
    "l_extendedprice": "DECIMAL(15,2)", "l_discount": "FLOAT", "l_tax": "DOUBLE", "l_returnflag": "CHAR",
    "l_shipdate": "DATETIME",
}


@register("""
    SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS l_quantity,
           CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE) AS l_extendedprice,
           CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS l_discount, l_tax, l_returnflag,
           date_trunc('millisecond', l_shipdate) AS l_shipdate, l_suppkey, l_linestatus
    FROM lineitem""")
def conform_types(d: Data):
    return conform(d.table("lineitem"), DECLARED).withColumns({
        "l_extendedprice": F.col("l_extendedprice").cast("double"), "l_discount": F.col("l_discount").cast("double")})


@register("SELECT * REPLACE (date_trunc('millisecond', ts) AS ts) FROM events")
def conform_timestamps(d: Data):
    return conform(d.table("events"), {"event_id": "BIGINT", "ts": "TIMESTAMP(6)"})


@register("""
    WITH item AS (
      SELECT p_partkey, unnest([1, 2]) AS n, concat(replace(p_name, ' ', '_'), '_', p_partkey) AS name FROM part
    ), mapped AS (
      SELECT p_partkey, n, name,
             CASE WHEN p_partkey % 5 <> 0 THEN concat('dwd_', n) ELSE 'ods' END AS db,
             CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN concat(p_partkey, name) ELSE name END AS target,
             CASE WHEN p_partkey % 11 = 0 THEN 'once' WHEN n = 1 THEN 'incremental' ELSE 'full+incremental' END AS mode
      FROM item
    )
    SELECT p_partkey, name AS source_table, db AS target_db, target AS target_table, mode AS sync_mode,
           CASE WHEN target = '' THEN 'source and target table are required'
                WHEN mode = 'once' THEN 'unknown sync mode'
                WHEN NOT regexp_full_match(target, '[A-Za-z_][A-Za-z0-9_]*') THEN 'unsafe name' END AS error
    FROM mapped WHERE p_partkey % 17 <> 0
    UNION ALL
    SELECT p_partkey, NULL, 'ods', NULL, 'full+incremental', 'not a mapping list' FROM part WHERE p_partkey % 17 = 0""")
def parse_mappings(d: Data):
    key, name = F.col("p_partkey"), F.expr("concat(replace(p_name, ' ', '_'), '_', p_partkey)")
    target = F.when(key % 7 == 0, " ").when(key % 13 == 0, F.concat(key.cast("string"), name)).otherwise(name)

    def item(n: int, mode: str | None):
        return F.struct(
            F.concat(F.lit(" "), name).alias("sourceTable"),
            F.when(key % 5 != 0, f"dwd_{n}").alias("targetDb"), target.alias("targetTable"),
            F.when(key % 11 == 0, "once").otherwise(F.lit(mode).cast("string")).alias("syncMode"))

    text = F.when(key % 17 == 0, "{broken").otherwise(F.to_json(F.array(item(1, "incremental"), item(2, None))))
    return parse(d.table("part").select("p_partkey", text.alias("mappings")), "mappings")


@register("""
    SELECT 'ods.customer' AS table_name, count(*) AS rows_written FROM customer
    UNION ALL SELECT 'ods.orders', count(*) FROM orders
    UNION ALL SELECT 'dwd.lineitem', count(*) FROM lineitem""")
def sync_tables(d: Data):
    mappings = [
        {"source_table": "customer", "target_db": "ods", "target_table": "customer"},
        {"source_table": "orders", "target_db": "ods", "target_table": "orders"},
        {"source_table": "lineitem", "target_db": "dwd", "target_table": "lineitem"},
    ]
    written = sync(d.spark, mappings, d.table, declared={"lineitem": DECLARED}, keys={"customer": ["c_custkey"]},
                   location=fresh_path(d.spark, "sync"))
    counts = [d.spark.table(name).agg(F.count(F.lit(1)).alias("rows_written")).select(
        F.lit(name).alias("table_name"), "rows_written") for name in written]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


@register("""
    SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS l_quantity,
           CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE) AS l_extendedprice,
           CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS l_discount, l_tax, l_returnflag, l_linestatus,
           date_trunc('millisecond', l_shipdate) AS l_shipdate
    FROM lineitem""")
def sync_tables_rows(d: Data):
    """The rows of a synced table after the same table was named once more, then incrementally."""
    name = f"lineitem_{uuid.uuid4().hex}"
    mapping = {"source_table": "lineitem", "target_db": "dwd", "target_table": name}
    for mode in ("full+incremental", "incremental"):
        sync(d.spark, [{**mapping, "sync_mode": mode}], d.table, declared={"lineitem": DECLARED}, location=fresh_path(d.spark, "sync"))
    return d.spark.table(f"dwd.{name}").withColumns({
        "l_extendedprice": F.col("l_extendedprice").cast("double"), "l_discount": F.col("l_discount").cast("double")})


@register("""
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders""")
def write_table(d: Data):
    orders = d.table("orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.year("o_orderdate").alias("order_year"))
    return write(orders, "strata_check.orders_by_year", keys=["o_orderkey"], partition_by=["order_year"],
                 mode="overwrite", path=fresh_path(d.spark, "orders"))


@register("""
    SELECT concat('"', c_custkey, '","', replace(c_name, '"', '""'), '","', CASE WHEN c_nationkey <> 3 THEN c_nationkey END, '","',
                  c_acctbal, '","', CASE WHEN c_mktsegment = 'MACHINERY' THEN concat('a ""', c_mktsegment, '""') ELSE c_mktsegment END, '"') AS line
    FROM customer""")
def csv_lines(d: Data):
    rows = d.table("customer").select(
        "c_custkey", "c_name", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("c_nationkey"), "c_acctbal",
        F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit('a "'), "c_mktsegment", F.lit('"')))
        .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return lines(rows)


@register("""
    SELECT event_id, CAST(ts AS VARCHAR) AS ts, value, base64(encode(event_type)) AS type_bytes,
           value > 100 AS large, concat('["', event_type, '",null]') AS tags
    FROM events""")
def json_safe(d: Data):
    return safe(d.table("events").select(
        "event_id", "ts", "value", F.col("event_type").cast("binary").alias("type_bytes"),
        (F.col("value") > 100).alias("large"), F.array("event_type", F.lit(None)).alias("tags")))
