"""Lineage over edges derived from orders, customers and nations."""

from pyspark.sql import functions as F

from strata.operators import lineage as op
from strata.plans.registry import Data, register
from strata.sources.mappings import parse_mappings


@register("""
    SELECT concat('t', c_custkey) AS src, concat('ods.c', c_custkey) AS dst, CAST(c_nationkey AS BIGINT) AS task_id, 'cdc_sync' AS lineage_type
    FROM customer WHERE c_mktsegment <> 'MACHINERY'
    UNION ALL SELECT concat('ods.c', o_custkey), concat('dwd.o', o_orderkey), o_orderkey, 'etl_transform' FROM orders""")
def lineage_edges(d: Data):
    item = F.struct(
        F.concat(F.lit("t"), "c_custkey").alias("sourceTable"), F.concat(F.lit("c"), "c_custkey").alias("targetTable"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "never").alias("syncMode"))
    mappings = parse_mappings(d.table("customer").select(
        F.col("c_nationkey").cast("bigint").alias("task_id"), F.to_json(F.array(item)).alias("body")), "body")
    transforms = d.table("orders").select(
        F.concat(F.lit("ods.c"), "o_custkey").alias("src"), F.concat(F.lit("dwd.o"), "o_orderkey").alias("dst"),
        F.col("o_orderkey").alias("task_id"), F.lit("etl_transform").alias("lineage_type"))
    return op.lineage_edges(mappings, transforms)


@register("""
    SELECT DISTINCT src, concat('task:', task) AS dst, lineage_type FROM (
      SELECT concat('c', o_custkey) AS src, concat('p', o_orderstatus) AS dst, o_orderpriority AS task, 'etl_transform' AS lineage_type FROM orders)
    UNION ALL
    SELECT DISTINCT concat('task:', o_orderpriority), concat('p', o_orderstatus), 'etl_transform' FROM orders""")
def task_hops(d: Data):
    return op.task_hops(d.table("orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "o_orderstatus").alias("dst"),
        F.col("o_orderpriority").alias("task_id"), F.lit("etl_transform").alias("lineage_type")))


@register("""
    SELECT dst AS node, src AS neighbour, lineage_type, 'upstream' AS direction FROM edge WHERE starts_with(dst, 'customer:')
    UNION ALL SELECT src, dst, lineage_type, 'downstream' FROM edge
    WHERE src IN (SELECT concat('customer:', c_custkey) FROM customer)""", ("edge",))
def neighbours(d: Data):
    return op.neighbours(d.fixture("edge"), d.table("customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("node")))


REACH = """
    WITH RECURSIVE walk AS (
      SELECT concat('region:', r_regionkey) AS node, 0 AS depth FROM region
      UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edge e ON e.dst = w.node)
    SELECT node, min(depth) AS depth FROM walk GROUP BY node"""


@register(REACH, ("edge",))
def reachable(d: Data):
    regions = d.table("region").select(F.concat(F.lit("region:"), "r_regionkey").alias("node"))
    return op.reachable(d.fixture("edge"), regions, "upstream")


@register("""
    SELECT e.* FROM edge e WHERE (starts_with(src, 'order:') OR starts_with(src, 'customer:')) AND starts_with(dst, 'customer:')""", ("edge",))
def lineage_for_layer(d: Data):
    edges = d.fixture("edge")
    names = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    kind = F.substring_index("node", ":", 1)
    nodes = names.select(
        "node", F.when(kind == "order", "source").otherwise("table").alias("node_type"),
        F.when(kind == "customer", "ods").when(kind == "nation", "dwd").otherwise("dws").alias("layer"))
    return op.lineage_for_layer(nodes, edges, "ods")[1]
