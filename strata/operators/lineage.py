"""Lineage between tables: edges, neighbours, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strata.session import fresh_path, written

# Kinds of lineage edges.
LINEAGE_TYPES = ("cdc_sync", "etl_transform", "materialized")


def lineage_edges(mappings: DataFrame, etl_edges: DataFrame | None = None, task: str = "task_id") -> DataFrame:
    """Edges (src, dst, task, lineage_type) of parsed table mappings and of declared transforms."""
    synced = mappings.where(F.col("error").isNull()).select(
        F.col("source_table").alias("src"), F.concat_ws(".", "target_db", "target_table").alias("dst"),
        F.col(task).alias("task_id"), F.lit(LINEAGE_TYPES[0]).alias("lineage_type"))
    return synced.unionByName(etl_edges) if etl_edges is not None else synced


def task_hops(edges: DataFrame) -> DataFrame:
    """The same edges as a graph source table -> task -> target table."""
    step = F.concat(F.lit("task:"), F.col("task_id").cast("string"))
    hops = F.array(F.struct(F.col("src"), step.alias("dst")), F.struct(step.alias("src"), F.col("dst")))
    return edges.select(F.explode(hops).alias("h"), "lineage_type").select("h.src", "h.dst", "lineage_type").distinct()


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Direct upstream and downstream nodes of every node in ``nodes`` (column ``node``)."""
    nodes = nodes.select("node").distinct()

    def side(own: str, other: str, direction: str) -> DataFrame:
        return edges.select(F.col(own).alias("node"), F.col(other).alias("neighbour"), "lineage_type").join(
            nodes, "node", "left_semi").withColumn("direction", F.lit(direction))

    return side("dst", "src", "upstream").unionByName(side("src", "dst", "downstream"))


FRONTIER_ROUNDS = 4  # rounds that go on step by step before hops are doubled


def reachable(edges: DataFrame, roots: DataFrame, direction: str = "downstream", max_depth: int | None = None,
              frontier_rounds: int = FRONTIER_ROUNDS) -> DataFrame:
    """All nodes that can be reached from the roots (column ``node``), with the fewest steps.

    The first rounds go step by step: the newest nodes join the edges, and nodes seen before are taken out. Then
    hops are doubled: ``hops`` has the pairs that exactly 1, 2, 4, ... steps connect, and joins itself, while the nodes
    found so far join it, so a chain of n further tables takes log2(n) rounds. A node's depth is the least one that
    any round gives. Every round becomes a table in the shared folder: plans stay short, a lost executor costs one
    round at most, and the planner knows the size of each round. A cycle ends because no node is new.
    """
    if direction not in ("downstream", "upstream"):
        raise ValueError(f"unknown direction: {direction}")
    own, other = ("src", "dst") if direction == "downstream" else ("dst", "src")
    spark = edges.sparkSession
    base = fresh_path(spark, "reachable")
    node = roots.select("node").schema
    # Two columns, written once: rounds read them instead of deriving the edges from their sources again.
    steps = written(edges.select(F.col(own).alias("node"), F.col(other).alias("next")).distinct(), "steps")

    def keep(found: DataFrame, depth: int) -> DataFrame:
        found.write.parquet(f"{base}/depth={depth}")
        return spark.read.schema(node).parquet(f"{base}/depth={depth}")

    def seen() -> DataFrame:
        return spark.read.schema(StructType([*node.fields, StructField("depth", IntegerType())])).parquet(base)

    depth = 0
    frontier = keep(roots.select("node").distinct(), depth)
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        if depth == frontier_rounds:
            return _doubled(steps, seen(), frontier, depth, max_depth)
        depth += 1
        found = steps.join(frontier, "node").select(F.col("next").alias("node")).distinct()
        frontier = keep(found.join(seen(), "node", "left_anti"), depth)
    return seen()


def _doubled(steps: DataFrame, seen: DataFrame, frontier: DataFrame, depth: int, max_depth: int | None) -> DataFrame:
    """``seen`` with all nodes beyond the ``frontier``, which lies at ``depth``, by doubled hops."""
    past = seen.where(F.col("depth") < depth).select("node")
    # Nothing new lies behind nodes that were passed before.
    hops = written(steps.join(past, "node", "left_anti").join(past.withColumnRenamed("node", "next"), "next", "left_anti")
                   .select("node", "next"), "hops")
    reached, width = written(frontier.select("node", F.lit(depth).alias("depth")), "reached"), 1
    while (max_depth is None or depth + width <= max_depth) and not hops.isEmpty():
        further = reached.join(hops, "node").select(F.col("next").alias("node"), (F.col("depth") + width).alias("depth"))
        if max_depth is not None:
            further = further.where(F.col("depth") <= max_depth)
        nearest = written(reached.unionByName(further).groupBy("node").agg(F.min("depth").alias("depth")), "reached")
        # Depths have no gaps: without a node at this depth or beyond there is none further on.
        ended = nearest.where(F.col("depth") >= depth + width).isEmpty()
        reached = nearest
        if ended:
            break
        middle = hops.select(F.col("node").alias("next"), F.col("next").alias("end"))
        hops, width = written(hops.join(middle, "next").select("node", F.col("end").alias("next")).distinct(), "hops"), 2 * width
    rest = seen.where(F.col("depth") < depth)
    return rest.unionByName(reached.select("node", "depth"))


def lineage_for_layer(nodes: DataFrame, edges: DataFrame, layer: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of one layer with all source and task nodes, and the edges that keep both ends.

    ``nodes`` has node, node_type (source, task or table) and layer.
    """
    kept = nodes.where((F.col("layer") == layer) | F.col("node_type").isin("source", "task"))
    names = kept.select("node")
    inside = edges.join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(
        names.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, inside.select(*edges.columns)
