"""Table upkeep over the given tables."""

import uuid

from pyspark.sql import functions as F

from strata.functions.catalog import file_health as health_of
from strata.operators import maintenance as op
from strata.plans.fixtures import NOW
from strata.plans.registry import Data, register
from strata.session import fresh_path
from strata.sources.files import file_stats


def _table_of_small_files(d: Data, partition_by=()):
    """Line items in many small files, as frequent commits leave them."""
    path = fresh_path(d.spark, "small-files")
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag")
    rows.repartition(16).write.partitionBy(*partition_by).parquet(path)
    return path


@register("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_returnflag FROM lineitem")
def compact_full(d: Data):
    output = fresh_path(d.spark, "compacted")
    op.compact(d.spark, _table_of_small_files(d), output, "full")
    return d.spark.read.parquet(output)


@register("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_returnflag FROM lineitem")
def compact_minor(d: Data):
    """Partitions with small files are rewritten, and the table is pointed at their new folders."""
    path, output = _table_of_small_files(d, ["l_returnflag"]), fresh_path(d.spark, "compacted")
    name = f"small_files_{uuid.uuid4().hex}"
    d.spark.read.parquet(path).write.partitionBy("l_returnflag").option("path", f"{path}-table").saveAsTable(name)
    op.compact(d.spark, f"{path}-table", output, "minor", partition_by=["l_returnflag"])
    op.switch_partitions(d.spark, name, output, ["l_returnflag"])
    return d.spark.table(name)


@register("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_returnflag FROM lineitem")
def compact_file_groups(d: Data):
    """Small files beside large ones are rewritten in groups, and the table is read without those they replace."""
    path, output = fresh_path(d.spark, "mixed-files"), fresh_path(d.spark, "compacted")
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag")
    rows.where("l_linenumber < 4").hint("rebalance", "l_returnflag").write.partitionBy("l_returnflag").parquet(path)
    rows.where("l_linenumber >= 4").repartition(16).write.mode("append").partitionBy("l_returnflag").parquet(path)
    op.compact_files(d.spark, path, output, partition_by=["l_returnflag"])
    return op.read_compacted(d.spark, path, output)


@register("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_quantity END AS l_quantity,
           lpad(CAST(l_linenumber AS VARCHAR), 1 + CAST(l_linenumber % 3 AS INTEGER), '0') AS code
    FROM lineitem""")
def compact_evolved(d: Data):
    """A table whose later files have one more column, with partition values such as 07 and 007."""
    path, output = fresh_path(d.spark, "evolved"), fresh_path(d.spark, "compacted")
    code = F.lpad(F.col("l_linenumber").cast("string"), (F.col("l_linenumber") % 3 + 1).cast("int"), "0").alias("code")
    rows = d.table("lineitem")
    rows.where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", code).write.partitionBy("code").parquet(path)
    rows.where("l_linenumber > 2").select("l_orderkey", "l_linenumber", "l_quantity", code).write.mode("append").partitionBy("code").parquet(path)
    op.compact(d.spark, path, output, "full", partition_by=["code"])
    return d.spark.read.schema("l_orderkey bigint, l_linenumber int, l_quantity double, code string").parquet(output)


@register("SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY snapshot_id DESC) > 10", ("snap",))
def snapshots_to_expire(d: Data):
    return op.snapshots_to_expire(d.fixture("snap"))


@register(f"""
    SELECT * FROM (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY snapshot_id DESC) > 10)
    WHERE commit_time < TIMESTAMP '{NOW}' - INTERVAL 7 DAY""", ("snap",))
def snapshots_to_expire_by_age(d: Data):
    return op.snapshots_to_expire(d.fixture("snap"), now=NOW, max_age_days=7)


@register("""
    SELECT concat(source, '/data-', doc_id) AS path, n_chars AS length FROM documents
    WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""")
def orphan_files(d: Data):
    path = F.concat("source", F.lit("/data-"), F.col("doc_id").cast("string")).alias("path")
    documents = d.table("documents").select("doc_id", "source", "n_chars")
    listing = documents.select(path, F.col("n_chars").alias("length"))
    referenced = documents.join(d.table("labels").select("doc_id"), "doc_id", "left_semi").select(path)
    return op.orphan_files(listing, referenced)


@register("SELECT * FROM tbl WHERE layer = 'dwd' AND file_count >= 120", ("tbl",))
def compaction_candidates(d: Data):
    return op.compaction_candidates(d.fixture("tbl"), "dwd", 120)


@register("""
    SELECT id, CASE WHEN coalesce(file_count, 0) = 0 THEN 'unknown' WHEN file_count < 50 THEN 'good'
                    WHEN file_count < 200 THEN 'normal' ELSE 'urgent' END AS health FROM tbl""", ("tbl",))
def file_health(d: Data):
    return d.fixture("tbl").select("id", health_of("file_count").alias("health"))


@register("""
    SELECT count(*) FILTER (layer = 'ods') AS n_layer, count(*) FILTER (file_count > 200) AS to_compact,
           count(*) FILTER (id IN (SELECT table_id FROM snap GROUP BY table_id HAVING count(*) > 10)) AS many_snapshots
    FROM tbl""", ("tbl", "snap"))
def maintenance_overview(d: Data):
    return op.maintenance_overview(d.fixture("tbl"), d.fixture("snap"))


@register("""
    SELECT operation, count(*) FILTER (status <> 'failed') AS triggered, count(*) FILTER (status = 'failed') AS failed
    FROM hist GROUP BY operation""", ("hist",))
def maintenance_report(d: Data):
    return op.maintenance_report(d.fixture("hist"))


@register("SELECT * FROM hist WHERE status = 'failed'", ("hist",))
def maintenance_failures(d: Data):
    return op.maintenance_failures(d.fixture("hist"))


@register("""
    WITH before AS (SELECT concat('ods/t', l_suppkey) AS table_path, count(*) AS n, sum(CAST(floor(l_quantity) AS BIGINT)) AS b FROM lineitem GROUP BY 1),
         after AS (SELECT concat('ods/t', l_suppkey) AS table_path, count(*) AS n, sum(CAST(floor(l_quantity) AS BIGINT)) AS b
                   FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT coalesce(b.table_path, a.table_path) AS table_path, 'compact' AS operation, 'success' AS status, 320::BIGINT AS duration_ms,
           b.n AS file_count_before, a.n AS file_count_after, CAST(b.b AS BIGINT) AS total_size_bytes_before, CAST(a.b AS BIGINT) AS total_size_bytes_after
    FROM before b FULL JOIN after a ON a.table_path = b.table_path""")
def maintenance_log(d: Data):
    listing = d.table("lineitem").select(
        F.concat(F.lit("/lake/ods/t"), "l_suppkey", F.lit("/data-"), "l_orderkey").alias("path"),
        F.floor("l_quantity").alias("length"), "l_returnflag")
    after = listing.where(F.col("l_returnflag") == "R")
    return op.maintenance_log(file_stats(listing, "/lake"), file_stats(after, "/lake"), "compact", duration_ms=320)


@register(f"""
    SELECT l_suppkey AS table_id, TIMESTAMP '{NOW}' AS created_at, concat('ods/t', l_suppkey) AS table_path, 'success' AS status,
           count(*) AS file_count_before, nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS file_count_after
    FROM lineitem WHERE l_suppkey = 7 GROUP BY l_suppkey""")
def search_written_log(d: Data):
    """Searches what ``maintenance_log`` writes."""
    listing = d.table("lineitem").select(
        F.concat(F.lit("/lake/ods/t"), "l_suppkey", F.lit("/data-"), "l_orderkey").alias("path"),
        F.floor("l_quantity").alias("length"), "l_returnflag")
    tables = d.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("ods/t"), "s_suppkey").alias("table_path"))
    log = op.maintenance_log(file_stats(listing, "/lake"), file_stats(listing.where("l_returnflag = 'R'"), "/lake"), "compact",
                             tables=tables, created_at=NOW)
    return op.search_log(log, operation="compact", table_id=7).select(
        "table_id", "created_at", "table_path", "status", "file_count_before", "file_count_after")


@register("SELECT * FROM hist WHERE operation = 'compact' AND status = 'failed'", ("hist",))
def search_log(d: Data):
    return op.search_log(d.fixture("hist"), operation="compact", status="failed")
