"""Catalog metadata derived from the given tables."""

from pyspark.sql import functions as F

from strata.functions.catalog import infer_layer as layer_of
from strata.operators import catalog as op
from strata.plans.registry import Data, register
from strata.sources import files

LAYER_OF = """CASE WHEN starts_with({db}, 'ods') THEN 'ods' WHEN starts_with({db}, 'dwd') THEN 'dwd' WHEN starts_with({db}, 'dws') THEN 'dws'
        WHEN starts_with({db}, 'ads') THEN 'ads' WHEN contains({db}, 'raw') THEN 'ods' WHEN contains({db}, 'detail') THEN 'dwd'
        WHEN contains({db}, 'summary') OR contains({db}, 'service') THEN 'dws'
        WHEN contains({db}, 'report') OR contains({db}, 'app') THEN 'ads' ELSE 'ods' END"""


@register("""
    WITH both_sides AS (
      SELECT coalesce(c.db, i.db) AS db, coalesce(c.table_name, i.table_name) AS table_name,
             CASE WHEN c.id IS NULL THEN 'insert' WHEN i.id IS NULL THEN 'delete' ELSE 'update' END AS op,
             coalesce(c.id, i.id) AS id, coalesce(i.file_count, c.file_count) AS file_count,
             coalesce(i.total_size_bytes, c.total_size_bytes) AS total_size_bytes, coalesce(i.record_count, c.record_count) AS record_count
      FROM tbl c FULL JOIN tbl_next i ON c.db = i.db AND c.table_name = i.table_name)
    SELECT *, """ + LAYER_OF.format(db="db") + " AS layer FROM both_sides", ("tbl", "tbl_next"))
def sync_catalog(d: Data):
    return op.sync_catalog(d.fixture("tbl"), d.fixture("tbl_next"))


@register("""
    SELECT * FROM tbl c WHERE NOT EXISTS (SELECT 1 FROM tbl_next i WHERE i.db = c.db AND i.table_name = c.table_name)""", ("tbl", "tbl_next"))
def stale_tables(d: Data):
    return op.stale_tables(d.fixture("tbl"), d.fixture("tbl_next"))


@register("""
    SELECT n.table_id, n.name, n.type, CASE WHEN trim(n.comment) = '' AND c.name IS NOT NULL THEN c.comment ELSE n.comment END AS comment,
           c.source_column, n.sort_order
    FROM cols_next n LEFT JOIN cols c ON c.table_id = n.table_id AND c.name = n.name""", ("cols", "cols_next"))
def merge_columns(d: Data):
    return op.merge_columns(d.fixture("cols"), d.fixture("cols_next"), kept=["source_column"])


@register("""
    SELECT n.table_id, n.name, n.type, CASE WHEN trim(n.comment) = '' AND c.name IS NOT NULL THEN c.comment ELSE n.comment END AS comment,
           c.source_column, n.sort_order
    FROM (SELECT * FROM cols_next WHERE table_id % 7 <> 0) n LEFT JOIN cols c ON c.table_id = n.table_id AND c.name = n.name
    UNION ALL
    SELECT table_id, name, type, comment, source_column, sort_order FROM cols c
    WHERE NOT EXISTS (SELECT 1 FROM cols_next n WHERE n.table_id = c.table_id AND n.table_id % 7 <> 0)""", ("cols", "cols_next"))
def merge_columns_unread(d: Data):
    """The documents of every seventh table could not be read."""
    return op.merge_columns(d.fixture("cols"), d.fixture("cols_next").where("table_id % 7 <> 0"), kept=["source_column"])


@register("""
    SELECT table_id, name, type, comment, sort_order IN (1, 2, 3) AS nullable, sort_order IN (0, 2) AS is_pk,
           CASE WHEN sort_order = 4 THEN type END AS default_value, sort_order
    FROM cols WHERE table_id % 3 <> 0
    UNION ALL
    SELECT p_partkey, concat('k', p_size), 'INT', p_brand, false, true, NULL, 0 FROM part WHERE p_partkey % 3 = 0
    UNION ALL
    SELECT p_partkey, 'v', 'STRING', NULL, true, false, NULL, 1 FROM part WHERE p_partkey % 3 = 0""", ("cols",))
def metastore_columns(d: Data):
    """Two tables of three have rows in the metastore, all have a document."""
    place = F.col("sort_order")
    metastore = d.fixture("cols").where("table_id % 3 <> 0").select(
        "table_id", F.col("name").alias("column_name"), F.col("type").alias("column_type"), "comment",
        F.when(place == 0, "0").when(place == 1, "YES").when(place == 3, "True").when(place == 4, "no").alias("is_nullable"),
        F.when(place == 0, "1").when(place == 2, "yes").when(place == 3, "false").alias("is_primary_key"),
        F.when(place == 4, F.col("type")).alias("default_value"), "sort_order")
    documents = d.table("part").select(
        F.col("p_partkey").alias("table_id"), F.concat(F.lit("k"), "p_size").alias("pk"),
        F.to_json(F.array(
            F.struct(F.concat(F.lit("k"), "p_size").alias("name"), F.lit("INT NOT NULL").alias("type"), F.col("p_brand").alias("comment")),
            F.struct(F.lit("v").alias("name"), F.lit("STRING").alias("type"), F.lit(None).cast("string").alias("comment")),
        )).alias("doc"))
    return op.metastore_columns(metastore, op.parse_schema_json(documents, "doc", "pk"), ["table_id"])


@register("""
    SELECT c.* FROM cols c JOIN tbl t ON t.id = c.table_id
    WHERE NOT EXISTS (SELECT 1 FROM tbl_next i WHERE i.db = t.db AND i.table_name = t.table_name)""", ("cols", "tbl", "tbl_next"))
def stale_columns(d: Data):
    return op.stale_columns(d.fixture("cols"), op.stale_tables(d.fixture("tbl"), d.fixture("tbl_next")))


@register("""
    WITH field AS (
      SELECT p_partkey, 0 AS sort_order, 'id' AS name, 'BIGINT' AS type, NULL AS comment, false AS nullable, true AS is_pk,
             NULL AS default_value FROM part
      UNION ALL
      SELECT p_partkey, 1, 'brand', CASE WHEN p_size % 2 = 0 THEN 'VARCHAR(20)' ELSE 'STRING' END, p_brand, true, p_size % 3 = 0, p_type FROM part
      UNION ALL
      SELECT p_partkey, 2, 'price', 'DECIMAL(10, 2)', '', true, false, NULL FROM part)
    SELECT * FROM field WHERE p_partkey % 19 <> 0""")
def parse_schema_json(d: Data):
    field = lambda *parts: F.struct(*[part.cast("string" if name != "nullable" else "boolean").alias(name)
                                      for name, part in zip(("name", "type", "comment", "nullable", "default"), parts)])
    none = F.lit(None)
    fields = F.array(
        field(F.lit("id"), F.lit("BIGINT NOT NULL"), none, none, none),
        field(F.lit("brand"), F.when(F.col("p_size") % 2 == 0, "VARCHAR(20) not null"), F.col("p_brand"), F.lit(True), F.col("p_type")),
        field(F.lit("price"), F.lit("DECIMAL(10, 2)"), F.lit(""), none, none))
    document = (
        F.when(F.col("p_partkey") % 19 == 0, "{not json")
        .when(F.col("p_size") % 2 == 0, F.to_json(fields)).otherwise(F.to_json(F.struct(fields.alias("fields")))))
    keys = F.when(F.col("p_size") % 3 == 0, "id; brand").otherwise("id")
    documents = d.table("part").select("p_partkey", document.alias("doc"), keys.alias("keys"))
    return op.parse_schema_json(documents, "doc", "keys")


@register("""
    SELECT p_partkey, CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_size % 2 = 0 THEN '' WHEN p_size % 3 = 0 THEN 'dt,region' ELSE '' END AS partition_keys,
           CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_size % 2 = 0 THEN '' ELSE 'id' END AS primary_keys,
           CASE WHEN p_partkey % 19 <> 0 AND p_size % 2 <> 0 THEN p_brand END AS comment,
           CASE WHEN p_partkey % 19 <> 0 THEN 2 END::INTEGER AS n_fields,
           CASE WHEN p_partkey % 19 <> 0 AND p_size % 2 <> 0 THEN p_type END AS bucket FROM part""")
def parse_schema_tables(d: Data):
    """Table values of documents: objects, lists of fields (even sizes) and unreadable ones."""
    fields = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("INT").alias("type")) for name in ("id", "v")])
    whole = F.struct(
        fields.alias("fields"), F.array(F.lit("id")).alias("primaryKeys"),
        F.when(F.col("p_size") % 3 == 0, F.array(F.lit("dt"), F.lit("region"))).alias("partitionKeys"),
        F.col("p_brand").alias("comment"), F.create_map(F.lit("bucket"), F.col("p_type")).alias("options"))
    document = F.when(F.col("p_partkey") % 19 == 0, "{not json").when(F.col("p_size") % 2 == 0, F.to_json(fields)).otherwise(F.to_json(whole))
    rows = op.parse_schema_tables(d.table("part").select("p_partkey", document.alias("doc")), "doc")
    return rows.select("p_partkey", F.array_join("partition_keys", ",").alias("partition_keys"),
                       F.array_join("primary_keys", ",").alias("primary_keys"), "comment", "n_fields",
                       F.try_element_at("options", F.lit("bucket")).alias("bucket"))


@register("""
    SELECT id, CAST(id % 1000 AS INTEGER) AS snapshot_count, CASE WHEN id % 9 <> 0 THEN id END AS latest_snapshot_id,
           CAST(file_count AS INTEGER) AS file_count, total_size_bytes
    FROM tbl WHERE id % 23 <> 0 UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM tbl WHERE id % 23 = 0""", ("tbl",))
def table_options(d: Data):
    text = lambda column: F.col(column).cast("string") if isinstance(column, str) else column.cast("string")
    options = F.to_json(F.create_map(
        F.lit("snapshot.count"), text(F.col("id") % 1000), F.lit("file.count"), text("file_count"),
        F.lit("snapshot.latest-id"), F.when(F.col("id") % 9 != 0, text("id")).otherwise("none"),
        F.lit("total-size"), text("total_size_bytes")))
    tables = d.fixture("tbl").select("id", F.when(F.col("id") % 23 == 0, "[oops").otherwise(options).alias("options"))
    return op.table_options(tables, "options")


@register("""
    SELECT l_partkey AS table_id, CAST(count(*) AS INTEGER) AS snapshot_count, max(l_orderkey) AS latest_snapshot_id,
           NULL::INTEGER AS file_count, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS total_size_bytes
    FROM lineitem GROUP BY 1""")
def options_from_rows(d: Data):
    totals = d.table("lineitem").groupBy(F.col("l_partkey").alias("table_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("latest"), F.sum(F.floor("l_quantity")).alias("size"))
    entry = lambda name, column: F.struct(F.lit(name).alias("name"), F.col(column).cast("string").alias("value"))
    rows = totals.select("table_id", F.inline(F.array(
        entry("snapshot.count", "n"), entry("snapshot.latest-id", "latest"), entry("total-size", "size"),
        F.struct(F.lit("owner").alias("name"), F.lit("someone").alias("value")))))
    return op.options_from_rows(rows, ["table_id"], "name", "value")


@register("""
    WITH named AS (SELECT p_partkey, lower(concat(
        CASE p_size % 7 WHEN 0 THEN 'ODS_' WHEN 1 THEN 'dws' WHEN 2 THEN 'my_raw_' WHEN 3 THEN 'detail_' WHEN 4 THEN 'service_' WHEN 5 THEN 'app_'
             ELSE '' END, p_name)) AS db FROM part)
    SELECT p_partkey, """ + LAYER_OF.format(db="db") + " AS layer FROM named")
def infer_layer(d: Data):
    return d.table("part").select("p_partkey", layer_of(F.expr("""concat(
        CASE p_size % 7 WHEN 0 THEN 'ODS_' WHEN 1 THEN 'dws' WHEN 2 THEN 'my_raw_' WHEN 3 THEN 'detail_' WHEN 4 THEN 'service_'
             WHEN 5 THEN 'app_' ELSE '' END, p_name)""")).alias("layer"))


@register("""
    SELECT table_id, snapshot_id, schema_id, commit_kind, date_trunc('millisecond', commit_time) AS commit_time, total_records, delta_records,
           delta_records + 7 AS manifest_size FROM snap""", ("snap",))
def parse_snapshots(d: Data):
    body = F.to_json(F.struct(
        F.col("snapshot_id").alias("id"), F.col("schema_id").alias("schemaId"), F.col("commit_kind").alias("commitKind"),
        F.unix_millis(F.col("commit_time").cast("timestamp")).alias("timeMillis"),
        F.col("total_records").alias("totalRecordCount"), F.col("delta_records").alias("deltaRecordCount"),
        F.col("delta_records").alias("baseManifestListSize"), F.lit(7).alias("deltaManifestListSize")))
    return files.parse_snapshots(d.fixture("snap").select("table_id", body.alias("body")), "body")


@register("""
    SELECT t.id AS table_id, count(s.snapshot_id) AS snapshot_count, max(s.snapshot_id) AS latest_snapshot_id,
           arg_max(s.commit_time, s.snapshot_id) AS latest_commit_time, coalesce(arg_max(s.total_records, s.snapshot_id), 0) AS record_count
    FROM tbl t LEFT JOIN snap s ON s.table_id = t.id GROUP BY t.id""", ("tbl", "snap"))
def latest_snapshot(d: Data):
    return op.latest_snapshot(d.fixture("tbl").select(F.col("id").alias("table_id")), d.fixture("snap"))


PATHS = """
    SELECT concat('/lake/', CASE WHEN l_returnflag = 'R' THEN 'ods' ELSE 'dwd' END, '.db/t', CAST(l_suppkey AS VARCHAR(20)), '/bucket-',
                  CAST(l_linenumber AS VARCHAR(8)), '/', CASE l_linestatus WHEN 'F' THEN CASE WHEN l_tax < 0.04 THEN 'data-' ELSE 'changelog-' END
                  ELSE 'manifest-' END, CAST(l_orderkey AS VARCHAR(20))) AS path,
           CAST(floor(l_extendedprice) AS BIGINT) AS length
    FROM {lineitem}"""


@register("""
    SELECT regexp_extract(path, '^/lake/([^/]+/[^/]+)/', 1) AS table_path, count(*) AS file_count, CAST(sum(length) AS BIGINT) AS total_size_bytes
    FROM (""" + PATHS.replace("{lineitem}", "lineitem") + """) WHERE regexp_matches(path, '/(data|changelog)-[^/]*$') GROUP BY 1""")
def file_stats(d: Data):
    return files.file_stats(d.spark.sql(PATHS, lineitem=d.table("lineitem")), "/lake")


@register("""
    SELECT concat('/lake/t', l_partkey, '/schema') AS folder, max(l_orderkey) AS number,
           concat('/lake/t', l_partkey, '/schema/schema-', max(l_orderkey)) AS path
    FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_partkey""")
def latest_numbered(d: Data):
    listing = d.table("lineitem").select(F.concat(
        F.lit("/lake/t"), "l_partkey", F.lit("/schema/"), F.when(F.col("l_linestatus") == "F", "schema-").otherwise("snapshot-"),
        "l_orderkey").alias("path"))
    return files.latest_numbered(listing, "schema-")


@register("SELECT * FROM tbl WHERE layer = 'dwd' AND contains(lower(table_name), 'red')", ("tbl",))
def search_tables(d: Data):
    return op.search_tables(d.fixture("tbl"), layer="dwd", keyword="RED", columns=("table_name", "db"))


@register("""
    WITH j AS (
      SELECT coalesce(b.table_id, a.table_id) AS table_id, b.name AS bn, a.name AS an, b.type AS btype, a.type AS atype, b.sort_order AS bo, a.sort_order AS ao
      FROM cols b FULL JOIN cols_next a ON a.table_id = b.table_id AND a.name = b.name),
    alters AS (SELECT table_id, 'alter_type' AS change, ao AS sort_order, bn AS name_before, an AS name_after, btype AS type_before, atype AS type_after
               FROM j WHERE bn IS NOT NULL AND an IS NOT NULL AND btype <> atype),
    drops AS (SELECT * FROM j WHERE an IS NULL), adds AS (SELECT * FROM j WHERE bn IS NULL),
    renames AS (SELECT d.table_id, 'rename' AS change, d.bo AS sort_order, d.bn AS name_before, a.an AS name_after, d.btype AS type_before, a.atype AS type_after
                FROM drops d JOIN adds a ON a.table_id = d.table_id AND a.ao = d.bo AND a.atype = d.btype)
    SELECT * FROM alters UNION ALL SELECT * FROM renames
    UNION ALL SELECT table_id, 'drop', bo, bn, NULL, btype, NULL FROM drops d WHERE NOT EXISTS (
      SELECT 1 FROM renames r WHERE r.table_id = d.table_id AND r.name_before = d.bn)
    UNION ALL SELECT table_id, 'add', ao, NULL, an, NULL, atype FROM adds a WHERE NOT EXISTS (
      SELECT 1 FROM renames r WHERE r.table_id = a.table_id AND r.name_after = a.an)""", ("cols", "cols_next"))
def schema_diff(d: Data):
    return op.schema_diff(d.fixture("cols"), d.fixture("cols_next"))


@register("""
    SELECT db, NULL AS table_name, -1 AS position, NULL AS column_name, NULL AS type, count(*) AS children FROM tbl GROUP BY db
    UNION ALL SELECT db, table_name, -1, NULL, NULL, (SELECT count(*) FROM cols WHERE table_id = tbl.id) FROM tbl
    UNION ALL SELECT t.db, t.table_name, c.sort_order, c.name, c.type, 0 FROM tbl t JOIN cols c ON c.table_id = t.id""", ("tbl", "cols"))
def catalog_tree(d: Data):
    return op.catalog_tree(d.fixture("tbl"), d.fixture("cols"))


@register("""
    SELECT count(*) AS tables, count(DISTINCT db) AS databases, CAST(sum(record_count) AS BIGINT) AS records,
           CAST(sum(total_size_bytes) AS BIGINT) AS bytes FROM tbl""", ("tbl",))
def catalog_totals(d: Data):
    return op.catalog_totals(d.fixture("tbl"))


@register("SELECT layer, count(*) AS tables FROM tbl GROUP BY layer", ("tbl",))
def tables_per_layer(d: Data):
    return op.tables_per_layer(d.fixture("tbl"))
