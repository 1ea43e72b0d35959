import json

from conftest import rows_of
from pyspark.sql import functions as F

from strata.functions.catalog import default_target, file_health, infer_layer
from strata.operators import catalog as op
from strata.sources import files


def test_schema_document(make):
    document = {"primaryKeys": ["region_code", "day"], "fields": [
        {"name": "region_code", "type": "CHAR(3) NOT NULL", "comment": "where"}, {"name": "day", "type": "DATE not null"},
        {"name": "revenue", "type": "DECIMAL(18, 4)", "default": "0"}, {"name": "tags", "type": "ARRAY<STRING>", "nullable": False}]}
    df = make([(1, json.dumps(document))], "t int, doc string")
    assert rows_of(op.parse_schema_json(df, "doc"), "sort_order", "name", "type", "nullable", "is_pk", "comment", "default_value") == [
        (0, "region_code", "CHAR(3)", False, True, "where", None), (1, "day", "DATE", False, True, None, None),
        (2, "revenue", "DECIMAL(18, 4)", True, False, None, "0"), (3, "tags", "ARRAY<STRING>", False, False, None, None)]


def test_schema_list_with_key_column_and_bad_documents(make):
    fields = [{"name": "a", "type": "int not null", "nullable": True, "default": "7"}, {"name": "b"}]
    df = make([(1, json.dumps(fields), "a ;c"), (2, "{broken", "a"), (3, '{"fields": 4}', "a"), (4, None, None)],
              "t int, doc string, keys string")
    assert rows_of(op.parse_schema_json(df, "doc", "keys"), "t", "name", "type", "nullable", "is_pk", "default_value") == [
        (1, "a", "int", True, True, "7"), (1, "b", "STRING", True, False, None)]


def test_layer_of_database(make):
    names = ["ODS_x", "dwd", "my_raw", "order_detail", "summary_a", "service_b", "Report_x", "app1", "else", "dwsomething"]
    out = make([(n,) for n in names], "n string").select(infer_layer("n")).collect()
    assert [row[0] for row in out] == ["ods", "dwd", "ods", "dwd", "dws", "dws", "ads", "ads", "ods", "dws"]
    assert make([(1,)], "x int").select(default_target(F.lit("ods"), F.lit("users"))).first()[0] == "ods_users"


def test_file_health_bands(make):
    out = make([(None,), (0,), (1,), (49,), (50,), (199,), (200,)], "n int").select(file_health("n")).collect()
    assert [row[0] for row in out] == ["unknown", "unknown", "good", "good", "normal", "normal", "urgent"]


def test_options(make):
    df = make([(1, '{"snapshot.count": "3", "file.count": 4, "total-size": "many"}'), (2, "nonsense"), (3, None)],
              "t int, options string")
    assert rows_of(op.table_options(df, "options")) == [(1, 3, None, 4, None), (2, None, None, None, None), (3, None, None, None, None)]


def test_sync_and_apply(make):
    schema = "id int, layer string, db string, table_name string, file_count int"
    current = make([(1, "old", "dwd_a", "t", 5), (2, "ods", "ods_b", "gone", 1)], schema)
    incoming = make([(70, None, "dwd_a", "t", None), (71, None, "report", "new", 3)], schema)
    synced = op.sync_catalog(current, incoming)
    assert rows_of(synced, "op", "id", "layer", "table_name", "file_count") == [
        ("delete", 2, "ods", "gone", 1), ("insert", 71, "ads", "new", 3), ("update", 1, "dwd", "t", 5)]
    assert rows_of(op.apply_sync(synced), "table_name") == [("new",), ("t",)]
    assert rows_of(op.stale_tables(current, incoming), "table_name") == [("gone",)]


def test_merge_columns_keeps_comment_and_source(make):
    schema = "table_id int, name string, comment string, source_column string"
    current = make([(1, "a", "kept", "s1"), (1, "b", "old", "s2"), (1, "c", "x", "s3")], schema)
    incoming = make([(1, "a", " ", None), (1, "b", "fresh", "other"), (1, "d", None, "s9")], schema)
    assert rows_of(op.merge_columns(current, incoming, kept=["source_column"])) == [
        (1, "a", "kept", "s1"), (1, "b", "fresh", "s2"), (1, "d", None, "s9")]


def test_a_table_without_readable_columns_keeps_its_own(make):
    schema = "table_id int, name string, comment string, source_column string"
    current = make([(1, "a", "x", "s1"), (2, "b", "y", "s2"), (2, "c", "z", "s3")], schema)
    incoming = make([(1, "a", "new", None)], schema)
    assert rows_of(op.merge_columns(current, incoming, kept=["source_column"])) == [
        (1, "a", "new", "s1"), (2, "b", "y", "s2"), (2, "c", "z", "s3")]


def test_columns_without_a_key_and_columns_that_come_twice_meet_as_before(make):
    schema = "table_id int, name string, comment string, source_column string"
    current = make([(None, "a", "x", "s1"), (1, None, "y", "s2"), (2, "b", "z", "s3"), (2, "b", "w", "s4")], schema)
    incoming = make([(None, "a", "", None), (1, None, " ", None), (2, "b", "", "s9"), (2, "b", "n", None)], schema)
    assert rows_of(op.merge_columns(current, incoming, kept=["source_column"])) == sorted([
        (None, "a", "", None), (1, None, " ", None), (2, "b", "z", "s3"), (2, "b", "w", "s4"), (2, "b", "n", "s3"),
        (2, "b", "n", "s4"), (None, "a", "x", "s1")], key=repr)


def test_texts_stay_and_snapshots_are_cleared(make):
    schema = "id int, layer string, db string, table_name string, description string, latest_snapshot_id bigint"
    current = make([(1, "ods", "ods", "a", "mine", 7), (2, "ods", "ods", "b", " ", 8), (3, "ods", "ods", "gone", "x", 9)], schema)
    incoming = make([(8, None, "ods", "a", "theirs", None), (9, None, "ods", "b", "theirs", 3)], schema)
    out = op.sync_catalog(current, incoming, texts=["description"], cleared=["latest_snapshot_id"])
    assert rows_of(out, "id", "description", "latest_snapshot_id") == [(1, "mine", None), (2, "theirs", 3), (3, "x", 9)]
    columns = make([(1, "p"), (3, "q")], "table_id int, name string")
    assert rows_of(op.stale_columns(columns, op.stale_tables(current, incoming))) == [(3, "q")]


def test_no_change_is_lost_at_equal_or_unknown_positions(make):
    schema = "table_id int, name string, type string, sort_order int"
    before = make([(1, "d1", "int", 4), (1, "d2", "int", 4), (2, "x", "int", None), (3, "t", "int", 0)], schema)
    after = make([(1, "n1", "int", 4), (2, "y", "int", None), (3, "t", None, 0)], schema)
    assert rows_of(op.schema_diff(before, after), "table_id", "change", "name_before", "name_after") == [
        (1, "drop", "d2", None), (1, "rename", "d1", "n1"), (2, "add", None, "y"), (2, "drop", "x", None), (3, "alter_type", "t", "t")]


def test_schema_diff_cases(make):
    schema = "table_id int, name string, type string, sort_order int"
    before = make([(1, "id", "int", 0), (1, "old", "string", 1), (1, "n", "int", 2), (1, "drop", "int", 3), (1, "moved", "int", 4)], schema)
    after = make([(1, "id", "int", 0), (1, "new", "string", 1), (1, "n", "bigint", 2), (1, "other", "date", 3), (1, "moved", "int", 5)], schema)
    assert rows_of(op.schema_diff(before, after), "change", "name_before", "name_after", "type_before", "type_after") == [
        ("add", None, "other", None, "date"), ("alter_type", "n", "n", "int", "bigint"),
        ("drop", "drop", None, "int", None), ("rename", "old", "new", "string", "string")]


def test_latest_snapshot_without_snapshots(make):
    tables = make([(1,), (2,)], "table_id int")
    snaps = make([(1, 5, None, 50), (1, 9, None, 90)], "table_id int, snapshot_id bigint, commit_time timestamp_ntz, total_records bigint")
    assert rows_of(op.latest_snapshot(tables, snaps)) == [(1, 2, 9, None, 90), (2, 0, None, None, 0)]


def test_tree_order(make):
    tables = make([(1, "b", "t1"), (2, "a", "z"), (3, "a", "k")], "id int, db string, table_name string")
    columns = make([(2, "second", "int", 1), (2, "first", "int", 0)], "table_id int, name string, type string, sort_order int")
    nodes = op.catalog_tree(tables, columns).collect()
    assert [(n.db, n.table_name, n.column_name, n.children) for n in nodes] == [
        ("a", None, None, 2), ("a", "k", None, 0), ("a", "z", None, 2), ("a", "z", "first", 0), ("a", "z", "second", 0),
        ("b", None, None, 1), ("b", "t1", None, 0)]


def test_real_files(spark, tmp_path):
    def put(path, size):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x" * size)

    put("ods.db/t/bucket-0/data-1.orc", 10)
    put("ods.db/t/dt=1/bucket-0/changelog-2.orc", 5)
    put("ods.db/t/manifest/manifest-1", 99)
    put("dwd.db/u/bucket-1/data-3.orc", 7)
    for number in (1, 9, 10):
        put(f"ods.db/t/schema/schema-{number}", 1)
    listing = files.list_files(spark, str(tmp_path))
    assert rows_of(files.file_stats(listing, str(tmp_path))) == [("dwd.db/u", 1, 7), ("ods.db/t", 2, 15)]
    latest = files.latest_numbered(listing, "schema-").first()
    assert latest.number == 10 and latest.path.endswith("ods.db/t/schema/schema-10")


def test_snapshot_files(spark, tmp_path):
    for number in (1, 2, 10):
        (tmp_path / f"snapshot-{number}").write_text(json.dumps(
            {"id": number, "schemaId": 0, "commitKind": "APPEND", "timeMillis": 1704067200000, "totalRecordCount": 7,
             "deltaRecordCount": 2, "baseManifestListSize": 30, "deltaManifestListSize": 12}, indent=1))
    (tmp_path / "snapshot-3").write_text("broken")
    (tmp_path / "snapshot-LATEST").write_text("10")
    found = files.list_snapshots(spark, str(tmp_path)).collect()
    assert [row.snapshot_id for row in found] == [10, 2, 1]
    assert found[0].manifest_size == 42 and str(found[0].commit_time) == "2024-01-01 00:00:00"


def test_metastore_flags_and_tables_known_by_their_document_only(spark, make):
    metastore = make(
        [("ods", "a", "x", "INT", None, "TRUE", "1", None, 2), ("ods", "a", "y", "INT", "", None, None, "0", None),
         ("ods", "a", "z", "INT", "c", "n", " yes", None, 1)],
        "db string, table_name string, column_name string, column_type string, comment string, is_nullable string, "
        "is_primary_key string, default_value string, sort_order int")
    listed = make([("ods", "a", '[{"name":"old","type":"INT"}]'), ("ods", "b", '[{"name":"k","type":"INT NOT NULL"}]'),
                   ("ods", "c", "unreadable"), (None, "d", '[{"name":"n"}]')], "db string, table_name string, doc string")
    documents = op.parse_schema_json(listed, "doc")
    got = op.metastore_columns(metastore, documents)
    assert rows_of(got, "table_name", "name", "nullable", "is_pk", "default_value", "sort_order") == [
        ("a", "x", True, True, None, 2), ("a", "y", True, False, "0", 0), ("a", "z", False, False, None, 1),
        ("b", "k", False, False, None, 0), ("d", "n", True, False, None, 0)]
    assert op.metastore_columns(metastore.limit(0), documents).count() == 3
    assert op.metastore_columns(metastore, documents.limit(0)).count() == 3
