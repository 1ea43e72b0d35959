import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows_of

from strata.functions.money import exact_sum
from strata.sources import conform, export, jdbc, mappings, tables


def test_jdbc_options():
    url = "jdbc:postgresql://host/db"
    assert jdbc.jdbc_options(url, "t")["driver"] == "org.postgresql.Driver"
    split = jdbc.jdbc_options(url, "t", "id", (1, 900), 8, user="u")
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"], split["user"]) == ("id", "1", "900", "8", "u")
    with pytest.raises(ValueError):
        jdbc.jdbc_options(url, "t", parts=4)
    with pytest.raises(ValueError):
        jdbc.jdbc_options("postgresql://host", "t")


def test_a_source_without_keys_is_read_whole():
    assert jdbc.split_or_whole("id", (None, None), 8) == (None, None, 1)
    assert jdbc.split_or_whole("id", (3, 90), 8) == ("id", (3, 90), 8)


def test_types():
    kind = conform.warehouse_type
    assert [kind(t) for t in ("varchar", "VARCHAR(20)", "longtext", "tinyint", "YEAR", "BIGINT UNSIGNED", "json", "Bool", "time", "TIMESTAMP(6)")] == [
        "string", "string", "string", "int", "int", "string", "string", "boolean", "time(0)", "timestamp_ntz"]
    assert (kind("DECIMAL"), kind("decimal(10,2)"), kind("NUMERIC(5)"), kind("DECIMAL(10,2)", reference_types=True)) == (
        "decimal(38,18)", "decimal(10,2)", "decimal(5)", "decimal(38,18)")
    assert (kind("int8"), kind("int8", postgres_names=True), kind("timestamptz", postgres_names=True)) == ("string", "bigint", "timestamp_ntz")


def test_conformed_values(make):
    df = make([("7", "1.25", "2024-01-01 10:00:00.123987", "true", "10:11:12")], "i string, d string, t string, b string, c string")
    declared = {"i": "SMALLINT", "d": "DECIMAL", "t": "DATETIME", "b": "BOOL", "c": "TIME"}
    row = conform.conform_types(df, declared).first()
    assert row.i == 7 and row.d == Decimal("1.25") and row.b is True and row.c == "10:11:12"
    assert row.t == dt.datetime(2024, 1, 1, 10, 0, 0, 123000)


def test_undeclared_columns_stay_and_absent_ones_are_told(make):
    df = make([("7", "x")], "i string, `odd name` string")
    assert rows_of(conform.conform_types(df, {"i": "INT"})) == [(7, "x")]
    with pytest.raises(ValueError):
        conform.conform_types(df, {"j": "INT"})


def test_time_of_day(spark, make):
    df = make([("10:11:12",)], "c string")
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        assert conform.conform_types(df, {"c": "TIME"}).first().c == dt.time(10, 11, 12)
    finally:
        spark.conf.unset("spark.sql.timeType.enabled")


def test_millis_before_the_epoch_and_on_the_second(make):
    df = make([("1969-12-31 23:59:59.999999",), ("2024-01-01 00:00:00",), ("2024-01-01 00:00:59.000999",)], "t string")
    assert [row.t for row in conform.conform_types(df, {"t": "TIMESTAMP"}).collect()] == [
        dt.datetime(1969, 12, 31, 23, 59, 59, 999000), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 59)]


def test_mapping_errors(make):
    def errors(text):
        return [row.error for row in mappings.parse_mappings(make([(text,)], "m string"), "m").collect()]

    assert errors('[{"sourceTable":"a","targetTable":"b"}]') == [None]
    assert errors('[{"sourceTable":" ","targetTable":"b"}]') == ["source and target table are required"]
    assert errors('[{"sourceTable":"a","targetTable":"b","syncMode":"Incremental"}]') == ["unknown sync mode"]
    assert errors('[{"sourceTable":"a b","targetTable":"b"}]') == ["unsafe name"]
    assert errors('[{"sourceTable":"a","targetTable":"b","targetDb":"1x"}]') == ["unsafe name"]
    assert errors("{}") == ["not a mapping list"] and errors("[oops") == ["not a mapping list"]
    assert errors("") == ["no mapping"] and errors(None) == ["no mapping"] and errors("[]") == ["not a mapping list"]


def test_start_mode():
    assert [mappings.start_at_latest(mode) for mode in ("incremental", "Incremental", "full+incremental", None)] == [True, True, False, False]
    assert mappings.start_at_latest("full+incremental", task_incremental=True)


def test_sync_copies_or_only_creates(spark, make, tmp_path):
    text = """[{"sourceTable":"a","targetDb":"sync_check","targetTable":"a_copy"},
               {"sourceTable":"b","targetDb":"sync_check","targetTable":"b_copy","syncMode":"incremental"}]"""
    rows = [row.asDict() for row in mappings.parse_mappings(make([(text,)], "m string"), "m").collect()]
    read = {"a": make([("1",), ("2",)], "id string"), "b": make([("3",)], "id string")}.__getitem__
    assert mappings.sync_tables(spark, rows, read, {"a": {"id": "BIGINT"}}, {"a": ["id"]}, str(tmp_path)) == [
        "sync_check.a_copy", "sync_check.b_copy"]
    assert rows_of(spark.table("sync_check.a_copy")) == [(1,), (2,)] and tables.table_keys(spark, "sync_check.a_copy") == ["id"]
    assert spark.table("sync_check.b_copy").count() == 0 and spark.table("sync_check.b_copy").columns == ["id"]
    again = [{**row, "sync_mode": "incremental"} for row in rows]
    mappings.sync_tables(spark, again, read, {"a": {"id": "BIGINT"}}, {"a": ["id"]}, str(tmp_path / "other"))
    assert rows_of(spark.table("sync_check.a_copy")) == [(1,), (2,)]
    for bad in ([], [{"source_table": "a", "error": "unsafe name"}]):
        with pytest.raises(ValueError):
            mappings.sync_tables(spark, bad, read)


def test_csv(spark, make, tmp_path):
    df = make([(1, 'say "hi"', None), (2, "a,b", True)], "id int, `na\"me` string, ok boolean")
    assert rows_of(export.csv_lines(df)) == [('"1","say ""hi""",""',), ('"2","a,b","true"',)]
    export.export_csv(df.orderBy("id"), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes().decode("utf-8") == '﻿"id","na""me","ok"\n"1","say ""hi""",""\n"2","a,b","true"\n'
    assert export.csv_lines(df, 1).count() == 1


def test_json_safe_values(make):
    df = make([(1, True, "rule-a", None, bytearray(b"ab"), dt.date(2024, 1, 2), [1, None], Decimal("1.50"))],
              "n int, b boolean, s string, nul string, bin binary, d date, l array<int>, x decimal(5,2)")
    assert tuple(export.json_safe(df).first()) == (1, True, "rule-a", None, "YWI=", "2024-01-02", "[1,null]", Decimal("1.50"))


def test_write_partitions_in_few_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "CAST(id % 3 AS int) AS p").repartition(8)
    tables.write_table(df, "write_check.parts", keys=["id"], partition_by=["p"], mode="overwrite", path=str(tmp_path / "t"))
    assert tables.table_keys(spark, "write_check.parts") == ["id"]
    assert len(list((tmp_path / "t").glob("p=*/*.parquet"))) == 3
    assert spark.table("write_check.parts").where("p = 1").count() == 333
    tables.write_table(df.limit(10), "write_check.parts", partition_by=["p"], mode="append", path=str(tmp_path / "t"))
    assert spark.table("write_check.parts").count() == 1010
    tables.write_table(df.limit(4), "write_check.plain", mode="overwrite", path=str(tmp_path / "u"))
    assert tables.table_keys(spark, "write_check.plain") == []


def test_exact_sums(make):
    df = make([(0.1,)] * 10 + [(-0.05,), (None,)], "x double")
    assert df.agg(exact_sum("x", 2)).first()[0] == Decimal("0.95")
    big = make([(90_000_000_000_000.25,)] * 100, "x double")
    assert big.agg(exact_sum("x", 2)).first()[0] == Decimal("9000000000000025.00")
    many = big.selectExpr("explode(sequence(1, 2000)) AS i", "x")
    assert many.agg(exact_sum("x", 2)).first()[0] == Decimal("90000000000000.25") * 200_000
    assert make([], "x double").agg(exact_sum("x", 2)).first()[0] is None


def test_reads_of_equal_size_take_every_row_once():
    import random

    import duckdb

    from strata.sources import jdbc
    pick, base = random.Random(3), duckdb.connect()
    base.execute("CREATE TABLE t (k BIGINT, s VARCHAR, d DATE)")
    keys = [pick.choice([7, 7, 7, *range(100), *(i ** 4 for i in range(60))]) for _ in range(2000)] + [None] * 5
    base.executemany("INSERT INTO t VALUES (?, ?, CAST('2024-01-01' AS DATE) + CAST(? AS INTEGER))", [(k, f"it's {k}", (k or 0) % 50) for k in keys])
    for key in ("k", "s", "d"):
        for parts in (1, 4, 16):
            cuts = [row[0] for row in base.sql(f"SELECT cut FROM {jdbc.cut_query('t', key, parts)}").fetchall()]
            reads = [base.sql(f"SELECT count(*) FROM t WHERE {where}").fetchall()[0][0] for where in jdbc.split_predicates(key, cuts)]
            assert sum(reads) == 2005 and len(reads) <= parts
            largest = base.sql(f"SELECT max(n) FROM (SELECT count(*) AS n FROM t GROUP BY {key})").fetchall()[0][0]
            assert max(reads) <= 2005 / parts + largest + 6
    assert jdbc.split_predicates("k", []) == ["1 = 1"]


def test_many_files_are_listed_by_few_tasks(spark, tmp_path):
    from strata.sources.files import list_files
    for number in range(1200):
        folder = tmp_path / f"t{number % 7}" / f"b{number % 40}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"data-{number}.bin").write_bytes(b"x" * (1 + number % 50))
    with open(tmp_path / "t0" / "data-large.bin", "wb") as file:
        file.truncate(3 << 30)
    listing = list_files(spark, str(tmp_path), "data-*")
    assert listing.count() == 1201 and listing.agg({"length": "max"}).first()[0] == 3 << 30
    assert listing.rdd.getNumPartitions() <= 16
