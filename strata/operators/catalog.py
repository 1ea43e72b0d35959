"""Catalog metadata: tables, columns, options, snapshots, schema changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.functions.catalog import infer_layer

TABLE_KEY = ("db", "table_name")

# Table option names and the columns and types they fill.
TABLE_OPTIONS = {
    "snapshot.count": ("snapshot_count", "int"),
    "snapshot.latest-id": ("latest_snapshot_id", "bigint"),
    "file.count": ("file_count", "int"),
    "total-size": ("total_size_bytes", "bigint"),
}

# Fixed value: type of a schema field that names none.
DEFAULT_TYPE = "STRING"

# What a metastore's flags say for yes.
YES_WORDS = ("true", "1", "yes")

# Field names of a schema document.
FIELD_SCHEMA = "array<struct<name:string,type:string,comment:string,nullable:boolean,default:string>>"


def stale_tables(current: DataFrame, incoming: DataFrame, key: Sequence[str] = TABLE_KEY) -> DataFrame:
    """Known tables that the source no longer has."""
    return current.join(incoming.select(*key), list(key), "left_anti")


def stale_columns(columns: DataFrame, stale: DataFrame, table_id: str = "table_id") -> DataFrame:
    """Columns that go because their table goes; ``stale`` is what ``stale_tables`` gives."""
    return columns.join(stale.select(F.col("id").alias(table_id)), table_id, "left_semi")


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(name, F.lit(""))) == ""


def sync_catalog(current: DataFrame, incoming: DataFrame, key: Sequence[str] = TABLE_KEY,
                 texts: Sequence[str] = (), cleared: Sequence[str] = ()) -> DataFrame:
    """What a catalog sync does to each table: insert, update or delete.

    Incoming values win where present, the layer always follows the database name, and a known
    table keeps its id. Known ``texts`` (such as a description) stay unless they are blank. ``cleared``
    values (such as the latest snapshot) are those of the source even where it has none.
    """
    values = [name for name in current.columns if name not in {*key, "id", "layer"}]
    c = current.select(*key, F.struct("id", *values).alias("c"))
    i = incoming.select(*key, F.struct("id", *values).alias("i"))
    op = F.when(F.col("c").isNull(), "insert").when(F.col("i").isNull(), "delete").otherwise("update")

    def value(name: str) -> Column:
        if name in texts:
            return F.when(_blank(f"c.{name}"), F.coalesce(f"i.{name}", f"c.{name}")).otherwise(F.col(f"c.{name}"))
        if name in cleared:
            return F.when(F.col("i").isNull(), F.col(f"c.{name}")).otherwise(F.col(f"i.{name}"))
        return F.coalesce(f"i.{name}", f"c.{name}")

    return c.join(i, list(key), "full_outer").select(
        op.alias("op"), F.coalesce("c.id", "i.id").alias("id"), infer_layer("db").alias("layer"), *key,
        *[value(name).alias(name) for name in values])


def apply_sync(synced: DataFrame) -> DataFrame:
    """Catalog after a sync."""
    return synced.where(F.col("op") != "delete").drop("op")


def merge_columns(current: DataFrame, incoming: DataFrame, key: Sequence[str] = ("table_id", "name"),
                  comment: str = "comment", kept: Sequence[str] = ()) -> DataFrame:
    """Incoming columns replace the known ones; a blank comment falls back to the known one.

    ``kept`` columns (such as the source column) always come from the known row when there is one.
    A table without any incoming column (its document could not be read) keeps its own.

    Both sides grow alike, and the planner may take either for small (file sizes say little about rows that come out of
    lists or compress well): the joins are sorted, which spill, and never broadcast.
    """
    c = current.select(*key, F.struct(comment, *kept).alias("c")).hint("merge")
    fallback = F.when(F.trim(F.coalesce(comment, F.lit(""))) != "", F.col(comment)).otherwise(
        F.when(F.col("c").isNotNull(), F.col(f"c.{comment}")).otherwise(F.col(comment)))
    chosen = []
    for name in incoming.columns:
        if name == comment:
            chosen.append(fallback.alias(name))
        elif name in kept:
            chosen.append(F.when(F.col("c").isNotNull(), F.col(f"c.{name}")).otherwise(F.col(name)).alias(name))
        else:
            chosen.append(F.col(name))
    table = list(key[:-1])
    unread = current.join(incoming.select(*table).distinct().hint("merge"), table, "left_anti")
    return incoming.join(c, list(key), "left").select(*chosen).unionByName(
        unread.select(*[name for name in incoming.columns if name in current.columns]), allowMissingColumns=True)


def parse_schema_json(df: DataFrame, json_col: str, pk_col: str | None = None) -> DataFrame:
    """Schema documents to one row per column.

    A document is a list of fields or an object with ``fields``. Primary keys come from ``pk_col``
    (separated by comma or semicolon) or from the document. Unreadable documents give no rows.
    """
    text = F.trim(F.col(json_col))
    document = F.from_json(text, f"struct<fields:{FIELD_SCHEMA},primaryKeys:array<string>>")
    fields = F.when(text.startswith("["), F.from_json(text, FIELD_SCHEMA)).otherwise(document["fields"])
    if pk_col:
        keys = F.transform(F.split(F.coalesce(F.col(pk_col), F.lit("")), "[,;]"), lambda key: F.trim(key))
    else:
        keys = F.coalesce(F.when(~text.startswith("["), document["primaryKeys"]), F.array().cast("array<string>"))
    kept = [name for name in df.columns if name not in (json_col, pk_col)]
    rows = df.select(*kept, keys.alias("_keys"), F.posexplode(fields).alias("sort_order", "_f"))
    declared = F.coalesce("_f.type", F.lit(DEFAULT_TYPE))
    not_null = F.upper(declared).endswith(" NOT NULL")
    return rows.select(
        *kept, F.coalesce("_f.name", F.lit("")).alias("name"),
        F.regexp_replace(declared, r"(?i)\s+NOT NULL$", "").alias("type"),
        F.col("_f.comment").alias("comment"),
        F.coalesce("_f.nullable", ~not_null).alias("nullable"),
        F.array_contains("_keys", F.coalesce("_f.name", F.lit(""))).alias("is_pk"),
        F.col("_f.default").alias("default_value"), "sort_order")


def _flag(text: str, default: bool) -> Column:
    """A yes/no text of a metastore; null means ``default``, any other word no."""
    return F.when(F.col(text).isNull(), F.lit(default)).otherwise(F.lower(F.col(text).cast("string")).isin(*YES_WORDS))


def metastore_columns(metastore: DataFrame, documents: DataFrame, key: Sequence[str] = TABLE_KEY) -> DataFrame:
    """Columns of each table from the metastore's rows; tables without any take those of their schema document.

    ``documents`` are rows of ``parse_schema_json`` with the same ``key``. A missing flag means nullable and no
    primary key, a missing place means 0.
    """
    listed = metastore.select(
        *key, F.col("column_name").alias("name"), F.col("column_type").alias("type"), "comment",
        _flag("is_nullable", True).alias("nullable"), _flag("is_primary_key", False).alias("is_pk"),
        F.col("default_value").cast("string").alias("default_value"),
        F.coalesce(F.col("sort_order").cast("int"), F.lit(0)).alias("sort_order"))
    unlisted = documents.join(metastore.select(*key).distinct(), list(key), "left_anti")
    return listed.unionByName(unlisted.select(*listed.columns))


def parse_schema_tables(df: DataFrame, json_col: str) -> DataFrame:
    """Schema documents to one row per table: partition_keys, primary_keys, comment, n_fields and options.

    A document that is only a list of fields has no table values: its keys are empty lists, its options an empty map.
    Unreadable documents have null everywhere.
    """
    text = F.trim(F.col(json_col))
    listed = text.startswith("[")
    document = F.from_json(text, f"struct<fields:{FIELD_SCHEMA},partitionKeys:array<string>,primaryKeys:array<string>,"
                                 "comment:string,options:map<string,string>>")
    fields = F.when(listed, F.from_json(text, FIELD_SCHEMA)).otherwise(document["fields"])
    readable = fields.isNotNull()
    keys = lambda name: F.when(readable, F.coalesce(F.when(~listed, document[name]), F.array().cast("array<string>")))
    kept = [name for name in df.columns if name != json_col]
    return df.select(
        *kept, keys("partitionKeys").alias("partition_keys"), keys("primaryKeys").alias("primary_keys"),
        F.when(readable & ~listed, document["comment"]).alias("comment"), F.when(readable, F.size(fields)).alias("n_fields"),
        F.when(readable, F.coalesce(F.when(~listed, document["options"]), F.create_map().cast("map<string,string>"))).alias("options"))


def table_options(df: DataFrame, json_col: str, options: dict | None = None) -> DataFrame:
    """Known table options of a JSON map as numbers; bad JSON or a bad number gives null."""
    parsed = df.withColumn("_options", F.from_json(json_col, "map<string,string>"))
    return parsed.select(
        *[name for name in df.columns if name != json_col],
        *[F.try_element_at("_options", F.lit(name)).try_cast(kind).alias(column)
          for name, (column, kind) in (options or TABLE_OPTIONS).items()])


def options_from_rows(properties: DataFrame, key: Sequence[str], name: str, value: str,
                      options: dict | None = None) -> DataFrame:
    """The same from property rows (table, name, value): one conditional aggregate per option."""
    wanted = options or TABLE_OPTIONS
    return properties.where(F.col(name).isin(*wanted)).groupBy(*key).agg(*[
        F.max(F.when(F.col(name) == option, F.col(value))).try_cast(kind).alias(column)
        for option, (column, kind) in wanted.items()])


def latest_snapshot(tables: DataFrame, snapshots: DataFrame, key: str = "table_id") -> DataFrame:
    """Per table: snapshot count, newest id, its commit time and record count; 0 without snapshots."""
    newest = snapshots.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("snapshot_id", "commit_time", "total_records")).alias("s"))
    return tables.join(newest, key, "left").select(
        *tables.columns, F.coalesce("n", F.lit(0).cast("bigint")).alias("snapshot_count"),
        F.col("s.snapshot_id").alias("latest_snapshot_id"), F.col("s.commit_time").alias("latest_commit_time"),
        F.coalesce("s.total_records", F.lit(0).cast("bigint")).alias("record_count"))


def search_tables(tables: DataFrame, layer: str | None = None, db: str | None = None,
                  keyword: str | None = None, columns: Sequence[str] = ("table_name",)) -> DataFrame:
    """Tables by layer, database and a word in any of ``columns``, in any case; None means any."""
    if layer is not None:
        tables = tables.where(F.col("layer") == layer)
    if db is not None:
        tables = tables.where(F.col("db") == db)
    if keyword is not None:
        hits = [F.lower(name).contains(keyword.lower()) for name in columns]
        match = hits[0]
        for hit in hits[1:]:
            match = match | hit
        tables = tables.where(match)
    return tables


def schema_diff(before: DataFrame, after: DataFrame, key: str = "table_id") -> DataFrame:
    """Added, dropped, renamed and retyped columns between two versions of many schemas.

    One dropped and one added column at the same known position with the same type are one rename; where
    several compete, the first of each by name, and the others stay what they are.
    """
    b = before.select(key, "name", F.struct("type", "sort_order").alias("b"))
    a = after.select(key, "name", F.struct("type", "sort_order").alias("a"))
    both = b.join(a, [key, "name"], "full_outer")
    changed = both.where(F.col("b").isNull() | F.col("a").isNull() | ~F.col("a.type").eqNullSafe(F.col("b.type")))
    altered = F.col("b").isNotNull() & F.col("a").isNotNull()
    # Drops and adds meet by position and type; a retyped column stays a group of its own.
    placed = changed.select(
        key, F.coalesce("a.sort_order", "b.sort_order").alias("sort_order"),
        F.when(~altered, F.coalesce("a.type", "b.type")).alias("type"),
        F.when(altered, F.col("name")).alias("altered"),
        F.when(altered, F.col("b.type")).alias("type_before"), F.when(altered, F.col("a.type")).alias("type_after"),
        F.when(F.col("a").isNull(), F.col("name")).alias("dropped"),
        F.when(F.col("b").isNull(), F.col("name")).alias("added"))
    place = W.partitionBy(key, "sort_order", "type", "altered", F.col("dropped").isNull()).orderBy("dropped", "added")
    alone = F.col("sort_order").isNull() | (F.row_number().over(place) > 1)
    placed = placed.withColumn("alone", F.when(alone, F.coalesce("dropped", "added")))
    pairs = placed.groupBy(key, "sort_order", "type", "altered", "alone").agg(
        *[F.max(name).alias(name) for name in ("type_before", "type_after", "dropped", "added")])
    change = (
        F.when(F.col("altered").isNotNull(), "alter_type")
        .when(F.col("dropped").isNotNull() & F.col("added").isNotNull(), "rename")
        .when(F.col("added").isNotNull(), "add").otherwise("drop"))
    return pairs.select(
        key, change.alias("change"), "sort_order",
        F.coalesce("altered", "dropped").alias("name_before"), F.coalesce("altered", "added").alias("name_after"),
        F.coalesce("type_before", F.when(F.col("dropped").isNotNull(), F.col("type"))).alias("type_before"),
        F.coalesce("type_after", F.when(F.col("added").isNotNull(), F.col("type"))).alias("type_after"))


def catalog_tree(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """The catalog as tree nodes in reading order: database, its tables by name, their columns in order.

    Nodes are rows, sorted across tasks by range: no database or table is gathered in one place.
    ``children`` counts the nodes one level below.
    """
    text = lambda: F.lit(None).cast("string")
    widths = columns.groupBy(F.col("table_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    table_nodes = tables.join(widths, "id", "left").select(
        "db", "table_name", F.lit(-1).alias("position"), text().alias("column_name"), text().alias("type"),
        F.coalesce("children", F.lit(0).cast("bigint")).alias("children"))
    database_nodes = tables.groupBy("db").agg(F.count(F.lit(1)).alias("children")).select(
        "db", text().alias("table_name"), F.lit(-1).alias("position"), text().alias("column_name"),
        text().alias("type"), "children")
    column_nodes = columns.join(tables.select(F.col("id").alias("table_id"), "db", "table_name"), "table_id").select(
        "db", "table_name", F.col("sort_order").alias("position"), F.col("name").alias("column_name"), "type",
        F.lit(0).cast("bigint").alias("children"))
    nodes = database_nodes.unionByName(table_nodes).unionByName(column_nodes)
    return nodes.orderBy("db", F.asc_nulls_first("table_name"), "position", F.asc_nulls_first("column_name"))


def catalog_totals(tables: DataFrame) -> DataFrame:
    return tables.agg(
        F.count(F.lit(1)).alias("tables"), F.count_distinct("db").alias("databases"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("total_size_bytes"), F.lit(0)).alias("bytes"))


def tables_per_layer(tables: DataFrame) -> DataFrame:
    return tables.groupBy("layer").agg(F.count(F.lit(1)).alias("tables"))


