"""Table mappings of a sync task: JSON text to rows, and the sync itself."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.conform import conform_types
from strata.sources.tables import write_table

# Defaults, accepted modes and the pattern of a safe name.
DEFAULT_DATABASE = "ods"
DEFAULT_MODE = "full+incremental"
SYNC_MODES = ("full+incremental", "incremental")
SAFE_NAME = "^[A-Za-z_][A-Za-z0-9_]*$"

# Field names of a mapping.
MAPPING_SCHEMA = "array<struct<sourceTable:string,targetDb:string,targetTable:string,syncMode:string>>"


def parse_mappings(df: DataFrame, json_col: str) -> DataFrame:
    """One row per mapping; ``error`` names the first thing wrong with it, else null."""
    text = F.trim(F.col(json_col))
    parsed = F.when(text.startswith("["), F.from_json(text, MAPPING_SCHEMA))
    rows = df.withColumn("_item", F.explode_outer(parsed)).withColumn("_text", text)
    source, target = F.trim("_item.sourceTable"), F.trim("_item.targetTable")
    rows = rows.select(
        *[name for name in df.columns if name != json_col],
        source.alias("source_table"),
        F.coalesce("_item.targetDb", F.lit(DEFAULT_DATABASE)).alias("target_db"),
        target.alias("target_table"),
        F.coalesce("_item.syncMode", F.lit(DEFAULT_MODE)).alias("sync_mode"),
        F.col("_item").isNull().alias("_missing"),
        (F.coalesce("_text", F.lit("")) == "").alias("_blank"),
    )
    named = (F.coalesce("source_table", F.lit("")) != "") & (F.coalesce("target_table", F.lit("")) != "")
    safe = F.lit(True)
    for name in ("source_table", "target_db", "target_table"):
        safe = safe & F.col(name).rlike(SAFE_NAME)
    error = (
        F.when(F.col("_blank"), "no mapping")
        .when(F.col("_missing"), "not a mapping list")
        .when(~named, "source and target table are required")
        .when(~F.col("sync_mode").isin(*SYNC_MODES), "unknown sync mode")
        .when(~safe, "unsafe name")
    )
    return rows.withColumn("error", error).drop("_missing", "_blank")


def start_at_latest(sync_mode: str | None, task_incremental: bool = False) -> bool:
    """Whether a mapping skips the full copy: by its own mode or by the task's strategy."""
    return task_incremental or (sync_mode or DEFAULT_MODE).lower() == "incremental"


def sync_tables(spark: SparkSession, mappings: Iterable[dict], read: Callable[[str], DataFrame],
                declared: dict[str, dict[str, str]] | None = None, keys: dict[str, list[str]] | None = None,
                location: str | None = None, task_incremental: bool = False) -> list[str]:
    """Create each mapped table with all source columns and copy the source rows; returns the tables.

    ``mappings`` are the job's own settings (a short list, such as rows of ``parse_mappings``). ``read``
    opens a source table, for instance ``read_source`` bound to a url. A full copy replaces the rows of its
    table. An incremental mapping creates its table empty where it is missing and leaves an existing one as
    it is: its rows come from the change stream alone. Tables are independent writes.
    """
    mappings = list(mappings)
    if not mappings:
        raise ValueError("no table mapping")
    for mapping in mappings:
        if mapping.get("error"):
            raise ValueError(f"mapping of {mapping['source_table']}: {mapping['error']}")
    written = []
    for mapping in mappings:
        source = mapping["source_table"]
        df = read(source)
        if declared and source in declared:
            df = conform_types(df, declared[source])
        name = f"{mapping.get('target_db') or DEFAULT_DATABASE}.{mapping['target_table']}"
        path = f"{location}/{name.replace('.', '/')}" if location else None
        if not start_at_latest(mapping.get("sync_mode"), task_incremental):
            write_table(df, name, keys=(keys or {}).get(source, ()), mode="overwrite", path=path)
        elif not spark.catalog.tableExists(name):
            write_table(df.limit(0), name, keys=(keys or {}).get(source, ()), mode="errorifexists", path=path)
        written.append(name)
    return written
