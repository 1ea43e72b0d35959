"""Declared source types to warehouse types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.times import to_millis

# Bare source type name to warehouse type. Every other name becomes string.
WAREHOUSE_TYPES = {
    "VARCHAR": "string",
    "CHAR": "string",
    "TEXT": "string",
    "LONGTEXT": "string",
    "INT": "int",
    "INTEGER": "int",
    "SMALLINT": "int",
    "TINYINT": "int",
    "YEAR": "int",
    "BIGINT": "bigint",
    "DECIMAL": "decimal(38,18)",
    "NUMERIC": "decimal(38,18)",
    "FLOAT": "float",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "BOOL": "boolean",
    "DATE": "date",
    "TIME": "time(0)",
    "DATETIME": "timestamp_ntz",
    "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMP(3)": "timestamp_ntz",
    "TIMESTAMP(6)": "timestamp_ntz",
}

# PostgreSQL names that the table above lacks (used on request only).
POSTGRES_TYPES = {
    "INT2": "int",
    "INT4": "int",
    "INT8": "bigint",
    "FLOAT4": "float",
    "FLOAT8": "double",
    "TIMESTAMPTZ": "timestamp_ntz",
}


def warehouse_type(declared: str, reference_types: bool = False, postgres_names: bool = False) -> str:
    """Spark type of a declared source type.

    Decimals keep their declared precision unless ``reference_types`` asks for one fixed type.
    """
    name = declared.strip().upper()
    known = WAREHOUSE_TYPES | POSTGRES_TYPES if postgres_names else WAREHOUSE_TYPES
    if name in known:
        return known[name]
    bare, _, arguments = name.partition("(")
    if bare.strip() in ("DECIMAL", "NUMERIC") and re.fullmatch(r"\d+\s*(,\s*\d+)?\)", arguments):
        return WAREHOUSE_TYPES["DECIMAL"] if reference_types else f"decimal({arguments}".lower()
    return "string"


def _conformed(column: Column, target: str, time_type: bool) -> Column:
    if target == "timestamp_ntz":
        return to_millis(column.cast(target))
    if target == "time(0)" and not time_type:
        return F.date_format(column.cast("timestamp"), "HH:mm:ss")
    return column.cast(target)


def conform_types(df: DataFrame, declared: dict[str, str], reference_types: bool = False,
                  postgres_names: bool = False) -> DataFrame:
    """Every column in one projection: declared ones cast to warehouse types, others as they are.

    A time of day needs ``spark.sql.timeType.enabled``; without it the column is text (HH:mm:ss).
    """
    time_type = df.sparkSession.conf.get("spark.sql.timeType.enabled", "false") == "true"
    absent = [name for name in declared if name not in df.columns]
    if absent:
        raise ValueError(f"declared columns that the source lacks: {absent}")
    return df.select(*[
        _conformed(F.col(f"`{name}`"), warehouse_type(declared[name], reference_types, postgres_names), time_type).alias(name)
        if name in declared else F.col(f"`{name}`")
        for name in df.columns
    ])
