"""Result rows as CSV lines or JSON-safe values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: byte order mark in front of the header.
BYTE_ORDER_MARK = "\ufeff"


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')),
                    F.lit('"'))


def csv_lines(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Column ``line``: every field quoted, quotes doubled, null as an empty field."""
    capped = df if max_rows is None else df.limit(max_rows)
    line = F.concat_ws(",", *[_quoted(F.col(f"`{name}`")) for name in df.columns])
    return capped.select(line.alias("line"))


def csv_header(names: list[str]) -> str:
    return BYTE_ORDER_MARK + ",".join('"' + name.replace('"', '""') + '"' for name in names)


def export_csv(df: DataFrame, path: str, max_rows: int | None = None) -> None:
    """CSV files with a header each, written where the rows are; a row cap is the caller's choice.

    A sorted result is written as sorted parts whose names are in order.
    """
    header = csv_header(df.columns)
    lines = csv_lines(df, max_rows).select(F.col("line").alias(header))
    # Quotes and commas are in the text already, so the writer must add none.
    lines.write.mode("overwrite").option("header", True).option("quote", "\u0000").option("sep", "\u0001").option(
        "escapeQuotes", False).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Strings, numbers, booleans kept; bytes as base64; nested values as JSON; the rest as text."""
    def safe(field: T.StructField) -> Column:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.NumericType, T.BooleanType)):
            return column
        if isinstance(kind, T.BinaryType):
            return F.base64(column)
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(column)
        return column.cast("string")

    return df.select(*[safe(field).alias(field.name) for field in df.schema])
