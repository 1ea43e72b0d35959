"""Columns over catalog metadata: layer of a database, health of a table's file count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layers in warehouse order, and the words that point to a layer when a
# database name has no layer prefix.
LAYERS = ("ods", "dwd", "dws", "ads")
LAYER_WORDS = (
    ("raw", "ods"),
    ("detail", "dwd"),
    ("summary", "dws"),
    ("service", "dws"),
    ("report", "ads"),
    ("app", "ads"),
)
DEFAULT_LAYER = "ods"

# File counts below which a table is good or normal.
GOOD_BELOW = 50
NORMAL_BELOW = 200


def infer_layer(database) -> Column:
    """Layer of a database by name: prefix first, then a telling word, else raw data."""
    name = F.lower(F.col(database) if isinstance(database, str) else database)
    tests = [(name.startswith(layer), layer) for layer in LAYERS]
    tests += [(name.contains(word), layer) for word, layer in LAYER_WORDS]
    start = F.when(*tests[0])
    return reduce(lambda chain, test: chain.when(*test), tests[1:], start).otherwise(DEFAULT_LAYER)


def default_target(layer, table) -> Column:
    """Default warehouse name of a source table: layer, underscore, table."""
    return F.concat_ws("_", layer, table)


def file_health(file_count) -> Column:
    files = F.col(file_count) if isinstance(file_count, str) else file_count
    return (
        F.when(files.isNull() | (files == 0), "unknown")
        .when(files < GOOD_BELOW, "good")
        .when(files < NORMAL_BELOW, "normal")
        .otherwise("urgent")
    )
